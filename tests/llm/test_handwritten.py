from tessera.llm.handwritten import not_handwritten

FILES = "id string, snapshot_id string, path string, content_hash string, size long, is_binary boolean, reason string"
TEXTS = "snapshot_id string, path string, content_hash string, content string"


def test_each_rule_and_what_only_looks_like_it(spark):
    yes = ["node_modules/x/index.js", "a\\vendor\\y.go", "web/package-lock.json", "static/app.min.js", "api/v1/a.pb.go", "Src/Obj/Debug/a.cs", "lib/x-1.2.3.js", "p/mock_a.go"]
    no = ["src/vendors/a.ts", "src/distribution/a.py", "tools/generate_a.py", "css/a-minimal.css", "crates/external_a/src/lib.rs", "src/nested-bundle.js", None]
    rows = [(f"y{k}", "s", p, None, 10, False, "x") for k, p in enumerate(yes)] + [(f"n{k}", "s", p, None, 10, None, "x") for k, p in enumerate(no)]
    rows += [("big", "s", "a.sql", "sha256:AA", 400_000, False, "x"), ("copy", "t", "b.sql", "aa", None, False, "x"), ("bin", "s", "node_modules/a.png", None, 9, True, "x"), (None, "s", "vendor/a.c", None, 1, False, "x")]
    rows += [("note", "s", "./q.py", "h1", 5, False, "x"), ("same", "t", "r.py", "H1", 5, False, "x"), ("body", "s", "c.py", "h2", 5, False, "x")] * 2
    texts = [("s", "q.py", "h1", "# Code generated by x. DO NOT EDIT.\nx = 1\n"), ("s", "c.py", "h2", 'import os\nprint("do not edit")\n' + "#\n" * 20 + "# do not edit\n"), ("s", "e.py", None, None), ("s", "f.py", "", "")]
    got = {r.id: r.reason for r in not_handwritten(spark.createDataFrame(rows, FILES), spark.createDataFrame(texts, TEXTS)).collect()}
    assert set(got) == {f"y{k}" for k in range(len(yes))} | {"big", "copy", "note", "same"}
    assert got["copy"] == "large" and got["same"] == "notice" and got["y2"] == "lock"


def test_empty_tables(spark):
    assert not_handwritten(spark.createDataFrame([], FILES), spark.createDataFrame([], TEXTS)).count() == 0
