import re

from tessera.llm.token_slices import token_slices


def test_tokens_count_each_path_once(spark):
    rows = [("s", "./a.py", "py", "x = foo(1)"), ("s", "a.py", "Python", "x = foo(1)"), ("t", "a.py", " PYTHON ", "ab ==b"), ("t", "b", None, None)]
    files = spark.createDataFrame(rows, "snapshot_id string, normalized_path string, language string, content string")
    snaps = spark.createDataFrame([("s", "w"), ("t", "w"), ("t", "w")], "snapshot_id string, workspace_id string")

    def tokens(text):
        found = re.findall(r"\w+|==|[=()]", text)
        return len(found) + -(-(len(text) - sum(map(len, found))) // 4)

    want = {("w", "python", 2, tokens("x = foo(1)") + tokens("ab ==b")), ("w", "unknown", 1, 0)}
    assert {tuple(r) for r in token_slices(files, snaps).collect()} == want
    assert token_slices(files.limit(0), snaps).collect() == []
