from datetime import datetime

from tessera.operators.hierarchy import descendants, hierarchy
from tessera.operators.orphans import broken
from tessera.operators.snapshots import changes, snapshot_pairs

REFS, PARENTS = "table_name string, row_id string, key string, made_at timestamp, period string", "key string, alive boolean, at timestamp"
FILES, SNAPS = "snapshot_id string, normalized_path string, content_hash string, status string, created_at timestamp", "id string, workspace_id string, branch string, status string, created_at timestamp"


def at(day):
    return datetime(2024, 1, day)


def test_hierarchy_nulls_ties_empty_and_further_columns(spark):
    schema = "id string, parent string, at timestamp, n long, p string, depth int"
    rows = [("a", None, at(1), 1, "x", 9), ("b", "a", at(1), 1, "x", 9), ("b", "c", at(1), 1, "x", 9), ("c", "a", None, 1, "x", 9), ("c", None, at(1), 1, "x", 9), (None, "a", at(1), 1, "x", 9)]
    placed = hierarchy(spark.createDataFrame(rows, schema))
    assert {(r.id, r.parent, r.root_id, r.depth, r.descendants) for r in placed.collect()} == {("a", None, "a", 0, 0), ("b", "c", "c", 1, 0), ("c", None, "c", 0, 1)}
    assert hierarchy(spark.createDataFrame([], schema)).count() == 0
    assert descendants(hierarchy(spark.createDataFrame([], schema))).count() == 0


def test_broken_references(spark):
    parents = [("ok", True, at(1)), ("ok", True, at(9)), ("gone", False, at(1)), ("late", True, at(5)), ("late", False, at(1)), ("back", False, at(1)), ("back", True, at(2)), ("when", True, None), (None, True, at(1))]
    refs = [("t", k, k, at(3), "p") for k in ("ok", "gone", "late", "back", "when", "none")] + [("t", "tie", "late", at(5), "p"), ("t", "open", "late", None, None), ("t", "null", None, at(3), "p"), ("t", "none", "none", at(3), "p")]
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    want = {("gone", "deleted"), ("late", "late"), ("none", "missing")}
    for keys, rows in ((100, 100), (1, 1)):
        got = broken(r, p, keys, rows).collect()
        assert len(got) == len(want) and {(x.row_id, x.reason) for x in got} == want
    assert {x.reason for x in broken(r, p.limit(0)).collect()} == {"missing"}
    assert broken(r.limit(0), p).count() == 0


def test_changes_between_snapshots(spark):
    snaps = [("s1", "w", "m", "Active", at(1)), ("s2", "w", "m", "Superseded", at(2)), ("s2", "w", "m", "Superseded", at(2)), ("bad", "w", "m", "Failed", at(3)), ("s0", "w", None, "Active", at(3)), ("s3", "w", "m", "ActiveDegraded", at(4))]
    pairs = snapshot_pairs(spark.createDataFrame(snaps, SNAPS))
    assert {tuple(r) for r in pairs.collect()} == {("s2", "s1"), ("s3", "s2")}
    files = [("s1", "a", "sha256:AA", "Ok", at(1)), ("s1", "b", "b1", "Ok", at(1)), ("s1", "c", "c1", "Ok", at(1)), ("s1", "u", "pending", "Ok", at(1)), ("s1", "x\\y", "1", "Ok", at(1))]
    files += [("s2", "./a", "aa", "Ok", at(1)), ("s2", "b", "b2", "Ok", at(1)), ("s2", "c", "c1", "Ok", at(1)), ("s2", "c", "c1", "Deleted", at(2)), ("s2", "d", None, None, at(1)), ("s2", "u", "u1", "Ok", at(1)), ("s2", "x/y", "1", "Ok", at(1)), ("s2", None, "z", "Ok", at(1)), (None, "z", "z", "Ok", at(1))]
    f = spark.createDataFrame(files, FILES)
    want = {("s2", "b", "changed"), ("s2", "c", "removed"), ("s2", "d", "added")} | {("s3", p, "removed") for p in ("a", "b", "d", "u", "x/y")}
    got = changes(f, pairs).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert changes(f.limit(0), pairs).count() == 0 and changes(f, pairs.limit(0)).count() == 0
