import pytest

from tessera.llm.mixing import mixed, vocabulary

DOCS, TARGETS = "doc_id long, text string, source string, tokens int", "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("bin_rows", [1000, 7])
def test_shares_budgets_and_repeats(spark, bin_rows):
    docs = [(k, "word " * (1 + k % 9), "A" if k % 3 else " b ", 1) for k in range(300)] + [(900, None, "a", 1), (901, "", "a", 1), (902, "x y", None, 1), (903, "x y", "other", 1)]
    targets = [("a", 0.3, 2), ("B", 0.6, 3), ("none", 0.1, 5)]
    d, t = spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS)
    chosen, report = mixed(d, t, vocabulary(), bin_rows=bin_rows)
    rows, by = chosen.collect(), {r.source: r for r in report.collect()}
    assert len(rows) == len({r.doc_id for r in rows}) and {r.source for r in rows} == {"a", "b"}
    used = {s: sum(r.tokens * r.repeats for r in rows if r.source == s) for s in ("a", "b")}
    assert {s: by[s].used for s in used} == used and by["none"].used == 0
    total = min(2 * by["a"].tokens / 0.3, 3 * by["b"].tokens / 0.6)
    for s, share, most in (("a", 0.3, 2), ("b", 0.6, 3)):
        assert 0 <= share * total - used[s] <= 10 and max(r.repeats for r in rows if r.source == s) <= most
        assert abs(by[s].share - share / 0.9) < 0.01
    again = mixed(d.repartition(5), t, vocabulary(), bin_rows=bin_rows)[0]
    assert {(r.doc_id, r.repeats) for r in again.collect()} == {(r.doc_id, r.repeats) for r in rows}


def test_a_given_total_and_empty_tables(spark):
    d, t = spark.createDataFrame([(k, "word word", "a", 1) for k in range(50)], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixed(d, t, vocabulary(), total=20)[1].first().used == 20
    assert mixed(d.limit(0), t, vocabulary())[0].count() == 0 and mixed(d, t.limit(0), vocabulary())[0].count() == 0
