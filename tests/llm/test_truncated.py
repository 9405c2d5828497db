import random

import numpy as np
import pytest

from tessera.common import Stage
from tessera.llm.closing import ending
from tessera.llm.truncated import SIMILAR, anchor, anchors, cut_copies, end_of, ends_early, may_end_early, shingles, truncated

ENDS = ["the index waits for the lock", "every reader skips the old rows", "a writer keeps the second copy", "the cache drops the last chunk"]


def test_states_of_an_end():
    assert [ending(t)[0] for t in ("", " \n", "Done.", "so on…", "so we �", "x\n```py\na = 1", "see `a", "It was [cut, 12 characters left]", "and then", "x\n```\na\n```", "完成。")] == [
        "blank", "blank", "closed", "dots", "broken", "inside", "inside", "omitted", "open", "closed", "closed"
    ]


def test_the_end_of_a_copy():
    long = "The index waits for the lock and the reader skips the old rows of the table. Then it goes on.\nNext line here."
    assert ends_early(long[:60], long) and not ends_early(long[: long.index("\n")], long) and not ends_early(long, long)
    assert not ends_early("", long)


def test_limits_copies_and_closing_words(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice(ENDS).capitalize() + "." for _ in range(n))
    whole = [(k, text(3 + k % 7), "wiki", "c") for k in range(60)] + [(100 + k, text(4) + "\n\n-- the team", "Wiki ", "c") for k in range(20)]
    limit = [(200 + k, (text(20) + " tail")[:300], "note", "c") for k in range(20)]
    cut = [(300 + k, text(3) + " " + " ".join(rnd.choice(ENDS).split()[:3]), None, "c") for k in range(4)]
    long = text(30)
    rows = whole + limit + cut + [(400, long + " The cache drops the last chunk.", "x", "c"), (401, long + " The cache dro", "x", "c"), (500, None, "x", "c"), (501, "  ", "x", "c"), (400, long + " The cache drops the last chunk.", "x", "c")]
    got = {r.doc_id: r.cut for r in truncated(spark.createDataFrame(rows, "doc_id long, text string, source string, cut string")).collect()}
    assert 500 not in got and not got[501] and not got[400] and got[401]
    assert [r[:2] for r in whole if got[r[0]]] == []
    assert all(got[r[0]] for r in cut)
    assert all(got[r[0]] == (not r[1].rstrip().endswith(".")) for r in limit)


def test_what_rules_out_a_partner():
    long = "The index waits for the lock.\n-- the team\nA writer (it keeps the second copy) skips rows\n  ```\nx"
    for end in range(1, len(long) + 1):
        tail = end_of(long[:end])
        assert not ends_early(long[:end], long) or may_end_early(tail) and anchor(tail) in anchors(long)
    assert may_end_early("x        ```") and not may_end_early("it\n   ```") and not may_end_early("rows.)") and not may_end_early("")
    assert anchor("short") == 0 and anchors("abc").tolist() == [0]


def _copies():
    """Texts of several families; the longest of each end in another way than those that others of the family are the beginnings of."""
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    rows = []
    for _ in range(3):
        base = " ".join(say(12) for _ in range(60))
        last = say(12)
        rows += [base + " " + last, (base + " " + last)[: len(base) + 18], (base + " " + last)[: len(base) + 11], base.replace("w1", "v1", 1) + " " + last[:16]]
        rows += [base + " " + say(9) + "\n" + " ".join(say(3) for _ in range(2)) for _ in range(25)]
        rows += [base + "\n\n-- the team" + str(k) for k in range(6)]
    return rows + ["Fix it", "fix  it", "Fix it now", " ", "yes", "yes …"] + [say(20) for _ in range(20)]


@pytest.mark.parametrize(("crowd", "block"), [(200, 1000), (2, 3), (2, 1000), (20, 4)])
def test_the_longest_of_a_bucket_hides_no_other_partner(spark, crowd, block):
    texts = _copies()
    sets = [shingles(t) for t in texts]
    want = set()
    for k, short in enumerate(texts):
        for n, long in enumerate(texts):
            both = len(np.intersect1d(sets[k], sets[n]))
            if len(short) < len(long) and both >= SIMILAR * (len(sets[k]) + len(sets[n]) - both) and ends_early(short, long):
                want.add(k)
    assert len(want) >= 9
    frame = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    got = [r.h for r in cut_copies(frame, Stage(spark, "test"), crowd, block).collect()]
    assert sorted(got) == sorted(want)


def test_an_empty_table(spark):
    assert truncated(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
