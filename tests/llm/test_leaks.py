import random

from tessera.llm.leaks import aligned, leaks
import numpy as np

WORDS = "anchor basket courier digest fragment gateway harbor invoice journal kettle lantern meadow orchard parcel quarry registry scanner ticket watcher window".split()


def sentence(rnd, n=24):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(n)) + "."


def test_whole_pieces_and_what_is_none(spark):
    rnd = random.Random(5)
    rule = "Keep the change small and explain it in one short note please."
    items = [(k, " ".join([sentence(rnd) for _ in range(4)] + [rule]), "x") for k in range(6)] + [(90, None, "x"), (91, "", "x"), (92, rule, "x")]
    own = items[0][1].split(". ")
    shuffled = own[0].split() + own[1].split()
    rnd.shuffle(shuffled)
    changed = " ".join("other" if k % 12 == 5 else w for k, w in enumerate(items[1][1].upper().split()))
    zh = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(120))
    items.append((7, zh, "x"))
    docs = [
        (1, "intro. " + items[0][1].replace(" ", "&nbsp;\n ") + " outro"),
        (2, changed),
        (3, f"{own[0]}\n\n{sentence(rnd)}\n\n{own[2]}"),
        (4, " ".join(shuffled)),
        (5, " ".join(own[1].split()[:9])),
        (6, rule * 3),
        (7, f"前言{zh[:40]}，{zh[40:75]}。"),
        (8, None),
        (9, ""),
        (10, sentence(rnd) * 4000 + items[2][1]),
    ]
    df, it = spark.createDataFrame(docs * 2, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, task string, share string")
    for block in (400_000, 500):
        got = leaks(df, it, block).collect()
        assert len(got) == len({(r.doc_id, r.item_id) for r in got})
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 0), (2, 1), (3, 0), (7, 7), (10, 2)}
    assert leaks(df.limit(0), it).count() == 0 and leaks(df, it.limit(0)).count() == 0


def test_alignment_against_brute_force():
    rnd = random.Random(3)
    for _ in range(40):
        a = [rnd.randrange(4) for _ in range(rnd.randrange(1, 14))]
        b = [rnd.randrange(4) for _ in range(rnd.randrange(1, 14))]
        same = aligned(np.array(a), np.array(b), 20)
        n, m = len(a), len(b)
        d = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
        # an alignment of that cost has at least so many equal letters
        assert same.sum() >= max(n, m) - d[n][m] and same.sum() <= min(n, m)
