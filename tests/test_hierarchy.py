import random
from datetime import datetime

import pytest

from tessera.operators.hierarchy import descendants, hierarchy

SCHEMA = "id string, parent string, at timestamp"


def brute(up):
    """Of a parent map: {(ancestor, id): distance}, {id: (root, depth)}."""
    pairs, places = {}, {}
    for x in up:
        seen = [x]
        while up.get(seen[-1]) in up and up[seen[-1]] not in seen:
            seen.append(up[seen[-1]])
            pairs[seen[-1], x] = len(seen) - 1
        again = up.get(seen[-1])
        places[x] = (min(seen[seen.index(again) :]), -1) if again in seen else (seen[-1], len(seen) - 1)
    return pairs, places


def rows_of(spark, up):
    return spark.createDataFrame([(k, v, datetime(2024, 1, 1)) for k, v in up.items()], SCHEMA)


LOOPS = {"A": "B", "B": "A", "C": "B", "D": "C", "E": "F", "F": "G", "G": "E", "H": "G", "I": "I", "J": "I", "R": None, "S": "R", "T": "gone", "U": "T"}
rnd = random.Random(7)
RANDOM = {f"n{k}": f"n{rnd.randrange(44)}" if rnd.random() < 0.95 else None for k in range(40)}


@pytest.mark.parametrize("up", [LOOPS, RANDOM], ids=["loops", "random"])
def test_against_brute_force(spark, up):
    pairs, places = brute(up)
    placed = hierarchy(rows_of(spark, up)).cache()
    assert {r.id: (r.root_id, r.depth) for r in placed.collect()} == places
    got = descendants(placed).collect()
    assert len(got) == len(pairs) and {(r.ancestor_id, r.id): r.distance for r in got} == pairs
    count = {x: sum(a == x for a, _ in pairs) for x in up}
    assert {r.id: r.descendants for r in placed.collect()} == count
