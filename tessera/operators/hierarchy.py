"""Parent-child rows to full hierarchies, with loops told apart.

Loops come to light by peeling leaves: a node survives m rounds of peeling exactly if it is the m-th ancestor of some node, so
squaring the parent map peels 1, 2, 4, ... levels at once, and what no longer shrinks is the loops. The forest that is left when
the loops are cut is turned into Euler tours (an entry and an exit event per node); parallel list ranking by pointer doubling gives each
event its place in its tour, and from the entry-exit intervals follow depth, root, ancestors, paths and descendants.
Every step is a join on a unique 64-bit number; no group of siblings, no tree and no loop is ever gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import Stage, even_join

#: Siblings that are put in order within one window; a parent with more of them gets several windows, chained.
SIBLINGS = 50_000
#: Places of an interval are matched in blocks of at most 2 to this power, so that no block's rows outgrow a task.
LARGEST_BLOCK = 16
#: Tasks over which the rows of one loop are spread.
SALTS = 16


def _numbered(nodes: DataFrame, st: Stage) -> tuple[DataFrame, DataFrame]:
    """(n, id, parent) with a 64-bit number for each id, and the edges (n, p) between existing nodes."""
    base = st.keep(nodes.where("id is not null").groupBy("id").agg(F.max(F.struct("at", "parent")).alias("last")).select("id", F.col("last.parent").alias("parent"), F.monotonically_increasing_id().alias("n")))
    up = base.select(F.col("id").alias("parent"), F.col("n").alias("p"))
    edges = st.keep(even_join(base.where("parent is not null").select("n", "parent"), up, "parent", "n").select("n", "p"), n=F.count("*"))
    return base, edges


def _loops(edges: DataFrame, st: Stage) -> DataFrame | None:
    """The edges that lie on loops, by peeling; None if there are none."""
    jump, left = edges, edges.seen["n"]
    while left:  # the map of 1, 2, 4, ... steps; nodes that run out of parents leave it
        step = jump.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        nxt = st.keep(even_join(jump, step, "p", "n").select("n", F.col("pp").alias("p")), n=F.count("*"))
        if jump is not edges:
            st.drop(jump)
        jump, before, left = nxt, left, nxt.seen["n"]
        if left == before:
            break
    if not left:
        return None
    ring = st.keep(jump.select(F.col("p").alias("n")).distinct(), n=F.count("*"))
    while True:  # all are in or below loops now; go on until those below are peeled too
        step = jump.select(F.col("n").alias("p"), F.col("p").alias("pp"))
        before, jump = jump, st.keep(even_join(jump, step, "p", "n").select("n", F.col("pp").alias("p")))
        if before is not edges:
            st.drop(before)
        less = st.keep(jump.select(F.col("p").alias("n")).distinct(), n=F.count("*"))
        same = less.seen["n"] == ring.seen["n"]
        ring = less
        if same:
            return st.keep(edges.join(ring, "n", "left_semi"), n=F.count("*"))


def _loop_names(ring: DataFrame, base: DataFrame, st: Stage) -> DataFrame:
    """(n, least, place): for each loop node the smallest id of its loop and the steps up to it, by doubling."""
    cur = st.keep(ring.join(base.select("n", "id"), "n").select("n", "p", F.struct(F.col("id").alias("least"), F.lit(0).cast("long").alias("place")).alias("name")))
    for k in range(math.ceil(math.log2(ring.seen["n"] + 1))):
        other = cur.select(F.col("n").alias("p"), F.col("p").alias("pp"), F.struct(F.col("name.least").alias("least"), (F.col("name.place") + F.lit(2**k).cast("long")).alias("place")).alias("other"))
        nxt = st.keep(cur.join(other, "p").select("n", F.col("pp").alias("p"), F.least("name", "other").alias("name")))
        st.drop(cur)
        cur = nxt
    return cur.select("n", "name.least", "name.place")


def _siblings(tree: DataFrame) -> DataFrame:
    """(n, p, nxt, first): the children of each parent as a chain; a parent of very many children has its chain made in several windows."""
    many = tree.groupBy("p").agg(F.ceil(F.count("*") / SIBLINGS).alias("windows"))
    part = tree.join(many, "p").select("n", "p", F.pmod(F.xxhash64("n"), F.col("windows")).alias("w"))
    inside = Window.partitionBy("p", "w").orderBy("n")
    chained = part.select("n", "p", "w", F.lead("n").over(inside).alias("nxt"))
    heads = part.groupBy("p", "w").agg(F.min("n").alias("head"))
    order = Window.partitionBy("p").orderBy("w")
    heads = heads.select("p", "w", "head", F.lead("head").over(order).alias("after"), (F.row_number().over(order) == 1).alias("leads"))
    return chained.join(heads, ["p", "w"]).select("n", "p", F.coalesce("nxt", "after").alias("nxt"), (F.col("leads") & (F.col("n") == F.col("head"))).alias("first"))


def _ranked(base: DataFrame, tree: DataFrame, st: Stage) -> DataFrame:
    """(n, enter, exit, depth, r): intervals of the Euler tour of each node's tree and the number of its root."""
    kids = st.keep(_siblings(tree))
    firsts = kids.where("first").select(F.col("p").alias("n"), F.col("n").alias("child"))
    # event 2n enters n, 2n+1 leaves it
    enter = base.select("n").join(firsts, "n", "left").select((F.col("n") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("n") * 2 + 1).alias("nxt"), F.lit(1).alias("w"))
    leave = base.select("n").join(kids.select("n", "p", F.col("nxt").alias("sib")), "n", "left").select((F.col("n") * 2 + 1).alias("e"), F.coalesce(F.col("sib") * 2, F.col("p") * 2 + 1).alias("nxt"), F.lit(-1).alias("w"))
    # steps and sum: events, and their weights, from this one up to the next jump target; last: the end of the list as far as seen
    steps = F.when(F.col("nxt").isNull(), 0).otherwise(1).cast("long")
    open_ = F.count_if(F.col("nxt").isNotNull())
    cur = st.keep(enter.unionByName(leave).select("e", "nxt", steps.alias("steps"), F.col("w").cast("long").alias("sum"), F.col("e").alias("last")), open=open_)
    while cur.seen["open"]:
        moved = cur.where("nxt is not null")
        for _ in range(2):  # two further jumps a round
            other = cur.select(F.col("e").alias("nxt"), F.col("nxt").alias("nn"), F.col("steps").alias("s2"), F.col("sum").alias("sum2"), F.col("last").alias("last2"))
            moved = moved.join(other, "nxt", "left").select(
                "e", F.col("nn").alias("nxt"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), (F.col("sum") + F.coalesce("sum2", F.lit(0))).alias("sum"), F.coalesce("last2", "last").alias("last")
            )
        nxt = st.keep(cur.where("nxt is null").unionByName(moved), open=open_)
        st.drop(cur)
        cur = nxt
    pair = cur.groupBy(F.floor(F.col("e") / 2).cast("long").alias("n")).agg(
        F.max(F.when(F.col("e") % 2 == 0, F.col("steps"))).alias("enter_left"),
        F.max(F.when(F.col("e") % 2 == 1, F.col("steps"))).alias("exit_left"),
        F.max(F.when(F.col("e") % 2 == 0, -F.col("sum"))).alias("depth"),
        F.floor(F.max("last") / 2).cast("long").alias("r"),
    )
    out = st.keep(pair)
    st.drop(cur)
    return out


def hierarchy(nodes: DataFrame) -> DataFrame:
    """The place of each node in its tree.

    nodes: (id, parent, at). Of several rows with one id the one with the greatest ``at`` counts (of equal ones the greatest parent; a null
    ``at`` counts least); rows with null id are left out. A parent that is null or has no row makes the node a root.
    Returns (id, parent, root_id, depth, tree, enter, exit, descendants, depth_in, cyclic, place): ``enter``/``exit`` is the interval in the Euler tour of the tree, a node's
    descendants are those of the same ``tree`` whose interval lies within. For nodes in or below a loop depth is -1 and root_id the smallest id of
    the loop; their intervals belong to the tree that hangs on their loop node, which ``tree`` names, ``depth_in`` counts from it, and ``place`` is the number of
    steps from it up to root_id. A loop node (depth_in 0) is above every other row of its root_id, which ``descendants`` counts. An empty table gives an empty result; further columns are ignored.
    """
    spark = nodes.sparkSession
    st = Stage(spark, "hierarchy")
    base, edges = _numbered(nodes.select("id", "parent", "at"), st)
    ring = _loops(edges, st)
    tree = edges if ring is None else edges.join(ring.select("n"), "n", "left_anti")
    pos = _ranked(base, tree, st)
    # the tour's length is twice the root's subtree; places count from the tour's start
    trees = st.keep(pos.where("n = r").select("r", (F.col("enter_left") + 1).alias("length")).join(base.select(F.col("n").alias("r"), F.col("id").alias("tree")), "r"))
    if ring is not None:
        loops = _loop_names(ring, base, st).withColumnRenamed("n", "r")
        rows = loops.join(trees.select("r", "length"), "r").groupBy("least").agg((F.sum("length") / 2).cast("long").alias("loop_rows"))
        trees = trees.join(even_join(loops, rows, "least", "r"), "r", "left")
    else:
        trees = trees.select("*", F.lit(None).cast("string").alias("least"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("loop_rows"))
    # every row of a tree meets its one row here; a tree may hold most rows
    out = even_join(pos.join(base, "n"), trees, "r", "n")
    return out.select(
        "id",
        "parent",
        F.coalesce("least", "tree").alias("root_id"),
        F.when(F.col("least").isNotNull(), -1).otherwise(F.col("depth")).cast("int").alias("depth"),
        "tree",
        (F.col("length") - 1 - F.col("enter_left")).alias("enter"),
        (F.col("length") - 1 - F.col("exit_left")).alias("exit"),
        F.coalesce(F.when(F.col("n") == F.col("r"), F.col("loop_rows") - 1), ((F.col("enter_left") - F.col("exit_left") - 1) / 2).cast("long")).alias("descendants"),
        F.col("depth").cast("int").alias("depth_in"),
        F.col("least").isNotNull().alias("cyclic"),
        "place",
    )


def descendants(placed: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance) for each proper descendant, from the intervals of ``hierarchy``.

    Each interval is cut into its at most 2 log2 dyadic blocks and each node into the blocks that hold its entry, so containment becomes an equality join.
    Below a loop's node lie the other nodes of its loop and all that hangs on them; they come by a join on the loop's name. No node is its own descendant.
    """
    levels = F.least(F.ceil(F.log2(F.greatest(F.lit(2), F.col("exit") + 1))).cast("int"), F.lit(LARGEST_BLOCK))
    inner = placed.where("descendants > 0").select(F.col("id").alias("ancestor_id"), F.col("depth_in").alias("d0"), "tree", F.col("enter").alias("a"), F.col("exit").alias("z"), F.explode(F.sequence(F.lit(0), levels)).alias("k"))
    size = F.expr("shiftleft(1L, k)")
    lo, hi = F.floor((F.col("a") + 1 + size - 1) / size), F.floor(F.col("z") / size)
    blocks = inner.select("ancestor_id", "d0", "tree", "k", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("lo < hi")
    whole = F.sequence("lo", F.col("hi") - 1)
    blocks = blocks.select("ancestor_id", "d0", "tree", "k", F.explode(F.when(F.col("k") == LARGEST_BLOCK, whole).otherwise(F.array_compact(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 1, F.col("hi") - 1))))).alias("block"))
    top = F.least(F.ceil(F.log2(F.greatest(F.lit(2), F.col("enter") + 1))).cast("int") + 1, F.lit(LARGEST_BLOCK))
    points = placed.select("id", F.col("depth_in").alias("d1"), "tree", "enter", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    points = points.select("id", "d1", "tree", "k", F.expr("shiftright(enter, k)").alias("block"))
    within = blocks.join(points, ["tree", "k", "block"]).select("ancestor_id", "id", (F.col("d1") - F.col("d0")).cast("int").alias("distance"))
    return within.unionByName(_around(placed))


def _around(placed: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): each loop node with the other nodes of its loop and what is below those."""
    member = placed.where("cyclic and depth_in = 0").select("root_id", F.col("id").alias("ancestor_id"), F.col("place").alias("to"))
    member = member.join(member.groupBy("root_id").agg(F.count("*").alias("length")), "root_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    below = placed.where("cyclic").select("root_id", "id", "tree", "depth_in", "place", F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt"))
    return member.join(below, ["root_id", "salt"]).where("ancestor_id != tree").select("ancestor_id", "id", (F.col("depth_in") + F.expr("pmod(place - to, length)")).cast("int").alias("distance"))
