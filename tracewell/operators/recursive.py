"""Recursive queries by a fixpoint on the driver, with the rows that each result stems from: every path with its
edges (`reachable_paths`, as many as there are), or every pair with the edges behind it (`reachable_edges`)."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.checkpoints import cut

#: Rounds that are kept as one checkpoint, so that the plan doesn't grow with each round.
TOGETHER = 32


def reachable_paths(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(src, dst, depth int, edges array<long>) from edges (rid, src, dst): every path that passes no edge twice, with
    the row ids of its edges in order; with a depth, those of at most so many edges. Each round is a join of the
    last round's paths; rounds end when none is new, which the rule on edges makes sure of. Every fourth round is checkpointed."""
    path = edges.select("src", "dst", F.lit(1).alias("depth"), F.array("rid").alias("edges"))
    step = edges.select(F.col("src").alias("__from"), F.col("dst").alias("__to"), F.col("rid").alias("__rid"))
    kept, found = [], [path]
    for k in count(2):
        if depth is not None and k > depth:
            break
        longer = path.join(step, F.col("dst") == F.col("__from")).where(~F.array_contains("edges", F.col("__rid")))
        path = longer.select("src", F.col("__to").alias("dst"), F.lit(k).alias("depth"), F.concat("edges", F.array("__rid")).alias("edges"))
        if k % 4 == 0:
            path = cut(path)
        if path.isEmpty():
            break
        found.append(path)
        if len(found) == TOGETHER:
            kept.append(cut(reduce(DataFrame.unionByName, found)))
            found = []
    return reduce(DataFrame.unionByName, kept + found)


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst, depth int): the pairs with a path, and the edges on the shortest. Only new pairs are joined on in a
    round, so the work follows the pairs, not the paths; rounds end when none is new."""
    step = edges.select(F.col("src").alias("__from"), F.col("dst").alias("__to")).distinct()
    known = new = cut(edges.select("src", "dst", F.lit(1).alias("depth")).distinct())
    for k in count(2):
        farther = new.join(step, F.col("dst") == F.col("__from")).select("src", F.col("__to").alias("dst")).distinct()
        new = cut(farther.join(known.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(k).alias("depth")))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))


def reachable_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, rid) from edges (rid, src, dst): the edges that stand behind each pair with a path, those that its
    start reaches, or begins with, and from which its end is reached."""
    pairs = reachable(edges).select("src", "dst")
    points = edges.select(F.col("src").alias("p")).union(edges.select("dst")).distinct()
    up_to = pairs.unionByName(points.select(F.col("p").alias("src"), F.col("p").alias("dst"))).distinct()
    up_to = cut(up_to)
    before = up_to.select(F.col("src").alias("start"), F.col("dst").alias("__a"))
    after = up_to.select(F.col("src").alias("__b"), F.col("dst").alias("end"))
    through = edges.join(before, F.col("src") == F.col("__a")).select("start", "rid", F.col("dst").alias("at")).join(after, F.col("at") == F.col("__b"))
    return through.select(F.col("start").alias("src"), F.col("end").alias("dst"), "rid").distinct()
