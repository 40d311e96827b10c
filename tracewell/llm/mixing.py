"""Mixing sources to target weights by capped water-filling.

Each source asks for its share, by weight, of `share` times all words; a source is clamped at
max_epochs times its words, and what is clamped off is shared out among the rest by weight until none
is above. As clamping only raises the others' level, the end is one water level: with sources in order
of cap / weight, the first k are clamped and the level is what remains over the weights that remain.
That level comes from running sums over the table of sources; for more than ORDERED_SOURCES of them, from sums over
bins of that order, the bin in which the level lies being cut into bins again until one ratio is left.

A source's target is taken as whole repetitions of every document, and for the fraction that remains
as the documents that come first in a seeded order (by the md5 of seed and id), until the remaining words
are used up; the document at the border gives only the words that are still missing. The border is
found from sums over bins of that order, so that no task sees a whole source; only the border's own bin
(a 4,096th of a source) is ordered row by row.

Defined results: a null text has no words; a null source is a source of its own, last in order; a null
id orders by its text; rows that tie in every column that orders them are alike, so that
whichever comes first the rows are the same; a source without words has the target 0; an empty table
gives an empty table; other columns of the input are not carried along by `mix`; `mixed_documents` keeps all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm._common import by_place, cut_local, need, place_of
from tracewell.plans.block import with_output_ids

WORD = r"[^\x20\x09-\x0D]+"
BINS_HEX = 3
#: Up to so many sources their table is broadcast; beyond, it is joined as Spark decides.
BROADCAST_SOURCES = 100_000
#: Up to so many sources (a row each) are put in order in one task.
ORDERED_SOURCES = 2_000_000
BINS = 1_024


def cycled(sources: DataFrame, weights: tuple[float, ...], n: int) -> DataFrame:
    """n sources (source, ...) with weight: by code point, null last, repeating."""
    order = [F.col("source").asc_nulls_last()]
    placed = with_output_ids(sources, order, "place", 0 if n <= ORDERED_SOURCES else 1 << 62)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    return placed.withColumn("weight", weight).drop("place")


def water_level(sources: DataFrame, total: float) -> float | None:
    """The level that fills sources (cap, weight, ratio) up to a total, each to level * weight or its cap; None if all
    are clamped. Bins of the ratios are collected with their sums, never sources."""
    low, high, weights = sources.agg(F.min("ratio"), F.max("ratio"), F.sum("weight")).first()
    below = clamped = 0.0  # weights and caps of the sources under the bin
    while low is not None:
        inside = sources.where(F.col("ratio").between(low, high))
        bin_ = F.least(F.floor((F.col("ratio") - low) / (high - low) * BINS), F.lit(BINS - 1)) if high > low else F.lit(0)
        bins = inside.groupBy(bin_.alias("bin")).agg(F.min("ratio").alias("low"), F.max("ratio").alias("high"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
        for r in bins.orderBy("bin").collect():
            if clamped + r["cap"] + r["high"] * (weights - below - r["weight"]) >= total:
                break
            clamped += r["cap"]
            below += r["weight"]
        else:
            return None
        if r["low"] == r["high"]:
            return (total - clamped) / (weights - below)
        low, high = r["low"], r["high"]
    return None


def targets(sources: DataFrame, share: float, max_epochs: float, n: int = 0) -> DataFrame:
    """n sources (source, source_size long, weight double) with target double. One row for each source; the table of up to
    ORDERED_SOURCES sources is ordered in one task."""
    if n > ORDERED_SOURCES:
        s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        s = cut_local(s.withColumn("ratio", F.col("cap") / F.col("weight")))
        level = water_level(s, float(s.agg(F.sum("source_size")).first()[0]) * share)
        filled = F.col("cap") if level is None else F.least("cap", F.lit(level) * F.col("weight"))
        return s.select("source", "source_size", "weight", filled.alias("target"))
    by_level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    # levels that a source's own cap allows fall from the first such source on, so the first is the highest
    s = s.select("*", total.alias("total"), F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("clamped"), F.sum("weight").over(every).alias("all_weight"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("clamped_weight"))
    s = s.withColumn("level", (F.col("total") - F.col("clamped")) / (F.col("all_weight") - F.col("clamped_weight")))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    filled = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "weight", filled.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size long, source_size long, target double, taken long) of each row."""
    return _taken(docs, weights, share, max_epochs, seed, id_col, text_col, source_col).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, mark, size, source_size, target, taken): mark is the hash of the text."""
    need(docs, id_col, text_col, source_col)
    size = F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long")
    # null ids go by their texts, else all of them would come to one place
    name = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(docs[text_col], F.lit("")))))
    order = F.md5(F.concat(F.lit(seed + ":"), name))
    rows = cut_local(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), F.xxhash64(docs[text_col]).alias("mark"), size.alias("size"), order.alias("place")))
    bins = cut_local(rows.groupBy("source", F.substring("place", 1, BINS_HEX).alias("bin")).agg(F.sum("size").alias("size")))
    n_sources = bins.select("source").distinct().count()
    sources = cycled(bins.groupBy("source").agg(F.sum("size").alias("source_size")), weights, n_sources)
    goal = targets(sources, share, max_epochs, n_sources)
    words = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    goal = goal.withColumn("whole", whole).withColumn("extra", words - F.col("whole") * F.col("source_size"))
    # the bin in which a source's remaining words run out, and the words before that bin
    upto = Window.partitionBy("source").orderBy("bin")
    summed = bins.withColumn("upto", F.sum("size").over(upto))
    same = F.col("g.source").eqNullSafe(F.col("b.source"))
    border = summed.alias("b").join(F.broadcast(goal).alias("g") if n_sources <= BROADCAST_SOURCES else goal.alias("g"), same)
    border = border.where("b.upto >= g.extra").groupBy("b.source").agg(F.min_by(F.struct("b.bin", (F.col("b.upto") - F.col("b.size")).alias("before")), "b.bin").alias("border"))
    plan = goal.alias("g").join(border.alias("b"), same, "left").select("g.*", "b.border.bin", "b.border.before")
    plan = cut_local(plan)
    side = F.broadcast(plan.alias("p")) if n_sources <= BROADCAST_SOURCES else plan.alias("p")
    joined = rows.alias("r").join(side, F.col("r.source").eqNullSafe(F.col("p.source")))
    joined = joined.select("r.id", "r.size", "r.source", "r.mark", "r.place", "p.source_size", "p.target", "p.whole", "p.extra", "p.bin", "p.before", F.substring("r.place", 1, BINS_HEX).alias("own_bin"))
    inside = joined.where("own_bin = bin")
    outside = joined.where("own_bin <> bin or bin is null")
    running = Window.partitionBy("source", "own_bin").orderBy("place", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("extra") - F.col("before") - (F.sum("size").over(running) - F.col("size"))
    inside = inside.withColumn("part", F.greatest(F.lit(0), F.least("size", left)))
    outside = outside.withColumn("part", F.when(F.col("own_bin") < F.col("bin"), F.col("size")).otherwise(F.lit(0)))
    every = inside.unionByName(outside)
    return every.select("id", "source", "mark", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as many times as its taken words hold it whole, the half and more of
    a document counting as one, documents without words once. Texts stay whole. Columns are those of docs."""
    taken = _taken(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1)).cast("int")
    reps = taken.groupBy("id", "source", "mark").agg(F.max(times).alias("times")).where("times > 0")
    placed, names = by_place(docs)
    own = [F.col(place_of(docs, id_col)), F.col(place_of(docs, source_col)), F.xxhash64(place_of(docs, text_col))]
    same = own[0].eqNullSafe(reps["id"]) & own[1].eqNullSafe(reps["source"]) & (own[2] == reps["mark"])
    joined = placed.join(reps, same)
    return joined.select(*names, F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(*names).toDF(*docs.columns)
