"""Explaining outliers: deletions of rows by attribute values, scored by how they mend the bad outputs and
leave the good ones alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.checkpoints import cut
from tracewell.plans.block import frame_bytes, with_output_ids

AGGREGATES = ("count", "sum", "avg", "stddev")


def _value(kind: str, n: Column, s: Column, q: Column) -> Column:
    """An aggregate from the number, sum and sum of squares of what is left."""
    if kind == "count":
        return n.cast("double")
    if kind == "sum":
        return F.when(n > 0, s)
    if kind == "avg":
        return F.when(n > 0, s / n)
    if kind == "stddev":
        return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1))))
    raise ValueError(f"aggregates that can be taken back are {AGGREGATES}")


def _sums(rows: DataFrame, keys: Sequence[str], value: str, sets: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(output_id, keys, n, s, q[, g]): number, sum and sum of squares by output and combination; with sets of keys, by
    each of them in one pass, g telling which."""
    x = F.col(value).cast("double")
    given = rows.select("output_id", *(F.col(k).cast("string").alias(k) for k in keys), x.alias("__x"))
    sums = [F.count("__x").alias("n"), F.sum("__x").alias("s"), F.sum(F.col("__x") * F.col("__x")).alias("q")]
    if not sets:
        return given.groupBy("output_id", *keys).agg(*sums).na.fill(0, ["s", "q"])
    each = [["output_id", *s] for s in sets]
    return given.groupingSets(each, "output_id", *keys).agg(*sums, F.grouping_id().alias("g")).na.fill(0, ["s", "q"])


def _without(sums: DataFrame, names: Mapping[str, str], aggregate: str, outputs: Sequence[int]) -> DataFrame:
    """(keys, predicate, g0..gk): the aggregate of each output without what each combination of keys sums up to."""
    keys = [*names]
    totals = sums.groupBy("output_id").agg(*(F.sum(c).alias(f"t{c}") for c in "nsq"))
    wide = sums.groupBy(*keys).agg(*(F.sum(F.when(F.col("output_id") == o, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k, o in enumerate(outputs) for c in "nsq"))
    of = totals.agg(*(F.sum(F.when(F.col("output_id") == o, F.col(f"t{c}")).otherwise(0)).alias(f"t{c}{k}") for k, o in enumerate(outputs) for c in "nsq"))
    left = wide.crossJoin(F.broadcast(of))  # one row
    results = [_value(aggregate, *(F.col(f"t{c}{k}") - F.col(f"{c}{k}") for c in "nsq")).alias(f"g{k}") for k in range(len(outputs))]
    text = F.concat_ws(" AND ", *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(k), F.lit("NULL"))) for k, n in names.items()))
    return left.select(*keys, text.alias("predicate"), *results)


def numbered(rows: DataFrame, aggregate: str, value: str, outputs: Sequence[int], names: Mapping[str, str], read: int = 0) -> DataFrame:
    """(pid long, predicate string, g0..gk double): for each combination of values of the columns in names (each with what
    it is called), the aggregate of each of the outputs without the rows that have it. rows: (output_id, value,
    columns). They are summed by combination in one pass, and taken from their output's total; pid is the place
    in order of the values. read: the size of what the rows come from."""
    found = _without(_sums(rows.where(F.col("output_id").isin([*outputs])), [*names], value), names, aggregate, outputs)
    placed = with_output_ids(found, [F.col(k).asc_nulls_first() for k in names], "pid", read)
    return placed.select("pid", "predicate", *(f"g{k}" for k in range(len(outputs))))


def _traced(block: DataFrame, column: str, base: DataFrame, value: str, attributes: Sequence[str], outputs: Sequence[int]) -> tuple[DataFrame, dict[str, str]]:
    """(output_id, x, a0, a1, ...) and the attribute behind each a."""
    rows = block.where(F.col("output_id").isin([*outputs])).select("output_id", F.col(column).alias("rid")).join(base, "rid")
    names = {f"a{i}": a for i, a in enumerate(attributes)}
    return rows.select("output_id", F.col(value).alias("x"), *(F.col(a).alias(k) for k, a in names.items())), names


def whatif(block: DataFrame, column: str, base: DataFrame, aggregate: str, value: str, outputs: Sequence[int], spec: Sequence[str]) -> DataFrame:
    """`numbered` for a column of a table (base, with rid) and attributes of the same table."""
    rows, names = _traced(block, column, base, value, spec, outputs)
    return numbered(rows, aggregate, "x", outputs, names, frame_bytes(base))


def _score(good: Sequence[float], bad: Sequence[float]) -> Column:
    change = F.array(*(F.pow(F.abs(F.col(f"g{i}") - F.lit(float(v))), F.lit(0.5)) for i, v in enumerate(good)))
    fall = F.array_sort(F.array(*(F.pow(F.coalesce(F.lit(float(v)) - F.col(f"g{i + len(good)}"), F.lit(0.0)), F.lit(2.0)) for i, v in enumerate(bad))))
    median = (F.element_at(fall, (len(bad) - 1) // 2 + 1) + F.element_at(fall, len(bad) // 2 + 1)) / 2
    mean_good, mean_bad = sum(good) / len(good), sum(bad) / len(bad)
    return median / mean_bad / len(bad) - F.array_max(F.filter(change, lambda x: x.isNotNull())) / mean_good


def score(results: DataFrame, good: Sequence[float], bad: Sequence[float], top: int | None = 10) -> DataFrame:
    """(pid, score): results has g0.. for the good outputs, then the bad ones. The median squared fall of the bad
    outputs over their mean and number, less the largest root of a good output's change over their mean."""
    scored = results.select("pid", _score(good, bad).alias("score"))
    return scored if top is None else scored.orderBy(F.desc("score"), "pid").limit(top)


def search(block: DataFrame, column: str, base: DataFrame, aggregate: str, value: str, good: dict[int, float], bad: dict[int, float], specs: Sequence[Sequence[str]], top: int = 10) -> DataFrame:
    """(spec, predicate, score): the best predicates over all specs. good, bad: output ids and their values. The block is
    read once, for all specs; what is kept are its sums by combination."""
    outputs = [*good, *bad]
    rows, names = _traced(block, column, base, value, [*dict.fromkeys(a for s in specs for a in s)], outputs)
    key = {a: k for k, a in names.items()}
    sums, found = cut(_sums(rows, [*names], "x", [[key[a] for a in s] for s in specs])), None
    for spec in specs:
        keys = {key[a]: a for a in spec}
        # the grouping's number: a bit for each column of the pass that isn't grouped by, the first one highest
        g = int("".join("0" if k in keys else "1" for k in names), 2)
        best = _without(sums.where(F.col("g") == g), keys, aggregate, outputs).withColumn("score", _score([*good.values()], [*bad.values()]))
        best = best.orderBy(F.desc("score"), *(F.col(k).asc_nulls_first() for k in keys)).limit(top)
        best = best.select(F.lit(",".join(spec)).alias("spec"), "predicate", "score")
        found = best if found is None else found.unionByName(best)
    return found.orderBy(F.desc("score"), "spec", "predicate").limit(top)
