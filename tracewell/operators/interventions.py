"""What-if deletions over a block: dense (predicates as bit masks) and sparse (each row has one code).

Sparse methods read (out, eq_predicate, range_predicate), a row for each witness of an output. The nested
ones try each of n interventions on each row; the others use that a row belongs to one intervention and
that counts can be taken back. Nested work is bounded: each row meets n codes, which must be a small number
(NESTED_LIMIT), in one pass without a shuffle of the copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.plans.block import frame_bytes, with_output_ids

NESTED_LIMIT = 3_000
NESTED_LIMIT_2D = 100
BITS = 64


# dense


def target_matrix(base: DataFrame, predicates: list[str]) -> DataFrame:
    """(iid, mask_0, mask_1, ...): bit j of mask i is whether predicate 64 * i + j holds. base has rid."""
    masks = []
    for i in range(0, len(predicates), BITS):
        bits = (f"shiftleft(if({p}, 1L, 0L), {j})" for j, p in enumerate(predicates[i : i + BITS]))
        masks.append(F.expr(" | ".join(bits)).alias(f"mask_{i // BITS}"))
    return base.select(F.col("rid").alias("iid"), *masks)


def predicate_catalog(spark: SparkSession, predicates: list[str]) -> DataFrame:
    """(i int, j int, pred string): the number of the mask's first predicate, the bit, the predicate."""
    rows = [(k // BITS * BITS, k % BITS, p) for k, p in enumerate(predicates)]
    return spark.createDataFrame(rows, "i int, j int, pred string")


def dense_whatif(block: DataFrame, column: str, matrix: DataFrame, base: DataFrame, value: Column, predicates: DataFrame, top: int | None = 3) -> DataFrame:
    """(out, mid, k, v, pred): the sum of value over an output's rows that predicate k of mask mid holds for;
    of each mask the `top` largest. Rows are summed by their masks first, before a shuffle; the bits
    are taken apart on those sums, not on rows."""
    joined = block.select(F.col("output_id").alias("out"), F.col(column).alias("iid")).where("iid is not null").join(matrix, "iid").join(base.withColumnRenamed("rid", "iid"), "iid")
    masks = [c for c in matrix.columns if c != "iid"]
    summed = joined.groupBy("out", *masks).agg(F.sum(value).alias("v"))
    parts = None
    for mid, mask in enumerate(masks):
        bits = summed.groupBy("out", mask).agg(F.sum("v").alias("v")).select("out", mask, "v", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("k"))
        held = F.expr(f"bit_get({mask}, k) = 1")
        one = bits.groupBy("out", F.lit(mid).alias("mid"), "k").agg(F.sum(F.when(held, F.col("v")).otherwise(F.lit(0))).alias("v"))
        parts = one if parts is None else parts.unionByName(one)
    named = parts.join(F.broadcast(predicates), (F.col("i") == F.col("mid") * BITS) & (F.col("j") == F.col("k"))).select("out", "mid", "k", "v", "pred")
    if top is None:
        return named
    best = Window.partitionBy("mid").orderBy(F.desc("v"), "out", "k")
    return named.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).drop("place")


# sparse


def dictionary(base: DataFrame, column: str) -> DataFrame:
    """(val, code int): distinct values in order, null last, numbered from 0; those of large tables by ranges over
    many tasks."""
    values = base.select(F.col(column).alias("val")).distinct()
    return with_output_ids(values, [F.col("val").asc_nulls_last()], "code", frame_bytes(base)).withColumn("code", F.col("code").cast("int"))


def dictionary_encode(base: DataFrame, columns: list[str]) -> DataFrame:
    """(iid, <column>_int, ...) of base, which has rid."""
    out = base
    for c in columns:
        side = dictionary(base, c).select(F.col("val").alias(f"__v_{c}"), F.col("code").alias(f"{c}_int"))
        out = out.join(side, F.col(c).eqNullSafe(F.col(f"__v_{c}")), "left")
    return out.select(F.col("rid").alias("iid"), *(f"{c}_int" for c in columns))


def sparse_matrix(block: DataFrame, column: str, codes: DataFrame, eq: str, range_: str) -> DataFrame:
    """(out, eq_predicate, range_predicate) from a block and dictionary codes (iid, ...)."""
    rows = block.select(F.col("output_id").alias("out"), F.col(column).alias("iid")).join(codes, "iid")
    return rows.select("out", F.col(eq).alias("eq_predicate"), F.col(range_).alias("range_predicate"))


def _per_code(tm: DataFrame, keys: list[str]) -> DataFrame:
    return tm.groupBy("out", *keys).agg(F.count("*").alias("v"))


def _checked(n: int, limit: int) -> None:
    if not 0 < n < limit:
        raise ValueError(f"nested methods take fewer than {limit} interventions")


def _each(n: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def nested_equality(tm: DataFrame, n: int) -> DataFrame:
    """(out, k, kept): rows left of each output if those with code k go. Rows are counted by code first, so
    what is tried against all k are distinct codes, not rows."""
    _checked(n, NESTED_LIMIT)
    tried = _per_code(tm, ["eq_predicate"]).select("out", "eq_predicate", "v", _each(n, "k"))
    return tried.groupBy("out", "k").agg(F.sum(F.when(F.col("k") != F.col("eq_predicate"), F.col("v")).otherwise(0)).alias("kept"))


def single_pass_equality(tm: DataFrame) -> DataFrame:
    """(out, eq_predicate, kept): the same for codes that occur, as total - removed."""
    removed = _per_code(tm, ["eq_predicate"])
    total = F.sum("v").over(Window.partitionBy("out"))
    return removed.select("out", "eq_predicate", (total - F.col("v")).alias("kept"))


def nested_range(tm: DataFrame, n: int) -> DataFrame:
    """(out, k, kept): rows left of each output if those with a code of at most k go."""
    _checked(n, NESTED_LIMIT)
    tried = _per_code(tm, ["range_predicate"]).select("out", "range_predicate", "v", _each(n, "k"))
    return tried.groupBy("out", "k").agg(F.sum(F.when(F.col("range_predicate") > F.col("k"), F.col("v")).otherwise(0)).alias("kept"))


def prefix_range(tm: DataFrame) -> DataFrame:
    """(out, range_predicate, kept): the same for codes that occur, as total - running sum within the output."""
    counts = _per_code(tm, ["range_predicate"])
    total = F.sum("v").over(Window.partitionBy("out"))
    upto = F.sum("v").over(Window.partitionBy("out").orderBy("range_predicate").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select("out", "range_predicate", (total - upto).alias("kept"))


def prefix_equality_range(tm: DataFrame) -> DataFrame:
    """(out, eq_predicate, range_predicate, removed, kept): rows with this code and a range code of at most that."""
    counts = _per_code(tm, ["eq_predicate", "range_predicate"])
    total = F.sum("v").over(Window.partitionBy("out"))
    upto = F.sum("v").over(Window.partitionBy("out", "eq_predicate").orderBy("range_predicate").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select("out", "eq_predicate", "range_predicate", upto.alias("removed"), (total - upto).alias("kept"))


def nested_equality_range(tm: DataFrame, n: int) -> DataFrame:
    """(out, k, rk, removed, kept): the same for all pairs of codes. Counts of a code meet the range codes from their
    own on, at most n, and the pairs that nothing is removed for are added by output, not by row."""
    _checked(n, NESTED_LIMIT_2D)
    counts = _per_code(tm, ["eq_predicate", "range_predicate"])
    hit = counts.where(F.col("eq_predicate").between(0, n - 1) & F.col("range_predicate").between(0, n - 1))
    from_own = F.explode(F.sequence(F.col("range_predicate"), F.lit(n - 1))).alias("rk")
    removed = hit.select("out", F.col("eq_predicate").alias("k"), "v", from_own).groupBy("out", "k", "rk").agg(F.sum("v").alias("removed"))
    totals = counts.groupBy("out").agg(F.sum("v").alias("total"))
    pairs = totals.select("out", "total", _each(n, "k")).select("*", _each(n, "rk")).select("out", F.col("k").cast("int").alias("k"), F.col("rk").cast("int").alias("rk"), "total")
    gone = F.coalesce("removed", F.lit(0))
    return pairs.join(removed, ["out", "k", "rk"], "left").select("out", "k", "rk", gone.alias("removed"), (F.col("total") - gone).alias("kept"))
