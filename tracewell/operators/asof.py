"""As-of joins with row ids on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.block import frame_bytes, with_output_ids


def asof_pairs(left: DataFrame, right: DataFrame, key: str, time: str) -> DataFrame:
    """(left_rid, right_rid): for each row on the left the last on the right with the same key at or before
    it (of equal times the one with the largest rid; null if there is none). Both sides have rid.

    Both are laid into one frame and the last right row is carried forward: one shuffle and one sort by
    key, no pairs."""
    both = left.select(key, time, F.lit(1).alias("side"), "rid").unionByName(right.select(key, time, F.lit(0).alias("side"), "rid"))
    upto = Window.partitionBy(key).orderBy(time, "side", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last(F.when(F.col("side") == 0, F.col("rid")), ignorenulls=True).over(upto)
    return both.withColumn("right_rid", carried).where("side = 1").select(F.col("rid").alias("left_rid"), "right_rid")


def asof_rows(left: DataFrame, right: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """(output_id, left_rid, right_rid) of an inner as-of join; outputs in order of columns of the left side."""
    pairs = asof_pairs(left, right, key, time).where("right_rid is not null")
    rows = pairs.join(left.select(F.col("rid").alias("left_rid"), *order), "left_rid")
    return with_output_ids(rows, [*order, "left_rid"], read=frame_bytes(left)).select("output_id", "left_rid", "right_rid")
