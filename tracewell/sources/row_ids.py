"""Row ids: a row's 0-based place in its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Up to so many files their first row ids are broadcast, a path and a number each.
BROADCAST_FILES = 100_000


def with_row_ids(df: DataFrame, name: str, kind: str = "LogicalRelation") -> DataFrame:
    """df with a last column of row ids. df must be a bare source of the named kind of leaf.

    Parquet: the file's row index, in a table of several files after the rows of the files before it in
    order of path. A range: the place in it. Values in memory: their place. Other sources: the place in order of
    partitions, which holds as long as the source deals its rows out alike each time it is read."""
    if kind == "LogicalRelation" and _has_row_index(df):
        files = df.inputFiles()
        if len(files) <= 1:
            return df.select("*", F.col("_metadata.row_index").alias(name))
        starts = _file_starts(df)
        side = F.broadcast(starts) if len(files) <= BROADCAST_FILES else starts
        placed = df.select("*", F.col("_metadata.row_index").alias("__at"), F.col("_metadata.file_path").alias("__file"))
        placed = placed.join(side, "__file", "left")
        return placed.select(*(placed[c] for c in df.columns), (F.col("__at") + F.col("__start")).alias(name))
    if kind == "Range":
        plan = df._jdf.queryExecution().analyzed()
        return df.select("*", F.expr(f"(`{df.columns[0]}` - {plan.start()}L) div {plan.step()}L").alias(name))
    if kind == "LocalRelation":
        return df.select("*", (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).cast("long").alias(name))
    return _by_partition(df, name)


def _has_row_index(df: DataFrame) -> bool:
    try:
        df.select("_metadata.row_index")
    except Exception:  # not a file source, or a format without row indexes
        return False
    return True


def _file_starts(df: DataFrame) -> DataFrame:
    """(__file, __start): one row a file."""
    counts = df.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))


def _by_partition(df: DataFrame, name: str) -> DataFrame:
    marked = df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__mono"))
    counts = marked.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__mono").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = marked.join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return placed.select(*(marked[c] for c in df.columns), (F.col("__mono") - F.col("__first") + F.col("__start")).alias(name))
