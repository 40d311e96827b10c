"""What the operators share: reading tables, ids, column names, Arrow batches cut to a size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.checkpoints import cut, cut_local

#: The bytes that part words and are stripped from lines: space and \t \n \v \f \r.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: What stands for a null id inside an operator; it sorts below every other id.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, *names: str) -> None:
    """Raise when a column is missing or stands twice in a table (letter case aside)."""
    have = [c.lower() for c in df.columns]
    for n in names:
        if have.count(n.lower()) != 1:
            raise ValueError(f"column {n!r} must stand once in {df.columns}")


def id_column(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("long"), F.lit(NULL_ID))


def null_id_back(c: Column) -> Column:
    return F.when(c != F.lit(NULL_ID), c)


def pieces_of(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings hold about most_bytes, or one row."""
    at = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's strings, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def by_place(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with columns c0, c1, ..., so that no name can meet another; those names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), names


def place_of(df: DataFrame, name: str) -> str:
    return f"c{[c.lower() for c in df.columns].index(name.lower())}"


__all__ = ["ASCII_SPACE", "NULL_ID", "by_place", "cut", "cut_local", "id_column", "need", "null_id_back", "pieces_of", "place_of", "table", "texts"]
