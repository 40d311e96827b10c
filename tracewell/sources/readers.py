"""Reading the kinds of input that the workloads use."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, fill: dict[str, Any] | None = None, schema: str | None = None) -> DataFrame:
    """A CSV file with a header. fill: what stands for null, by column. Types are inferred in a pass of its
    own unless a schema is given."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.na.fill(fill) if fill else df


def register(spark: SparkSession, folder: str, *tables: str) -> None:
    """Parquet tables of a folder as views under their names."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
