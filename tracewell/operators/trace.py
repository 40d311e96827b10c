"""Backward and forward traces, over blocks or over operator edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.checkpoints import cut
from tracewell.functions.semirings import OUT


def backward(block: DataFrame, outputs: list[int] | None = None) -> DataFrame:
    """(output_id, source, rids array<long>): for each result row and block column its distinct row ids."""
    rows = block if outputs is None else block.where(F.col(OUT).isin(outputs))
    columns = [c for c in block.columns if c != OUT]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).alias("rid")) for c in columns)))
    flat = rows.select(OUT, pairs.alias("p")).select(OUT, "p.source", "p.rid").where("rid is not null").distinct()
    return flat.groupBy(OUT, "source").agg(F.array_sort(F.collect_list("rid")).alias("rids"))


def forward(block: DataFrame, column: str, rids: list[int] | DataFrame) -> DataFrame:
    """(rid, output_id): the result rows that rows of a table contribute to. rids: few, or a frame of rid."""
    rows = block.select(F.col(column).alias("rid"), OUT)
    kept = rows.where(F.col("rid").isin(rids)) if isinstance(rids, list) else rows.join(rids.select("rid"), "rid", "left_semi")
    return kept.distinct()


def cross_filter(block: DataFrame, other: DataFrame, column: str, other_column: str, outputs: list[int]) -> DataFrame:
    """(output_id, n): of another query over the same table, the result rows that share rows with these outputs,
    and how many."""
    rids = block.where(F.col(OUT).isin(outputs)).select(F.col(column).alias("rid")).distinct()
    rows = other.select(F.col(other_column).alias("rid"), OUT).distinct().join(rids, "rid", "left_semi")
    return rows.groupBy(OUT).agg(F.count("*").alias("n"))


def _levels(edges: DataFrame) -> int:
    """The number of operators on the longest way down; as many rows are collected as a plan has operators."""
    below: dict[int, set[int]] = {}
    for r in edges.select("sink_opid", "source_opid").distinct().collect():
        below.setdefault(r["sink_opid"], set()).add(r["source_opid"])

    def deep(opid: int, above: frozenset[int]) -> int:
        if opid in above:
            raise ValueError(f"the edges of operator {opid} lead back to it")
        return 1 + max((deep(c, above | {opid}) for c in below.get(opid, ())), default=-1)

    return deep(-1, frozenset())


def end_to_end(edges: DataFrame) -> DataFrame:
    """(source_table, source_opid, out_rowid, prov array<long>) from operator edges: from the root's edges down,
    a join for each level of the plan; inner operators are not sources."""
    level = edges.where("sink_opid = -1").select("source_table", "source_opid", "out_rowid", "in_rowid")
    reached = level
    steps = edges.where("sink_opid <> -1").select(F.col("source_table").alias("t"), F.col("source_opid").alias("o"), "sink_opid", F.col("out_rowid").alias("mid"), F.col("in_rowid").alias("rid"))
    for _ in range(_levels(edges) - 1):
        inner = level.where("source_table like 'LOGICAL%'")
        level = inner.join(steps, (F.col("source_opid") == F.col("sink_opid")) & (F.col("in_rowid") == F.col("mid"))).select(F.col("t").alias("source_table"), F.col("o").alias("source_opid"), "out_rowid", F.col("rid").alias("in_rowid"))
        level = cut(level.distinct())
        reached = reached.unionByName(level)
    tables = reached.where("source_table not like 'LOGICAL%'").distinct()
    return tables.groupBy("source_table", "source_opid", "out_rowid").agg(F.array_sort(F.collect_list("in_rowid")).alias("prov"))
