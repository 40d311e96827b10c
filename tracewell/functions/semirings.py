"""Evaluating a block as a provenance polynomial.

A block's row is a monomial, the product of its row ids; a result row's polynomial is the sum of its
monomials. A null id (an outer join's missing side, another branch of a union) is no factor.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT = "output_id"


def id_columns(block: DataFrame) -> list[str]:
    return [c for c in block.columns if c != OUT]


def variables(columns: list[str]) -> list[str]:
    """A variable for each column: the first letter of its table's name, numbered from 2 on if it repeats."""
    seen: Counter[str] = Counter()
    out = []
    for c in columns:
        v = c.split("_")[-1][0].lower()
        seen[v] += 1
        out.append(v if seen[v] == 1 else f"{v}{seen[v]}")
    return out


def formula(block: DataFrame) -> DataFrame:
    """(output_id, formula): monomials like l.3*o.7 joined by " + ", in order of their ids."""
    columns = id_columns(block)
    factors = [F.concat(F.lit(f"{v}."), F.col(c).cast("string")) for v, c in zip(variables(columns), columns, strict=True)]
    terms = block.select(OUT, F.struct(*columns, F.concat_ws("*", *factors).alias("term")).alias("t"))
    return terms.groupBy(OUT).agg(F.array_sort(F.collect_list("t")).alias("ts")).select(OUT, F.array_join(F.col("ts.term"), " + ").alias("formula"))


def poly_eval(block: DataFrame, model: str = "count", values: dict[str, DataFrame] | None = None) -> DataFrame:
    """(output_id, value): the polynomial with every id standing for 1, or for its value, if a column is named in
    values. count: the number of witnesses; formula: the polynomial itself; boolean, multiplicity, security and
    probability: as the functions of these names (multiplicity: `counted`)."""
    if model == "formula":
        return formula(block).withColumnRenamed("formula", "value")
    if model == "count":
        return block.groupBy(OUT).agg(F.count("*").alias("value"))
    models = {"boolean": boolean, "multiplicity": counted, "security": security, "probability": probability}
    if model not in models:
        raise ValueError(f"unknown model {model}")
    return models[model](block, values or {})


def _annotated(block: DataFrame, values: dict[str, DataFrame], unit: Column) -> tuple[DataFrame, list[Column]]:
    """The block with, for each column named in values, the value of its row. values: (rid, value) frames; a
    row without one, and a column that isn't named, count as the unit."""
    out, found = block, []
    for i, (c, v) in enumerate(values.items()):
        side = v.select(F.col("rid").alias(f"__r{i}"), F.col("value").alias(f"__v{i}"))
        out = out.join(side, F.col(c) == F.col(f"__r{i}"), "left")
        found.append(F.coalesce(F.col(f"__v{i}"), unit))
    return out, found


def boolean(block: DataFrame, values: dict[str, DataFrame]) -> DataFrame:
    """(output_id, value boolean): whether some witness has all its rows true."""
    rows, found = _annotated(block, values, F.lit(True))
    every = F.lit(True)
    for v in found:
        every = every & v
    return rows.groupBy(OUT).agg(F.bool_or(every).alias("value"))


def counted(block: DataFrame, values: dict[str, DataFrame]) -> DataFrame:
    """(output_id, value long): the sum over witnesses of the product of their rows' multiplicities."""
    rows, found = _annotated(block, values, F.lit(1))
    product = F.lit(1).cast("long")
    for v in found:
        product = product * v
    return rows.groupBy(OUT).agg(F.sum(product).alias("value"))


def security(block: DataFrame, values: dict[str, DataFrame]) -> DataFrame:
    """(output_id, value): the least clearance that sees a result row, the highest level in its easiest witness."""
    rows, found = _annotated(block, values, F.lit(0))
    level = F.greatest(*found) if len(found) > 1 else [*found, F.lit(0)][0]
    return rows.groupBy(OUT).agg(F.min(level).alias("value"))


def probability(block: DataFrame, values: dict[str, DataFrame]) -> DataFrame:
    """(output_id, value double): the chance that some witness is there, witnesses taken as independent; a
    witness's chance is the product of its rows'."""
    rows, found = _annotated(block, values, F.lit(1.0))
    product = F.lit(1.0)
    for v in found:
        product = product * v
    missing = F.when(product >= 1, F.lit(float("-inf"))).otherwise(F.log1p(-product))
    return rows.groupBy(OUT).agg((F.lit(1.0) - F.exp(F.sum(missing))).alias("value"))


def filtered_counts(block: DataFrame, column: str, base: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(output_id, one long for each predicate, total long): how many witnesses have a row of base (with rid)
    that the predicate holds for."""
    rows = block.join(base, block[column] == base["rid"])
    sums = [F.sum(p.cast("int")).cast("long").alias(n) for n, p in predicates.items()]
    return rows.groupBy(OUT).agg(*(F.coalesce(s, F.lit(0)).alias(n) for s, n in zip(sums, predicates, strict=True)), F.count("*").alias("total"))


def where_provenance(block: DataFrame, column: str, base: DataFrame, value: str) -> DataFrame:
    """(output_id, rid, value): the cells of base's column that stand behind each result row."""
    return block.join(base, block[column] == base["rid"]).select(OUT, "rid", F.col(value).alias("value")).distinct()
