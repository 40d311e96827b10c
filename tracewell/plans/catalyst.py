"""Catalyst plans over py4j. No other module reaches into the JVM's planner.

Nodes and expressions are JVM objects; attributes are told apart by their expression ids, as Catalyst
does, never by name or position.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

CATALYST = "org.apache.spark.sql.catalyst"


class Catalyst:
    """Builds and reads logical plans of one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm = spark._jvm
        self.expressions = getattr(self.jvm.org.apache.spark.sql.catalyst, "expressions")
        self.logical = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        self.converters = self.jvm.scala.jdk.javaapi.CollectionConverters
        # looked up once: each look costs a few calls to the JVM
        self._alias, self._expression = self.expressions.Alias, self.expressions.NamedExpression
        self._project, self._none, self._empty = self.logical.Project, self._module(self.jvm.scala, "None"), self.seq([])
        self._parsed: dict[str, Any] = {}

    @staticmethod
    def _module(package, name: str):
        """A Scala object."""
        return getattr(getattr(package, f"{name}$"), "MODULE$")

    # sequences

    def seq(self, items: Iterable[Any]):
        out = self.jvm.java.util.ArrayList()
        for x in items:
            out.add(x)
        return self.converters.asScala(out).toSeq()

    def items(self, scala_seq) -> list[Any]:
        return [scala_seq.apply(i) for i in range(scala_seq.length())]

    # frames and plans

    def optimized(self, df: DataFrame):
        return df._jdf.queryExecution().optimizedPlan()

    def frame(self, plan) -> DataFrame:
        jdf = self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan)
        return DataFrame(jdf, self.spark)

    def analyzed(self, df: DataFrame):
        return df._jdf.queryExecution().analyzed()

    # reading nodes

    def kind(self, node) -> str:
        return node.getClass().getSimpleName().rstrip("$")

    def children(self, node) -> list[Any]:
        return self.items(node.children())

    def output(self, node) -> list[Any]:
        return self.items(node.output())

    def id_of(self, attribute) -> int:
        return attribute.exprId().id()

    def references(self, expression) -> list[Any]:
        return self.items(expression.references().toSeq())

    def scalar_subqueries(self, node) -> list[Any]:
        """Uncorrelated subqueries that stand as expressions in a node."""
        return [p for p in self.items(node.subqueries())]

    # building

    def named(self, expression, name: str):
        """The expression under a fresh expression id."""
        return self._alias(expression, name, self._expression.newExprId(), self._empty, self._none, self._empty)

    def named_as(self, expression, attribute):
        """The expression under an attribute's name and expression id."""
        return self._alias(expression, attribute.name(), attribute.exprId(), self._empty, self._none, self._empty)

    def attribute(self, alias):
        return alias.toAttribute()

    def null_long(self, name: str):
        return self.named(self._column_expression("cast(null as bigint)"), name)

    def literal_long(self, value: int, name: str):
        return self.named(self._column_expression(f"bigint({value})"), name)

    def literal_true(self):
        return self._column_expression("true")

    def is_not_null(self, expression):
        return self.expressions.IsNotNull(expression)

    def existence_attribute(self, join):
        """The attribute that an existence join adds to its left side."""
        return join.joinType().exists()

    def _column_expression(self, sql: str):
        if sql not in self._parsed:
            plan = self.spark.range(1).selectExpr(f"{sql} as x")._jdf.queryExecution().analyzed()
            self._parsed[sql] = plan.projectList().apply(0).child()
        return self._parsed[sql]

    def project(self, expressions: Iterable[Any], child):
        return self._project(self.seq(expressions), child)

    def with_children(self, node, children: Iterable[Any]):
        return node.withNewChildren(self.seq(children))

    def aggregate(self, grouping: Iterable[Any], outputs: Iterable[Any], like):
        """An Aggregate over like's child, with like's hint."""
        return self.logical.Aggregate(self.seq(grouping), self.seq(outputs), like.child(), like.hint())

    def null_safe_equal(self, pairs: Iterable[tuple[Any, Any]]):
        """left <=> right and ..., None without pairs."""
        out = None
        for a, b in pairs:
            one = self.expressions.EqualNullSafe(a, b)
            out = one if out is None else self.expressions.And(out, one)
        return out

    def join(self, left, right, kind: str, condition):
        option = self.jvm.scala.Option.apply(condition)
        join_type = self.jvm.org.apache.spark.sql.catalyst.plans.JoinType.apply(kind)
        return self.logical.Join(left, right, join_type, option, self.no_hint())

    def filter(self, condition, child):
        return self.logical.Filter(condition, child)

    def no_hint(self):
        return self._module(self.logical, "JoinHint").NONE()

    def join_kind(self, node) -> str:
        """INNER, CROSS, LEFT OUTER, LEFT SEMI, ..., EXISTENCE."""
        name = node.joinType().toString().split("(")[0]
        return "EXISTENCE" if name == "ExistenceJoin" else re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).upper()

    def condition(self, join):
        return join.condition().get() if join.condition().isDefined() else None

    def expand(self, node, child, more: Iterable[Any]):
        """The Expand over another child, with attributes that pass through every projection."""
        more = list(more)
        rows = [self.seq(self.items(p) + more) for p in self.items(node.projections())]
        return self.logical.Expand(self.seq(rows), self.seq(self.items(node.output()) + more), child)

    def sort(self, node, child, ties: Iterable[Any]):
        """The Sort over another child, ties in order of further attributes."""
        orders = self.items(node.order()) + [self.ascending(a) for a in ties]
        return self.logical.Sort(self.seq(orders), getattr(node, "global")(), child, node.hint())

    def ascending(self, attribute):
        return self.expressions.SortOrder(attribute, self._module(self.expressions, "Ascending"), self._module(self.expressions, "NullsFirst"), self._empty)

    def distinct(self, plan):
        return self.logical.Distinct(plan)

    def null_like(self, attribute, name: str):
        none = self.expressions.Literal(None, attribute.dataType())
        return self.named(none, name)

    def aggregate_arguments(self, aggregate) -> list[tuple[str, Any]]:
        """(function, argument) of each aggregate in the output of an Aggregate; a null argument counts for nothing."""
        out = []
        for e in self.items(aggregate.aggregateExpressions()):
            inner = e.child() if self.kind(e) == "Alias" else e
            if self.kind(inner) == "AggregateExpression":
                f = inner.aggregateFunction()
                out.append((self.kind(f), self.items(f.children())[0]))
        return out

    def equi_join(self, join) -> bool:
        """Whether a join's condition equates columns of both sides."""
        condition = self.condition(join)
        if condition is None:
            return False
        left, right = ({self.id_of(a) for a in self.output(c)} for c in self.children(join))
        todo = [condition]
        while todo:
            e = todo.pop()
            if self.kind(e) == "And":
                todo += self.items(e.children())
            elif self.kind(e) in ("EqualTo", "EqualNullSafe"):
                a, b = ({self.id_of(x) for x in self.references(c)} for c in self.items(e.children()))
                if a and b and ((a <= left and b <= right) or (a <= right and b <= left)):
                    return True
        return False

    def comparison(self, condition) -> tuple[Any, str, Any] | None:
        """(left, sign, right) of a condition that is one comparison by order."""
        signs = {"LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
        sign = signs.get(self.kind(condition)) if condition is not None else None
        return (condition.left(), sign, condition.right()) if sign else None

    def bytes_of(self, node) -> int:
        """Catalyst's estimate of a node's size."""
        return int(str(node.stats().sizeInBytes()))

    def row_bytes(self, node) -> int:
        return 8 + sum(a.dataType().defaultSize() for a in self.output(node))
