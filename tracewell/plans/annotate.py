"""Annotating an optimized plan with the row ids of the base tables.

`walk` rebuilds a plan so that beside its own output it carries, for each base-table occurrence, the id of
the row that each output row stems from. Selections, projections, sorts and joins just carry the ids on
(an outer join's missing side has null ids). An aggregate is a barrier: its values come from the plan as it
was (V), its witnesses from the annotated input (W), and both are joined on the grouping keys with null-safe
equality; so no row ever grows with its group, and no aggregate is computed on rows multiplied by witnesses.
Operators whose result depends on the number of rows (limit, window, ...) above such a join are barriers too,
joined on the identity of their input rows.

A recursive query is run to its end when it is annotated, level by level; a row of it has its own level's base
rows, and those of the rows that it was derived from, as witnesses of their own, ids of the other tables being null.

Modes: "left" takes a semi-join's, anti-join's or existence join's left side only; "full" also has the
witnesses on the right of semi-joins and existence joins, and those of uncorrelated scalar subqueries. What an anti-join
keeps has no match on its right, so no row there stands behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.checkpoints import cut
from tracewell.plans.catalyst import Catalyst
from tracewell.plans.nodes import PlanNode
from tracewell.sources.row_ids import with_row_ids


class UnsupportedPlan(ValueError):
    """A plan holds an operator for which no annotation rule is known."""


@dataclass
class RowIds:
    """The row ids of one base-table occurrence."""

    opid: int
    table: str
    attribute: Any


@dataclass
class Annotated:
    plan: Any
    row_ids: list[RowIds]
    identity: list[Any]
    #: Whether a row may stand there several times, once for each witness.
    multiplied: bool = False
    #: A further expression over the witnesses, if one was asked for.
    argument: Any | None = None
    #: Witnesses that are still to be joined with the rows.
    later: list[Later] = field(default_factory=list)

    @property
    def carried(self) -> list[Any]:
        return [x.attribute for x in self.row_ids] + self.identity


@dataclass
class Later:
    """An aggregate's annotated input with its grouping keys, and the attributes of the result's identity that equal them."""

    witnesses: Annotated
    keys: list[Any]
    identity: list[Any]


@dataclass
class Kept:
    """An operator's own rows, under its attributes, with an id each."""

    plan: Any
    row_ids: RowIds


@dataclass
class Loop:
    """A recursive query's rows (v0.., __level, __uid), and their witnesses (__level, __uid, l<opid>..), a row for each."""

    values: DataFrame
    witnesses: DataFrame
    sources: list[tuple[int, str]]


#: Operators through which rows pass one by one.
PASSING = {"Filter", "Sort", "SubqueryAlias", "Repartition", "RepartitionByExpression", "RebalancePartitions", "ResolvedHint", "View"}
#: Operators that count, order or draw rows, or make several of one.
LIMITS = {"GlobalLimit", "LocalLimit", "Offset", "Tail"}
COUNTING = LIMITS | {"Window", "WindowGroupLimit", "Sample", "Generate", "Expand"}
LEFT_ONLY = {"LEFT ANTI", "EXISTENCE"}
#: Joins by which rows of a side are left out or repeated, but never made up of nulls.
KEEPS_LEFT = {"INNER", "CROSS", "LEFT OUTER", "LEFT SINGLE", "LEFT SEMI", "LEFT ANTI", "EXISTENCE"}
KEEPS_RIGHT = {"INNER", "CROSS", "RIGHT OUTER"}


class Annotator:
    def __init__(self, cat: Catalyst, mode: str = "left", carry: list[Any] | None = None, kept: dict[int, Kept] | None = None):
        if mode not in ("left", "full"):
            raise ValueError("mode is left or full")
        self.cat, self.mode = cat, mode
        #: Attributes that projections must not drop, such as sort keys that aren't in the result.
        self.carry = carry or []
        #: By opid, operators whose rows are kept with an id each: they are read like tables.
        self.kept = dict(kept or {})
        self.loops: dict[int, Loop] = {}
        #: Where aggregates leave their witnesses that need not be joined with their rows at once.
        self.later: list[Later] | None = None

    def walk(self, n: PlanNode, witness: bool) -> Annotated:
        """With witness: every row with its row ids. Without: the plan's own rows, with an identity each."""
        if n.opid in self.kept:
            own = self.kept[n.opid]
            return Annotated(own.plan, [own.row_ids] if witness else [], [own.row_ids.attribute])
        if n.name == "OneRowRelation":
            return Annotated(n.node, [], [])
        if not n.children:
            return self._leaf(n, witness)
        rule = {"Project": self._project, "Join": self._join, "Aggregate": self._aggregate, "Union": self._union, "UnionLoop": self._loop}.get(n.name)
        if rule:
            return rule(n, witness)
        if n.name in PASSING or n.name in COUNTING:
            return self._passing(n, witness)
        raise UnsupportedPlan(f"no rule for {n.name} (operator {n.opid})")

    def root_witnesses(self, n: PlanNode, argument: Any | None = None) -> Annotated:
        """The root's witnesses for a join with its own rows on their identity, with the value of an expression over
        the input of that aggregate, if one is given. Where a chain of operators on
        single inputs leads from the root to an aggregate, that join does what theirs would do, and the aggregate's
        annotated input with its grouping keys is enough."""
        at = n
        while at.opid not in self.kept and (at.name in PASSING or at.name in COUNTING or at.name == "Project"):
            if self.mode == "full" and at.subqueries:
                break
            at = at.children[0]
        if at.name != "Aggregate" or at.opid in self.kept:
            if argument is not None:
                raise UnsupportedPlan("the query has no aggregate on top")
            return self._thin(n) or self.walk(n, True)
        if argument is not None and self._rewritten_distinct(at):
            raise UnsupportedPlan("distinct aggregates beside others have no single input row for a value")
        below, keys = self._aggregate_input(at)
        named = [self.cat.named(k, f"__w{i}") for i, k in enumerate(keys)]
        more = [self.cat.named(argument, "__argument")] if argument is not None else []
        plan = self.cat.project(named + more + [x.attribute for x in below.row_ids], below.plan)
        return Annotated(plan, below.row_ids, [self.cat.attribute(k) for k in named], True, *(self.cat.attribute(m) for m in more))

    def _thin(self, n: PlanNode) -> Annotated | None:
        """The root's own rows, with the witnesses of aggregates below its joins left for later, so that no row is
        multiplied before it has its number; None if something else multiplies rows."""
        with self._leaving([]):
            a = self.walk(n, True)
            a.later = list(self.later)
        return None if a.multiplied else a

    @contextmanager
    def _leaving(self, later: list[Later] | None) -> Iterator[None]:
        before, self.later = self.later, later
        try:
            yield
        finally:
            self.later = before

    def _side(self, n: PlanNode, witness: bool, keeps: bool) -> Annotated:
        """A join's side; one whose columns may become null joins its witnesses at once."""
        with self._leaving(self.later if keeps else None):
            return self.walk(n, witness)

    def sides(self, n: PlanNode) -> list[PlanNode]:
        """The inputs whose rows an operator's rows are traced to."""
        if n.opid in self.kept or n.name == "UnionLoop":
            return []
        kind = n.join_type.upper()
        left = kind.startswith("LEFT ANTI") or (kind in ("LEFT SEMI", "EXISTENCE") and self.mode != "full")
        return (n.children[:1] if left else n.children) + (n.subqueries if self.mode == "full" else [])

    def _leaf(self, n: PlanNode, witness: bool) -> Annotated:
        frame = with_row_ids(self.cat.frame(n.node), "__rid", n.name)
        plan = self.cat.analyzed(frame)
        rid = self.cat.output(plan)[-1]
        return Annotated(plan, [RowIds(n.opid, n.table, rid)] if witness else [], [rid])

    def _unique(self, attributes: list[Any], but: set[int] = frozenset()) -> list[Any]:
        seen, out = set(but), []
        for a in attributes:
            if self.cat.id_of(a) not in seen:
                seen.add(self.cat.id_of(a))
                out.append(a)
        return out

    def _with_subqueries(self, n: PlanNode, child: Annotated, witness: bool) -> Annotated:
        """In full mode the witnesses of scalar subqueries count for every row."""
        if not (witness and self.mode == "full"):
            return child
        for sub in n.subqueries:
            s = self._side(sub, True, False)
            side = self.cat.project([x.attribute for x in s.row_ids], s.plan)
            child = Annotated(self.cat.join(child.plan, side, "cross", None), child.row_ids + s.row_ids, child.identity, True)
        return child

    def _project(self, n: PlanNode, witness: bool) -> Annotated:
        child = self._with_subqueries(n, self.walk(n.children[0], witness), witness)
        own = self.cat.items(n.node.projectList())
        have = {self.cat.id_of(e) for e in own}
        below = {self.cat.id_of(a) for a in self.cat.output(child.plan)}
        more = self._unique(child.carried + [a for a in self.carry if self.cat.id_of(a) in below], have)
        return Annotated(self.cat.project(own + more, child.plan), child.row_ids, child.identity, child.multiplied)

    def _passing(self, n: PlanNode, witness: bool) -> Annotated:
        below = [n]  # limits stand in pairs, which only together know their sort
        while below[-1].name in LIMITS and below[-1].children[0].name in LIMITS:
            below.append(below[-1].children[0])
        child = self.walk(below[-1].children[0], witness)
        if n.name in COUNTING and child.multiplied:
            return self._barrier(n, child)
        if n.name == "Filter":
            child = self._with_subqueries(n, child, witness)
        if n.name == "Expand":
            plan = self.cat.expand(n.node, child.plan, self._unique(child.carried))
        elif n.name == "Sort":
            plan = self.cat.sort(n.node, child.plan, self._unique(child.identity))
        else:
            plan = child.plan
            for x in reversed(below):
                plan = self.cat.with_children(x.node, [plan])
        return Annotated(plan, child.row_ids, child.identity, child.multiplied)

    def _barrier(self, n: PlanNode, witnesses: Annotated) -> Annotated:
        """The operator over its input's own rows, joined with their witnesses on the rows' identity."""
        values = self._passing(n, False)
        return self._joined(values, witnesses, witnesses.identity, True)

    def _joined(self, values: Annotated, witnesses: Annotated, keys: list[Any], keyed: bool) -> Annotated:
        named = [self.cat.named(k, f"__w{i}") for i, k in enumerate(keys)]
        side = self.cat.project(named + [x.attribute for x in witnesses.row_ids], witnesses.plan)
        condition = self.cat.null_safe_equal(zip(values.identity, map(self.cat.attribute, named), strict=True))
        plan = self.cat.join(values.plan, side, "inner" if keyed else "cross", condition)
        plan = self.cat.project(self._unique(self.cat.output(values.plan) + [x.attribute for x in witnesses.row_ids]), plan)
        return Annotated(plan, witnesses.row_ids, values.identity, True)

    def _aggregate(self, n: PlanNode, witness: bool) -> Annotated:
        keys = self.cat.items(n.node.groupingExpressions())
        named = [self.cat.named(k, f"__k{i}") for i, k in enumerate(keys)]
        like = self.cat.with_children(n.node, [self.walk(n.children[0], False).plan]) if self.kept else n.node
        plain = self.cat.aggregate(keys, self.cat.items(n.node.aggregateExpressions()) + named, like)
        values = Annotated(plain, [], [self.cat.attribute(k) for k in named])
        if not witness:
            return values
        below, keys = self._aggregate_input(n)
        if keys and self.later is not None:
            self.later.append(Later(below, keys, values.identity))
            return values
        return self._joined(values, below, keys, bool(keys))

    def _aggregate_input(self, n: PlanNode) -> tuple[Annotated, list[Any]]:
        """An aggregate's annotated input, and the grouping keys over it."""
        with self._leaving(None):
            below, keys = self.walk(n.children[0], True), self.cat.items(n.node.groupingExpressions())
        if self._rewritten_distinct(n):  # there each input row stands once for every distinct aggregate
            attributes = [self.cat.named(k, f"__d{i}") for i, k in enumerate(keys)]
            once = self.cat.project(attributes + [x.attribute for x in below.row_ids], below.plan)
            below = Annotated(self.cat.distinct(once), below.row_ids, [], True)
            keys = [self.cat.attribute(a) for a in attributes]
        return below, keys

    def _rewritten_distinct(self, n: PlanNode) -> bool:
        inner = n.children[0]
        while inner.name in ("Project", "Filter") and inner.children:
            inner = inner.children[0]
        return inner.name == "Aggregate" and any(c.name == "Expand" for c in inner.children) and "gid" in inner.columns

    def _join(self, n: PlanNode, witness: bool) -> Annotated:
        left_node, right_node = n.children
        kind = n.join_type.upper()
        left = self._side(left_node, witness, kind in KEEPS_LEFT)
        if kind == "LEFT SEMI" and witness and self.mode == "full":
            right = self._side(right_node, True, False)
            plan = self.cat.join(left.plan, right.plan, "inner", self.cat.condition(n.node))
            return Annotated(plan, left.row_ids + right.row_ids, left.identity, True)
        if kind == "EXISTENCE" and witness and self.mode == "full":
            return self._existence(n, left, self._side(right_node, True, False))
        if kind == "LEFT SEMI" or any(kind.startswith(k) for k in LEFT_ONLY):
            return Annotated(self.cat.with_children(n.node, [left.plan, right_node.node]), left.row_ids, left.identity, left.multiplied)
        right = self._side(right_node, witness, kind in KEEPS_RIGHT)
        if "SINGLE" in kind and right.multiplied:
            plan = self.cat.join(left.plan, right.plan, "leftouter", self.cat.condition(n.node))
        else:
            plan = self.cat.with_children(n.node, [left.plan, right.plan])
        return Annotated(plan, left.row_ids + right.row_ids, left.identity + right.identity, left.multiplied or right.multiplied)

    def _existence(self, n: PlanNode, left: Annotated, right: Annotated) -> Annotated:
        """Every left row with the rows on the right for which it holds (null ids without any), under the
        attribute that says whether there is one."""
        there = self.cat.named(self.cat.literal_true(), "__there")
        side = self.cat.project([*self.cat.output(right.plan), there], right.plan)
        plan = self.cat.join(left.plan, side, "leftouter", self.cat.condition(n.node))
        exists = self.cat.named_as(self.cat.is_not_null(self.cat.attribute(there)), self.cat.existence_attribute(n.node))
        plan = self.cat.project([*self.cat.output(left.plan), exists, *(x.attribute for x in right.row_ids)], plan)
        return Annotated(plan, left.row_ids + right.row_ids, left.identity, True)

    def _union(self, n: PlanNode, witness: bool) -> Annotated:
        """Each branch has the others' row ids as nulls; the branch's number is part of the identity."""
        with self._leaving(None):
            branches = [self.walk(c, witness) for c in n.children]
        plans, row_ids, identity = [], [], []
        for i, (c, b) in enumerate(zip(n.children, branches, strict=True)):
            columns = list(self.cat.output(c.node))
            tag = self.cat.literal_long(i, "__branch")
            extra = [tag]
            for j, other in enumerate(branches):
                for what in [x.attribute for x in other.row_ids] + other.identity:
                    extra.append(self.cat.named(what, "__u") if i == j else self.cat.null_like(what, "__u"))
            if i == 0:
                made = iter([self.cat.attribute(e) for e in extra])
                identity.append(next(made))
                for other in branches:
                    row_ids += [RowIds(x.opid, x.table, next(made)) for x in other.row_ids]
                    identity += [next(made) for _ in other.identity]
            plans.append(self.cat.project(columns + extra, b.plan))
        return Annotated(self.cat.with_children(n.node, plans), row_ids, identity, any(b.multiplied for b in branches))

    def _loop(self, n: PlanNode, witness: bool) -> Annotated:
        if n.opid not in self.loops:
            with self._leaving(None):
                self.loops[n.opid] = self._run_loop(n)
        loop = self.loops[n.opid]
        *values, level, uid = self.cat.output(self.cat.analyzed(loop.values))
        names = [self.cat.named(level, "__level"), self.cat.named(uid, "__uid")]
        own = [self.cat.named_as(v, o) for v, o in zip(values, self.cat.output(n.node), strict=True)]
        plan = self.cat.project(own + names, self.cat.analyzed(loop.values))
        identity = [self.cat.attribute(x) for x in names]
        if not witness:
            return Annotated(plan, [], identity)
        level, uid, *ids = self.cat.output(self.cat.analyzed(loop.witnesses))
        keys, ids = [self.cat.named(level, "__wl"), self.cat.named(uid, "__wu")], [self.cat.named(i, "__rid") for i in ids]
        side = self.cat.project(keys + ids, self.cat.analyzed(loop.witnesses))
        ids = [self.cat.attribute(i) for i in ids]
        plan = self.cat.join(plan, side, "inner", self.cat.null_safe_equal(zip(identity, map(self.cat.attribute, keys), strict=True)))
        plan = self.cat.project([*self.cat.output(n.node), *identity, *ids], plan)
        return Annotated(plan, [RowIds(opid, table, i) for (opid, table), i in zip(loop.sources, ids, strict=True)], identity, True)

    def _run_loop(self, n: PlanNode) -> Loop:
        """The fixpoint; every level is kept, with a number for each row, and read like a table by the next."""
        anchor, recursion = n.children
        if n.node.limit().isDefined():
            raise UnsupportedPlan(f"no rule for a limit inside recursion (operator {n.opid})")
        refs = [x for x in recursion.walk() if x.name == "UnionLoopRef"]
        most = int(self.cat.spark.conf.get("spark.sql.cteRecursionLevelLimit", "100"))
        most = int(str(n.node.maxDepth().get())) if n.node.maxDepth().isDefined() else most
        sources: dict[int, str] = {x.opid: x.table for side in n.children for x in side.leaves()}
        values, witnesses, before = [], [], None
        for level in range(most + 1):
            side = anchor if level == 0 else recursion
            a = self.walk(side, True)
            if a.multiplied:
                raise UnsupportedPlan(f"no rule for aggregates inside recursion (operator {n.opid})")
            columns = [self.cat.named(o, f"v{k}") for k, o in enumerate(self.cat.output(side.node))] + [self.cat.named(x.attribute, f"l{x.opid}") for x in a.row_ids]
            rows = cut(self.cat.frame(self.cat.project(columns, a.plan)).withColumn("__uid", F.monotonically_increasing_id()))
            if rows.isEmpty():
                break
            here = [F.lit(level).alias("__level"), "__uid"]
            there = {x.opid for x in a.row_ids}
            own = rows.select(*here, *(F.col(f"l{o}") if o in there else F.lit(None).cast("long").alias(f"l{o}") for o in sources))
            for ref in refs if before is not None else []:
                up = before.select(F.col("__uid").alias("__parent"), *(f"l{o}" for o in sources))
                own = own.unionByName(rows.select("__uid", F.col(f"l{ref.opid}").alias("__parent")).join(up, "__parent").select(*here, *(f"l{o}" for o in sources)))
            before = cut(own.distinct())
            value_names = [f"v{k}" for k in range(len(self.cat.output(n.node)))]
            values.append(rows.select(*value_names, F.lit(level).alias("__level"), "__uid"))
            witnesses.append(before)
            for ref in refs:
                frame = rows.select(*value_names, "__uid")
                *own_values, uid = self.cat.output(self.cat.analyzed(frame))
                rid = self.cat.named(uid, "__rid")
                plan = self.cat.project([self.cat.named_as(v, o) for v, o in zip(own_values, self.cat.output(ref.node), strict=True)] + [rid], self.cat.analyzed(frame))
                self.kept[ref.opid] = Kept(plan, RowIds(ref.opid, "", self.cat.attribute(rid)))
        else:
            raise ValueError(f"recursion goes on after {most} levels (spark.sql.cteRecursionLevelLimit)")
        for ref in refs:
            self.kept.pop(ref.opid, None)
        if not values:
            empty = rows.select(*(f"v{k}" for k in range(len(self.cat.output(n.node)))), F.lit(0).alias("__level"), "__uid")
            return Loop(empty, rows.select(F.lit(0).alias("__level"), "__uid", *(F.lit(None).cast("long").alias(f"l{o}") for o in sources)), [*sources.items()])
        return Loop(reduce(DataFrame.unionByName, values), reduce(DataFrame.unionByName, witnesses), [*sources.items()])
