"""Composing an annotated plan into a block: output_id and one row-id column for each table occurrence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import takewhile
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.checkpoints import cut
from tracewell.plans.annotate import Annotated, Annotator, Kept, Later, RowIds
from tracewell.plans.catalyst import Catalyst
from tracewell.plans.nodes import PlanNode

#: Results that may be larger than this get their ids by ranges over many tasks instead of one window.
ONE_WINDOW_BYTES = 256 << 20
#: Up to so many rows of a result that is kept, their ids are broadcast to the witnesses.
BROADCAST_ROWS = 100_000
#: Where more rows of a result than HEAVY share an aggregate's group, the group's witnesses are dealt over a part for each HEAVY, up to PARTS.
HEAVY, PARTS = 256, 64
#: Large results of joins without equal columns are numbered by counts, if the side that comes last in their order measures at most
#: so much, as it is broadcast; up to so many pairs are tried in a task.
PAIRS_BROADCAST_BYTES, PAIRS_A_TASK = 128 << 20, 1 << 28
#: Up to so many rows alike in what leads the order are joined as an array, which each of a group's parts has; the pairs of more are sorted.
ALIKE_ROWS = 256


@dataclass
class _Sides:
    """A result's columns under plain names: p payload, s sort keys, i identity, l row ids."""

    frame: DataFrame
    payload: list[str]
    sort: list[Column]
    identity: list[str]
    row_ids: list[str]


def _root_sort(cat: Catalyst, n: PlanNode) -> Any | None:
    while n.name in ("Project", "GlobalLimit", "LocalLimit", "Offset") and n.children:
        n = n.children[0]
    return n.node if n.name == "Sort" and getattr(n.node, "global")() else None


def _named(cat: Catalyst, root: PlanNode, a: Annotated, sort: Any | None, values: bool = True) -> _Sides:
    orders = cat.items(sort.order()) if sort is not None and values else []
    groups = {"p": cat.output(root.node) if values else [], "s": [o.child() for o in orders], "i": a.identity, "l": [x.attribute for x in a.row_ids]}
    columns = [cat.named(e, f"{g}{k}") for g, es in groups.items() for k, e in enumerate(es)]
    if a.argument is not None:
        columns.append(cat.named(a.argument, "argument"))
    frame = cat.frame(cat.project(columns, a.plan))
    keys = []
    for k, o in enumerate(orders):
        c = F.col(f"s{k}")
        first = "FIRST" in o.nullOrdering().sql().upper()
        down = o.direction().sql().upper().startswith("DESC")
        keys.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    names = lambda g: [f"{g}{k}" for k in range(len(groups[g]))]
    return _Sides(frame, names("p"), keys, names("i"), names("l"))


def _orderable(frame: DataFrame, columns: list[str]) -> list[str]:
    kinds = dict(frame.dtypes)
    return [c for c in columns if "map<" not in kinds[c] and "variant" not in kinds[c]]


def frame_bytes(frame: DataFrame) -> int:
    """Catalyst's estimate of a frame's size."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def most_bytes(cat: Catalyst, n: PlanNode) -> int:
    """What an operator's result may measure: of a join on equal columns as much as both sides, of one on other conditions
    their product, of a limit its rows, of a recursion the rows that Spark allows."""
    if n.name == "UnionLoop":  # Spark itself ends a recursion with more rows
        return int(cat.spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000")) * cat.row_bytes(n.node)
    if not n.children:
        return cat.bytes_of(n.node)
    sizes = [most_bytes(cat, c) for c in n.children]
    if n.name == "Join":
        if n.join_type.upper().startswith(("LEFT SEMI", "LEFT ANTI", "EXISTENCE")):
            return sizes[0]
        if cat.equi_join(n.node):
            return sum(sizes)
        rows = [max(1, size // cat.row_bytes(c.node)) for size, c in zip(sizes, n.children, strict=True)]
        return rows[0] * rows[1] * cat.row_bytes(n.node)
    if n.name in ("GlobalLimit", "LocalLimit"):
        limit = str(n.node.limitExpr())
        return min(sizes[0], int(limit) * cat.row_bytes(n.node)) if limit.isdigit() else sizes[0]
    if n.name == "Aggregate" and not cat.items(n.node.groupingExpressions()):
        return cat.row_bytes(n.node)
    return sum(sizes)


def with_output_ids(frame: DataFrame, order: list[Any], name: str = "output_id", read: int = 0) -> DataFrame:
    """frame with 0-based places in an order. If it may be large (read bytes), it is dealt out by ranges of the order,
    numbered within each range, and each range starts after the rows of those before it."""
    if read <= ONE_WINDOW_BYTES:
        return frame.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__mono", F.monotonically_increasing_id())
    marked = cut(marked)  # ranges are drawn anew each time they are computed
    counts = marked.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__mono").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = marked.join(F.broadcast(starts), "__part")
    return placed.withColumn(name, F.col("__mono") - F.col("__first") + F.col("__start")).drop("__part", "__mono", "__first", "__start")


def _compared(cat: Catalyst, condition: Any | None, have: list[set[int]], first: int) -> tuple[list[Any] | None, str]:
    """What each side has in a condition that is one comparison of both, and its sign with the side `first` on the left."""
    left, sign, right = cat.comparison(condition) or (None, "", None)
    if not sign:
        return None, ""
    a, b = ({cat.id_of(x) for x in cat.references(e)} for e in (left, right))
    if not (a and b):
        return None, ""
    if a <= have[0] and b <= have[1]:
        found = [left, right]
    elif a <= have[1] and b <= have[0]:
        found = [right, left]
    else:
        return None, ""
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    return found, sign if found[first] is left else turned[sign]


def _compared_counts(major: DataFrame, minor: DataFrame, sign: str, read: int) -> DataFrame:
    """major (with __place and __value) with __n, the rows of minor that its __value is <, <=, > or >= than, where there are any:
    a row's place among both sides' values, less that among its own."""
    equal_first = sign in ("<", ">=")  # the rows of minor that come before one of major are less, or less or equal
    own = major.where("__value is not null").select("__value", F.lit(equal_first).alias("__after"), "__place")
    other = minor.where("__value is not null").select("__value", F.lit(not equal_first).alias("__after"), F.lit(None).cast("long").alias("__place"))
    order = [F.col(c).asc_nulls_first() for c in ("__value", "__after", "__place")]
    both = with_output_ids(own.unionByName(other), order, "__both", read).where("__place is not null").select("__place", "__both")
    alone = with_output_ids(own, order, "__own", read).select("__place", "__own")
    n = F.col("__both") - F.col("__own")
    if sign in ("<", "<="):
        n = F.lit(other.count()) - n
    return major.join(both, "__place").join(alone, "__place").withColumn("__n", n).where("__n > 0")


def _numbered_pairs(cat: Catalyst, annotator: Annotator, root: PlanNode, order: list[str]) -> DataFrame | None:
    """The result (p, i, l, output_id) of a join without equal columns, none of whose pairs is sorted or kept; None if it can't be had so.

    The side that the order starts with is put in order and dealt out by place, the other side is put in order and
    broadcast. The pairs are counted by what leads the order; run again, they come in order, and a task's places go up from
    its first one. Where several rows are alike in what leads, the other side's columns come between them: such a group is joined as
    one row, with each of the other side's runs of rows alike in those columns, and a pair of group and run unfolds in order. Only the
    pairs of rows alike in their next columns too, and those of very large groups or runs, are sorted."""
    join = root.children[0] if root.name == "Project" else root
    if join.name != "Join" or join.opid in annotator.kept or join.join_type.upper() not in ("INNER", "CROSS") or cat.equi_join(join.node):
        return None
    sides = [annotator.walk(c, True) for c in join.children]
    if any(s.multiplied for s in sides):
        return None
    own = {cat.id_of(e): e.child() for e in cat.items(root.node.projectList()) if cat.kind(e) == "Alias"} if root.name == "Project" else {}
    groups = {"p": [own.get(cat.id_of(x), x) for x in cat.output(root.node)], "i": [i for s in sides for i in s.identity], "l": [x.attribute for s in sides for x in s.row_ids]}
    columns = {f"{g}{k}": e for g, es in groups.items() for k, e in enumerate(es)}
    have = [{cat.id_of(x) for x in cat.output(s.plan)} for s in sides]
    used = {c: {cat.id_of(x) for x in cat.references(e)} for c, e in columns.items()}
    where = {c: next((k for k in (0, 1) if ids <= have[k]), None) for c, ids in used.items()}
    order = [c for c in order if used[c]]
    if None in where.values() or not order or not all(e.deterministic() for e in columns.values()):
        return None
    first = where[order[0]]
    condition = cat.condition(join.node)
    asked = {f"c{cat.id_of(x)}": x for x in cat.references(condition)} if condition is not None else {}
    lead = list(takewhile(lambda c: where[c] == first, order))
    between = list(takewhile(lambda c: where[c] != first, order[len(lead) :]))
    following = list(takewhile(lambda c: where[c] == first, order[len(lead) + len(between) :]))
    orders = lambda names: [F.col(c).asc_nulls_first() for c in names]

    compared, sign = _compared(cat, condition, have, first)

    def side(k: int) -> DataFrame:
        put = [cat.named(e, c) for c, e in columns.items() if where[c] == k] + [cat.named(x, c) for c, x in asked.items() if cat.id_of(x) in have[k]]
        put += [cat.named(compared[k], "__value")] if compared else []
        return cat.frame(cat.project(put, sides[k].plan))

    def renamed(frame: DataFrame) -> Any:
        own = zip(frame.columns, cat.output(cat.analyzed(frame)), strict=True)
        return cat.project([cat.named_as(x, asked[c]) if c in asked else x for c, x in own], cat.analyzed(frame))

    def pairs(major: DataFrame) -> DataFrame:
        return cat.frame(cat.join(renamed(major), renamed(F.broadcast(minor)), "inner", condition))

    minor, last = side(1 - first), [c for c in order if where[c] != first]
    tries = minor.count()
    values, minor = minor, minor.drop("__value")
    if tries * cat.row_bytes(cat.analyzed(minor)) > PAIRS_BROADCAST_BYTES:
        return None
    minor = cut(minor.orderBy(*orders(last)) if last else minor)
    placed = with_output_ids(side(first), orders([c for c in order if where[c] == first]), "__place", most_bytes(cat, join.children[first]))
    alike = Window.partitionBy(*lead)
    major = placed.withColumn("__group", F.min("__place").over(alike)).withColumn("__size", F.count("*").over(alike))
    major = major.withColumn("__same", F.count("*").over(Window.partitionBy(*lead, *following)))
    major = cut(major.withColumn("__deep", F.max("__same").over(alike) > 1).drop("__same"))
    most, runs = 1, None
    if not major.where("__size > 1 and not __deep").isEmpty():
        numbers = F.row_number().over(Window.orderBy(*orders(last))).alias("__nth"), F.dense_rank().over(Window.orderBy(*orders(between))).alias("__run")
        runs = cut(minor.select("*", *numbers))
        longest = runs.groupBy("__run").count().agg(F.max("count"), F.count("*")).first()
        most = min(ALIKE_ROWS, max(tries, 1 << 16) // max(1, longest[0] or 1))
    major = major.withColumn("__kind", F.when(F.col("__size") == 1, "row").when(F.col("__deep") | (F.col("__size") > most), "sorted").otherwise("group")).drop("__deep")
    rows = major.count()
    tasks = min(max(rows, 1), max(-(-rows * tries // PAIRS_A_TASK), 4 * cat.spark.sparkContext.defaultParallelism))
    in_task = max(1, -(-rows // tasks))
    task_of = lambda place: F.expr(f"cast({place} div {in_task} as int)")

    def dealt(frame: DataFrame, by: str = "__place") -> DataFrame:
        return cut(frame.withColumn("__task", task_of(by)).repartitionById(tasks, "__task").sortWithinPartitions("__place"))

    if compared:
        read = sum(most_bytes(cat, c) for c in join.children)
        counts = _compared_counts(major, values, sign, read).groupBy("__group", "__kind").agg(F.sum("__n").alias("__n"))
        major = major.drop("__value")
    else:
        counts = pairs(dealt(major).drop("__task")).groupBy("__group", "__kind").agg(F.count("*").alias("__n"))
    counts = cut(counts).withColumn("__from", task_of("__group"))
    before = Window.orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.groupBy("__from").agg(F.sum("__n").alias("__all")).select("__from", F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__base"))
    before = Window.partitionBy("__from").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__base") + F.coalesce(F.sum("__n").over(before), F.lit(0))
    before = Window.partitionBy("__from", "__kind").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("__n").over(before), F.lit(0))
    starts = counts.join(F.broadcast(bases), "__from").select("__group", start.alias("__start"), passed.alias("__passed"))
    kinds = {r[0] for r in counts.select("__kind").distinct().collect()}
    major = major.join(starts, "__group")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the task
    by_place = F.col("__start") + place - F.col("__passed")

    def of_rows() -> DataFrame:
        return pairs(dealt(major.where("__kind = 'row'"))).withColumn("output_id", by_place)

    def of_groups() -> DataFrame:
        """A group has a part for each of its rows, by ranges of runs, all in one task: Spark holds all pairs of one row of a join before
        it passes them on."""
        own = [c for c in major.columns if not c.startswith("__")]
        theirs, many = minor.columns, longest[0] > 1

        def listed(by: str, names: list[str]) -> Column:
            at = lambda x, y: F.when(x[by] < y[by], -1).when(x[by] > y[by], 1).otherwise(0)
            return F.array_sort(F.collect_list(F.struct(by, *names)), at)

        other = cut(runs.groupBy("__run").agg(listed("__nth", theirs).alias("__theirs")).orderBy("__run")) if many else runs.drop("__nth")
        of, n = F.col("__part"), F.col("__size")
        units = major.where("__kind = 'group'").groupBy("__group", "__size", "__start", "__passed").agg(listed("__place", own).alias("__own"))
        units = units.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("__place", F.col("__group") + of)
        units = units.withColumn("__above", F.floor(of * longest[1] / n)).withColumn("__upto", F.floor((of + 1) * longest[1] / n))
        found = dealt(units, "__group").join(F.broadcast(other), F.col("__run").between(F.col("__above") + 1, F.col("__upto")))
        kept = ["__start", "__passed"]
        found = found.select(*kept, *(["__theirs"] if many else theirs), F.explode("__own").alias("__one"))
        found = found.select(*kept, *(f"__one.{c}" for c in own), *([F.explode("__theirs").alias("__other")] if many else theirs))
        found = found.select(*kept, *own, *(f"__other.{c}" for c in theirs)) if many else found
        found = cat.frame(renamed(found) if condition is None else cat.filter(condition, renamed(found)))
        return found.withColumn("output_id", by_place)

    def of_sorted() -> DataFrame:
        number = F.row_number().over(Window.partitionBy("__group").orderBy(*orders(order))) - 1
        return pairs(dealt(major.where("__kind = 'sorted'"))).withColumn("output_id", F.col("__start") + number)

    out = [f().select(*columns, "output_id") for kind, f in (("row", of_rows), ("group", of_groups), ("sorted", of_sorted)) if kind in kinds or kind == "row" and not kinds]
    return reduce(DataFrame.unionByName, out)


def _with_witnesses(cat: Catalyst, rows: DataFrame, result: DataFrame, identity: list[str], late: Later, place: int, small: bool) -> DataFrame:
    """The numbered rows of a result, each with every witness of its group, their row ids as l<place>, l<place + 1>, ...

    A group of n rows and m witnesses has n * m rows here, however few the sides have: its witnesses are dealt over parts
    by n, and the rows are repeated for each part. Small results are broadcast instead."""
    keys = [f"w{k}" for k in range(len(identity))]
    ids = [f"l{place + k}" for k in range(len(late.witnesses.row_ids))]
    columns = [cat.named(e, c) for e, c in zip([*late.keys, *(x.attribute for x in late.witnesses.row_ids)], keys + ids, strict=True)]
    side = cat.frame(cat.project(columns, late.witnesses.plan))
    condition = F.lit(True)
    for c, k in zip(identity, keys, strict=True):
        condition = condition & F.col(c).eqNullSafe(F.col(k))
    if small:
        return side.join(F.broadcast(rows), condition).drop(*keys)
    groups = result.groupBy(*(F.col(c).alias(f"h{k}") for k, c in enumerate(identity))).agg(F.count("*").alias("__rows"))
    parts = F.least(F.ceil(F.col("__rows") / HEAVY), F.lit(PARTS)).cast("int")
    heavy = F.broadcast(groups.where(F.col("__rows") > HEAVY).withColumn("__parts", parts).drop("__rows"))  # a row for HEAVY of the result at most

    def dealt(frame: DataFrame, by: list[str]) -> DataFrame:
        same = F.lit(True)
        for k, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"h{k}"))
        return frame.join(heavy, same, "left").drop(*(f"h{k}" for k in range(len(by))))

    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))
    rows = dealt(rows, identity).withColumn("__part", every).drop("__parts")
    at = F.pmod(F.xxhash64(*ids), F.coalesce(F.col("__parts"), F.lit(1))).cast("int")
    side = dealt(side, keys).withColumn("__at", at).drop("__parts")
    return rows.join(side, condition & (F.col("__part") == F.col("__at"))).drop("__part", "__at", *keys)


def operator_edges(cat: Catalyst, root: PlanNode, mode: str = "left") -> list[tuple[PlanNode, int, str, DataFrame]]:
    """(operator, opid and table of a source, edges) for each source of each operator that materializes; edges are
    (out_rowid, in_rowid). A source is a table, or the next operator below that materializes, as LOGICAL_<name>.

    Operators below the root keep their rows in checkpoints, numbered from 0 in order of their identity (a join's by
    the ids of the rows joined, an aggregate's by its keys), so that the operator above reads them like a table and
    the root's rows have the ids they have in the block."""
    kept: dict[int, Kept] = {}
    out = []

    def visit(n: PlanNode) -> None:
        for c in Annotator(cat, mode).sides(n):
            visit(c)
        if not n.materializes or not n.children:
            return
        block, rows, columns = compose(cat, n, mode, kept, n is not root)
        if n is not root:
            attributes = list({cat.id_of(a): (k, a) for k, a in reversed([*enumerate(cat.output(n.node))])}.values())
            frame = cut(rows.select(*(f"p{k}" for k, _ in attributes), "output_id"))
            *values, rid = cat.output(cat.analyzed(frame))
            rid = cat.named(rid, "__rid")
            plan = cat.project([cat.named_as(v, a) for v, (_, a) in zip(values, attributes, strict=True)] + [rid], cat.analyzed(frame))
            kept[n.opid] = Kept(plan, RowIds(n.opid, f"LOGICAL_{n.name.upper()}", cat.attribute(rid)))
        for opid, table in columns:
            edges = block.select(F.col("output_id").alias("out_rowid"), F.col(f"opid_{opid}_{table}").alias("in_rowid"))
            out.append((n, opid, table, edges.where("in_rowid is not null").distinct()))

    visit(root)
    return out


def compose(cat: Catalyst, root: PlanNode, mode: str = "left", kept: dict[int, Kept] | None = None, by_identity: bool = False, keep: bool = False, argument: Any | None = None) -> tuple[DataFrame, DataFrame, list[tuple[int, str]]]:
    """The block, the result with its output_id (and columns p0, p1, ...), and (opid, table) of the block's
    columns after output_id. Rows of the result that no table row stands behind aren't in the block.

    keep: results whose rows may have several witnesses are computed and kept first, and the ids of small ones are
    broadcast, so that the witnesses are neither shuffled nor sorted; without, nothing runs until the block is read, and
    nothing is kept. kept: operators that are read like tables; by_identity: ids in order of the rows' identity
    alone; argument: an expression over the input of the aggregate on top, a last column `argument` of the block."""
    sort = _root_sort(cat, root)
    carry = [a for o in cat.items(sort.order()) for a in cat.references(o)] if sort is not None else []
    annotator = Annotator(cat, mode, carry, kept)
    a = annotator.root_witnesses(root, argument)
    row_ids = a.row_ids + [x for late in a.later for x in late.witnesses.row_ids]
    order_of = sorted(range(len(row_ids)), key=lambda k: row_ids[k].opid)
    columns = [(row_ids[k].opid, row_ids[k].table) for k in order_of]
    named = [F.col(f"l{k}").alias(f"opid_{row_ids[k].opid}_{row_ids[k].table}") for k in order_of]
    named += [F.col("argument")] * (argument is not None)
    values = _named(cat, root, annotator.walk(root, False) if a.multiplied else a, sort)
    by, order = _orderable(values.frame, values.payload + values.identity), values.sort
    if by_identity and values.identity:
        by, order = _orderable(values.frame, values.identity), []
    read = most_bytes(cat, root)
    numbered = None
    if read > ONE_WINDOW_BYTES and not (order or a.multiplied or a.later):
        numbered = _numbered_pairs(cat, annotator, root, by)
    if numbered is None:
        numbered = with_output_ids(values.frame, [*order, *(F.col(c).asc_nulls_first() for c in by)], read=read)
    if a.later:
        small = False
        if keep:
            numbered = numbered.persist()
            small = numbered.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        block, place = numbered, len(a.row_ids)
        for late in a.later:
            identity = [f"i{[cat.id_of(x) for x in a.identity].index(cat.id_of(y))}" for y in late.identity]
            block = _with_witnesses(cat, block, values.frame, identity, late, place, small and late is a.later[0])
            place += len(late.witnesses.row_ids)
        block = block.select("output_id", *named)
    elif not a.multiplied:
        block = numbered.select("output_id", *named)
    else:
        small = False
        if keep:
            numbered = numbered.persist()
            small = numbered.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        ids = numbered.select("output_id", *(F.col(c).alias(f"v_{c}") for c in values.identity))
        ids = F.broadcast(ids) if small else ids
        witnesses = _named(cat, root, a, sort, values=False)
        condition = F.lit(True)
        for c in values.identity:
            condition = condition & F.col(c).eqNullSafe(F.col(f"v_{c}"))
        block = (witnesses.frame.join(ids, condition) if values.identity else witnesses.frame.crossJoin(F.broadcast(ids))).select("output_id", *named)
    if columns:
        some = F.coalesce(*(F.col(f"`opid_{o}_{t}`") for o, t in columns)).isNotNull()
        block = block.where(some)
    return block, numbered, columns
