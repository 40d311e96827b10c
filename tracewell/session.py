"""The session: capture switches, the registry of captured queries, and what is read out of it."""

from __future__ import annotations

import ast
import logging
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import semirings
from tracewell.operators import explain, interventions
from tracewell.plans import nodes
from tracewell.plans.block import compose, operator_edges
from tracewell.plans.catalyst import Catalyst
from tracewell.sources.row_ids import with_row_ids

log = logging.getLogger(__name__)


class UnknownQuery(KeyError):
    """No captured query has this id."""


@dataclass
class Captured:
    query_id: int
    root: nodes.PlanNode
    frame: DataFrame
    block: DataFrame | None = None
    result: DataFrame | None = None
    columns: list[tuple[int, str]] = field(default_factory=list)
    kept: bool = False


class ProvenanceSession:
    """Row-level provenance for the queries of one SparkSession. Nothing is global to the process.

    With capture on, sql() and capture() record a query under the next query id, from 0 on. prepare_provenance(qid) composes its
    block; read_block(qid) gives it. The mode ("left" or "full", see plans.annotate) holds for later captures."""

    def __init__(self, spark: SparkSession, mode: str = "left"):
        self.spark, self.mode = spark, mode
        self.capturing, self.persisting, self.debugging = False, True, False
        self._cat = Catalyst(spark)
        self._queries: dict[int, Captured] = {}
        self._whatifs: dict[tuple[int, int], DataFrame] = {}
        self._last_whatif: tuple[int, int] | None = None
        self._values: dict[str, dict[str, DataFrame]] = {}

    # switches

    def set_provenance(self, on: bool) -> None:
        """Whether sql() captures; off at first."""
        self.capturing = bool(on)

    def set_persist_provenance(self, on: bool) -> None:
        """Whether prepared blocks, and the results that they were made from, are kept in memory and on disk; on at
        first. Off: nothing is kept, blocks are computed when read."""
        self.persisting = bool(on)

    def set_debug_provenance(self, on: bool) -> None:
        """Whether plans are logged before and after annotation."""
        self.debugging = bool(on)

    def clear_provenance(self) -> None:
        """Forget all queries and blocks; query ids begin at 0 again."""
        for q in self._queries.values():
            if q.kept and q.block is not None:
                q.block.unpersist()
            if q.kept and q.result is not None:
                q.result.unpersist()
        for found in self._whatifs.values():
            found.unpersist()
        self._queries.clear()
        self._whatifs.clear()
        self._values.clear()
        self._last_whatif = None

    def __enter__(self) -> ProvenanceSession:
        self.set_provenance(True)
        return self

    def __exit__(self, *_: object) -> None:
        self.set_provenance(False)

    # capture

    def sql(self, query: str) -> DataFrame:
        """Run a statement: a PRAGMA of this session, a query over its table functions (provenance_meta(), read_block(n),
        global_provenance(n), PolyEval(n, 'model'), ..._reader(n, aggregate), GetPredicates(pid)), or any Spark SQL, which
        is captured if capture is on; so is the query of a CREATE TABLE AS."""
        if m := re.fullmatch(r"\s*pragma\s+(\w+)\s*(?:\((.*)\))?\s*;?\s*", query, re.I | re.S):
            return self._pragma(m[1].lower(), m[2])
        text, views = self._with_views(query.strip().rstrip(";"))
        if self.capturing and not views and (m := re.fullmatch(r"create\s+table\s+([\w.`]+)\s+as\s+(.*)", text, re.I | re.S)):
            self.create_table_as(m[1], m[2])
            return self.spark.createDataFrame([], "ok boolean")
        df = self.spark.sql(text)
        if self.capturing and not views:
            self.capture(df)
        return df

    def _pragma(self, name: str, args: str | None) -> DataFrame:
        """Statements go by their first word; what follows set_, set_persist_, set_debug_, clear_ and prepare is free."""
        on = (args or "").strip().lower() in ("true", "1", "'true'")
        if name == "whatif":
            self._whatif_statement(args or "")
        elif name == "prepare_interventions":
            raise ValueError("prepare_interventions takes predicates by table: call it as a method")
        elif m := re.fullmatch(r"set_(persist_|debug_)?[a-z]+", name):
            {"persist_": self.set_persist_provenance, "debug_": self.set_debug_provenance, None: self.set_provenance}[m[1]](on)
        elif re.fullmatch(r"clear_[a-z]+", name):
            self.clear_provenance()
        elif re.fullmatch(r"prepare_?[a-z]+", name):
            self.prepare_provenance(int(args or ""))
        else:
            raise ValueError(f"unknown pragma {name}")
        return self.spark.createDataFrame([], "ok boolean")

    def _whatif_statement(self, args: str) -> None:
        """Whatif(query id, number of the aggregate, [output ids], ['table.column', ...]): kept for `..._reader` and GetPredicates."""
        try:
            qid, aggregate, outputs, spec = ast.literal_eval(f"({args},)")
        except (SyntaxError, ValueError, TypeError) as e:
            raise ValueError("Whatif(query id, aggregate, [output ids], ['table.column', ...])") from e
        found = self.whatif(qid, aggregate, [int(o) for o in outputs], [*spec], qualified=True)
        if old := self._whatifs.pop((qid, aggregate), None):
            old.unpersist()
        # a what-if is read by several statements, with the numbers of its predicates
        self._whatifs[qid, aggregate] = found.persist()
        self._last_whatif = (qid, aggregate)

    def whatif_result(self, qid: int, aggregate: int) -> DataFrame:
        """(pid, g0..gk): of the last Whatif statement for the query's aggregate."""
        if (qid, aggregate) not in self._whatifs:
            raise UnknownQuery((qid, aggregate))
        return self._whatifs[qid, aggregate].drop("predicate")

    def predicates(self, pid: int) -> DataFrame:
        """(predicate): of the last Whatif statement; table_column=value, joined by AND."""
        if self._last_whatif is None:
            raise UnknownQuery(pid)
        return self._whatifs[self._last_whatif].where(F.col("pid") == pid).select("predicate")

    def _with_views(self, query: str) -> tuple[str, int]:
        """Table functions of this session, replaced by views of what they give."""
        made = 0

        def read(m: re.Match) -> str:
            nonlocal made
            name, args = m[1].lower(), [x.strip() for x in re.split(r",", m[2])] if m[2].strip() else []
            number = lambda k: int(args[k]) if k < len(args) and args[k].isdigit() else max(self._queries, default=-1)
            if name.endswith("_meta"):
                frame = self.provenance_meta()
            elif name.endswith("_reader"):
                frame = self.whatif_result(number(0), int(args[1]))
            elif name == "getpredicates":
                frame = self.predicates(int(args[0]))
            elif name == "read_block":
                frame = self.read_block(number(0))
            elif name == "polyeval":
                frame = self.poly_eval(number(0), args[1].strip("'") if len(args) > 1 else "count")
            else:
                frame = self.global_provenance(number(0))
            made += 1
            view = f"__{name}_{made}"
            frame.createOrReplaceTempView(view)
            return view

        query = re.sub(r"\b([a-z]+_meta)\s*\(\s*()\)", read, query, flags=re.I)
        inner = r"(\s*(?:\d+|\(\s*select\s+max\s*\(\s*query_id\s*\)\s+from\s+\w+\s*\))?\s*(?:,\s*'?\w+'?\s*)?)"
        return re.sub(rf"\b(read_block|global_[a-z]+|polyeval|[a-z]+_reader|getpredicates)\s*\({inner}\)", read, query, flags=re.I), made

    def capture(self, df: DataFrame) -> int:
        """Record a query; its id."""
        plan = self._cat.optimized(df)
        qid = len(self._queries)
        if self.debugging:
            log.info("query %d before annotation:\n%s", qid, plan.toString())
        self._queries[qid] = Captured(qid, nodes.build(self._cat, plan), df)
        return qid

    def _query(self, qid: int) -> Captured:
        if qid not in self._queries:
            raise UnknownQuery(qid)
        return self._queries[qid]

    def prepare_provenance(self, qid: int) -> DataFrame:
        """Compose the block; doing so again changes nothing."""
        q = self._query(qid)
        if q.block is None:
            q.block, q.result, q.columns = compose(self._cat, q.root, self.mode, keep=self.persisting)
            if self.debugging:
                log.info("query %d after annotation:\n%s", qid, self._cat.optimized(q.block).toString())
            if self.persisting:
                q.block, q.kept = q.block.persist(), True
        return q.block

    def overhead(self, qid: int) -> None:
        """Run the annotated query and keep nothing, whatever the switch says."""
        compose(self._cat, self._query(qid).root, self.mode)[0].write.format("noop").mode("overwrite").save()

    def create_table_as(self, name: str, query: str) -> int:
        """Write a query's result as a table, and capture the query; its id."""
        df = self.spark.sql(query)
        qid = self.capture(df)
        df.write.saveAsTable(name.replace("`", ""))
        return qid

    def save_block(self, qid: int, path: str) -> None:
        """Write a block as Parquet."""
        self.read_block(qid).write.parquet(path)

    # reading

    def read_block(self, qid: int) -> DataFrame:
        """(output_id, opid_<n>_<table>...): a row for each witness of each result row; ids are 0-based."""
        return self.prepare_provenance(qid)

    def block_columns(self, qid: int, table: str | None = None) -> list[str]:
        """The block's row-id columns, in order of opid; those of one table if it is named."""
        self.prepare_provenance(qid)
        return [f"opid_{o}_{t}" for o, t in self._query(qid).columns if table in (None, t)]

    def base_rows(self, qid: int, column: str) -> DataFrame:
        """The table behind a block's column, with rid."""
        opid = int(column.split("_")[1])
        leaf = next(n for n in self._query(qid).root.leaves() if n.opid == opid)
        return with_row_ids(self._cat.frame(leaf.node), "rid", leaf.name)

    def result(self, qid: int) -> DataFrame:
        """The query's result with output_id, under its own column names."""
        self.prepare_provenance(qid)
        q = self._query(qid)
        return q.result.select("output_id", *(F.col(f"p{k}").alias(c) for k, c in enumerate(q.frame.columns)))

    def plan(self, qid: int) -> nodes.PlanNode:
        return self._query(qid).root

    def provenance_meta(self) -> DataFrame:
        """(query_id int, size_mb double, plan string): a row for each captured query. size_mb: 8 bytes for
        each id in a prepared block that is kept, 0 before; plan: the operators as JSON."""
        rows = []
        for q in self._queries.values():
            ids = 0
            if q.kept and q.columns:
                counts = q.block.agg(F.count("output_id"), *(F.count(f"opid_{o}_{t}") for o, t in q.columns)).first()
                ids = sum(counts)
            rows.append((q.query_id, ids * 8 / 1e6, q.root.to_json()))
        return self.spark.createDataFrame(rows, "query_id int, size_mb double, plan string")

    def global_provenance(self, qid: int) -> DataFrame:
        """(source_table, sink_table, source_opid, sink_opid, out_rowid, in_rowid): the edges of each operator that
        materializes (provenance_meta() names them) between its rows and those of its sources, tables or operators;
        result rows, by their output_id, are the root's and have sink -1. Composing them gives the block."""
        q = self._query(qid)
        edge = "source_table string, sink_table string, source_opid int, sink_opid int, out_rowid long, in_rowid long"
        out = self.spark.createDataFrame([], edge)
        label = f"LOGICAL_{q.root.name.upper()}"

        def add(frame: DataFrame, source: tuple[str, int], sink: tuple[str, int]) -> DataFrame:
            named = F.lit(source[0]).alias("source_table"), F.lit(sink[0]).alias("sink_table"), F.lit(source[1]).alias("source_opid"), F.lit(sink[1]).alias("sink_opid")
            return out.unionByName(frame.select(*named, "out_rowid", "in_rowid"))

        block = self.read_block(qid)
        if not q.root.children:
            return self.top_provenance(qid)
        ids = block.select(F.col("output_id").alias("out_rowid"), F.col("output_id").alias("in_rowid")).distinct()
        out = add(ids, (label, 0), ("", -1))
        for n, opid, table, edges in operator_edges(self._cat, q.root, self.mode):
            out = add(edges, (table, opid), (f"LOGICAL_{n.name.upper()}", n.opid))
        return out

    def top_provenance(self, qid: int) -> DataFrame:
        """The columns of global_provenance in a shorter form without inner operators: edges between result rows
        and the last materializing operator (sink -1), and from that to rows of the tables. A row of the
        last materializing operator goes by the id of the result row that it is."""
        block = self.read_block(qid)
        q = self._query(qid)
        top = q.root
        while top.name not in nodes.BARRIERS and top.children:
            top = top.children[0]
        edge = "source_table string, sink_table string, source_opid int, sink_opid int, out_rowid long, in_rowid long"
        out = self.spark.createDataFrame([], edge)
        inner = top.children != []
        if inner:
            label = f"LOGICAL_{top.name.upper()}"
            ids = block.select("output_id").distinct()
            out = ids.select(F.lit(label).alias("source_table"), F.lit("").alias("sink_table"), F.lit(top.opid).alias("source_opid"), F.lit(-1).alias("sink_opid"), F.col("output_id").alias("out_rowid"), F.col("output_id").alias("in_rowid"))
        for opid, table in q.columns:
            rows = block.select("output_id", F.col(f"opid_{opid}_{table}").alias("rid")).where("rid is not null").distinct()
            sink = F.lit(label if inner else ""), F.lit(top.opid if inner else -1)
            out = out.unionByName(rows.select(F.lit(table).alias("source_table"), sink[0].alias("sink_table"), F.lit(opid).alias("source_opid"), sink[1].alias("sink_opid"), F.col("output_id").alias("out_rowid"), F.col("rid").alias("in_rowid")))
        return out

    # applications

    def set_values(self, table: str, values: DataFrame, model: str) -> None:
        """What the rows of a table stand for in a model (boolean, multiplicity, security, probability): (rid, value);
        a row without a value counts as the model's unit."""
        self._values.setdefault(model, {})[table] = values

    def poly_eval(self, qid: int, model: str = "count") -> DataFrame:
        """(output_id, value) of the query's polynomial; model: count, boolean, formula, or one of the models whose
        values were given by set_values (without any, all rows stand for the unit)."""
        given = self._values.get(model, {})
        columns = {c: given[t] for t in given for c in self.block_columns(qid, t)}
        return semirings.poly_eval(self.read_block(qid), model, columns)

    def prepare_interventions(self, qid: int, predicates: dict[str, list[str]]) -> dict[str, tuple[DataFrame, DataFrame]]:
        """For each table named: its target matrix and its predicate catalog."""
        return {
            t: (interventions.target_matrix(self.base_rows(qid, self.block_columns(qid, t)[0]), p), interventions.predicate_catalog(self.spark, p))
            for t, p in predicates.items()
        }

    def whatif(self, qid: int, aggregate: int, outputs: list[int], spec: list[str], qualified: bool = False) -> DataFrame:
        """(pid, predicate, g0..gk): the query's aggregate number `aggregate` (count, sum, avg or stddev, of any
        expression), for the outputs, without the rows of each combination of values of the attributes in spec
        (table.column; of the tables that the query reads, the first occurrence of each). predicate: column=value, joined
        by AND; qualified, or with attributes of several tables: table_column=value."""
        q = self._query(qid)
        top = q.root
        while top.name != "Aggregate" and len(top.children) == 1:
            top = top.children[0]
        if top.name != "Aggregate":
            raise ValueError("the query has no aggregate on top")
        kind, argument = self._cat.aggregate_arguments(top.node)[aggregate]
        known = {"Count": "count", "Sum": "sum", "Average": "avg", "StddevSamp": "stddev"}
        if kind not in known:
            raise ValueError(f"{kind} can't be taken back")
        attributes = []
        for a in spec:
            table, _, column = a.partition(".")
            of = self.block_columns(qid, table)
            if not column or not of:
                raise ValueError("attributes go by table.column, of tables that the query reads")
            attributes.append((of[0], column))
        block, _, _ = compose(self._cat, q.root, self.mode, argument=argument)
        for i, c in enumerate(dict.fromkeys(c for c, _ in attributes)):
            base = self.base_rows(qid, c)
            columns = dict.fromkeys(x for of, x in attributes if of == c)
            side = base.select(F.col("rid").alias(f"__rid{i}"), *(F.col(f"`{x}`").alias(f"__{c}.{x}") for x in columns))
            block = block.join(side, F.col(c) == F.col(f"__rid{i}"), "left")
        qualified = qualified or len({c for c, _ in attributes}) > 1
        names = [f"{c.split('_', 2)[2]}_{x}" if qualified else x for c, x in attributes]
        rows = block.select("output_id", "argument", *(F.col(f"`__{c}.{x}`").alias(f"__{k}") for k, (c, x) in enumerate(attributes)))
        read = sum(self._cat.bytes_of(n.node) for n in q.root.leaves())
        return explain.numbered(rows, known[kind], "argument", outputs, {f"__{k}": n for k, n in enumerate(names)}, read)
