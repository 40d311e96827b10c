"""Queries that leave nothing out, held against their SQL over whole tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell import queries
from tracewell.operators import trace
from tracewell.plans import block
from tracewell.operators.recursive import reachable_paths
from tracewell.session import ProvenanceSession

SF = "/root/testdata/sf0.01"


def both(spark, name, sf=SF, files="{}.parquet"):
    """A registered query's rows and those of its SQL."""
    con = duckdb.connect()
    for t in queries.TABLES:
        if re.search(rf"\b{t}\b", queries.ORACLE_SQL[name]):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{files.format(t)}')")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    return sorted(map(tuple, got.collect())), sorted(map(tuple, want.fetchall()))


def test_a_theta_join_of_all_suppliers(spark):
    got, want = both(spark, "lin_theta_all")
    assert got == want and max(r[1] for r in got) >= 20


def test_a_trace_from_all_customers(spark):
    got, want = both(spark, "trace_forward_all")
    assert got == want and any(r[0] % 10 for r in got)


def test_recursion_over_the_whole_table(spark):
    got, want = both(spark, "lin_recursive_all")
    two, _ = both(spark, "lin_recursive")
    assert got == want and set(two) < set(got)


def test_paths_of_more_than_32_edges(spark):
    edges = spark.createDataFrame([(i, i, i + 1) for i in range(36)], "rid long, src long, dst long").coalesce(1)
    paths = reachable_paths(edges).collect()
    assert len(paths) == 36 * 37 // 2 and {tuple(r["edges"]) for r in paths if r["depth"] == 36} == {tuple(range(36))}
    assert max(r["depth"] for r in reachable_paths(edges, depth=3).collect()) == 3


def test_edges_of_each_operator(spark):
    got, want = both(spark, "global_provenance_all")
    assert got == want and {r[:2] for r in got} >= {("LOGICAL_JOIN", "LOGICAL_AGGREGATE"), ("customer", "LOGICAL_JOIN")}


COMPOSED = [
    ("select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name order by n desc, n_name limit 9", "left"),
    ("select c, count(*) as m from (select c_nationkey, count(*) as c from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000 group by c_nationkey) t group by c", "left"),
    ("select n_name, c, r_name from nation join region on n_regionkey = r_regionkey join (select c_nationkey, count(*) as c from customer where c_acctbal > 9000 group by c_nationkey) t on n_nationkey = c_nationkey", "left"),
    ("select n_regionkey, count(distinct n_name) as d, count(distinct c_mktsegment) as e from customer join nation on c_nationkey = n_nationkey group by rollup(n_regionkey)", "left"),
    ("select n_name as x from nation join region on n_regionkey = r_regionkey union all select c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_totalprice > 250000)", "left"),
    ("select n_name from nation where n_regionkey in (select r_regionkey from region join customer on r_regionkey = c_custkey) and n_nationkey > (select max(r_regionkey) from region)", "full"),
    ("select n_name from nation where n_nationkey > 20", "left"),
    ("select * from nation", "left"),
]


@pytest.mark.parametrize(("sql", "mode"), COMPOSED)
def test_composed_edges_are_the_block(spark, sql, mode):
    for t in ("nation", "region", "customer", "orders"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").createOrReplaceTempView(t)
    s = ProvenanceSession(spark, mode)
    s.set_persist_provenance(False)
    qid = s.capture(spark.sql(sql))
    edges = s.global_provenance(qid).persist()
    found = {(r["source_opid"], r["out_rowid"], tuple(r["prov"])) for r in trace.end_to_end(edges).collect()}
    assert found == {(int(r["source"].split("_")[1]), r["output_id"], tuple(r["rids"])) for r in trace.backward(s.read_block(qid)).collect()}
    pairs = {(r["sink_opid"], r["source_opid"]) for r in edges.collect()}
    if s.plan(qid).children:
        operators = [n for n in s.plan(qid).walk() if n.materializes and n.opid in {p[1] for p in pairs}]
        assert {(n.opid, c) for n in operators for c in n.source_opids if c in {p[1] for p in pairs}} <= pairs


def join_rows(spark, frame):
    """Rows out of each join of a frame that was read."""
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        n = todo.pop()
        kind = n.getClass().getSimpleName()
        if "Join" in kind:
            found.append(n.metrics().get("numOutputRows").get().value())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(n.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(n.plan())
        children = n.children()
        todo += [children.apply(k) for k in range(children.length())]
    return found


@pytest.mark.parametrize("heavy", [256, 3])
def test_rows_are_numbered_before_groups_multiply_them(spark, monkeypatch, heavy):
    monkeypatch.setattr(block, "HEAVY", heavy)
    got, want = both(spark, "lin_corr_sub")
    assert got == want
    frame = queries.QUERIES["lin_corr_sub"](spark, SF)
    frame.collect()
    assert sorted(join_rows(spark, frame))[-2:-1] < [len(want)] == sorted(join_rows(spark, frame))[-1:]


def test_pairs_are_numbered_without_being_kept(spark, monkeypatch):
    kept, keep = [], block.cut
    monkeypatch.setattr(block, "ONE_WINDOW_BYTES", 0)
    monkeypatch.setattr(block, "cut", lambda df: kept.append(keep(df)) or kept[-1])
    got, want = both(spark, "lin_theta_all")
    assert got == want and max(f.count() for f in kept) < len(want) // 10


#: Joins on other conditions: alike rows on the side that comes first, nulls, NaN, no rows, expressions, both sides in one column.
PAIRS = [
    "select a.k, b.w from t a join u b on a.v < b.w",
    "select b.w, a.k from t a join u b on a.v < b.w",
    "select a.k, b.w, a.v from t a join u b on a.v <> b.w and a.v > 10",
    "select a.k from t a join u b on a.v < b.w or b.k is null",
    "select b.k + 1 as x, a.v from t a join u b on a.d >= b.d",
    "select a.d, b.d as e from t a join u b on a.d > b.d or a.d = 0",
    "select a.v, b.d as e from t a join u b on a.d <= b.d",
    "select b.d, a.v as e from t a join u b on a.d < b.d",
    "select b.d, a.v as e from t a join u b on b.d >= a.d",
    "select a.v + b.w as x, a.v from t a join u b on a.v < b.w",
    "select 1 as x, b.w, a.v from t a cross join u b",
    "select a.v, c.v as y from t a join t c on a.v < c.v",
    "select a.v, b.w from t a join u b on a.v > b.w + 1000",
    "select a.k, b.k as y, c.k as z from t a join u b on a.v < b.w join t c on c.v > b.w",
]


@pytest.mark.parametrize("sql", PAIRS)
@pytest.mark.parametrize("tries", [1 << 28, 5])
def test_pairs_have_the_ids_of_one_window(spark, monkeypatch, sql, tries):
    monkeypatch.setattr(block, "PAIRS_A_TASK", tries)
    nan = float("nan")
    rows = [(1, 10, 0.0), (1, 20, -0.0), (2, 30, nan), (None, 40, None), (None, 50, 1.5), (1, 10, nan), (2, 30, 0.0)]
    spark.createDataFrame(rows, "k int, v int, d double").repartition(3).createOrReplaceTempView("t")
    spark.createDataFrame([(1, 15, 0.0), (1, 15, nan), (2, 200, -0.0), (9, 25, 1.0), (None, 0, None)], "k int, w int, d double").coalesce(1).createOrReplaceTempView("u")
    blocks = []
    for one in (1 << 40, 0):
        monkeypatch.setattr(block, "ONE_WINDOW_BYTES", one)
        s = ProvenanceSession(spark)
        qid = s.capture(spark.sql(sql))
        blocks.append((sorted(map(repr, s.read_block(qid).collect())), sorted(map(repr, s.result(qid).collect()))))
    assert blocks[0] == blocks[1]


#: (keys, query, whether rows are alike in their next columns too): many small groups or few large ones, one comparison or another condition.
ALIKE = [
    (100, "select a.k, b.w from t a join u b on a.v < b.w", False),
    (5, "select a.k, b.d from t a join u b on a.v <> b.w or b.w is null", False),
    (5, "select a.k, b.d, a.d, b.w from t a join u b on a.v < b.w", True),
]


@pytest.mark.parametrize(("keys", "sql", "twice"), ALIKE)
def test_pairs_of_alike_rows_are_not_sorted(spark, monkeypatch, keys, sql, twice):
    rows = [(i % keys if i % keys else None, i * 7 % 50, (0.0, -0.0, float("nan"), None, float(i % keys))[min(i % keys, 4)]) for i in range(300)]
    spark.createDataFrame(rows, "k int, v int, d double").repartition(3).createOrReplaceTempView("t")
    spark.createDataFrame([(i * 3 % 50 or None, (0.0, -0.0, float("nan"), None, 7.0)[i % 5]) for i in range(20)], "w int, d double").coalesce(1).createOrReplaceTempView("u")
    found = []
    for one in (1 << 40, 0):
        monkeypatch.setattr(block, "ONE_WINDOW_BYTES", one)
        s = ProvenanceSession(spark)
        s.set_persist_provenance(False)
        qid = s.capture(spark.sql(sql))
        found.append((sorted(map(repr, s.read_block(qid).collect())), sorted(map(repr, s.result(qid).collect()))))
    assert found[0] == found[1] and len(found[0][0]) > 1000
    assert twice or "Window" not in s.read_block(qid)._jdf.queryExecution().executedPlan().toString()


#: Groups below joins, and as (output row, left row id, row ids of the groups) what stands behind them, spelled out in SQL.
BELOW_JOINS = [
    ("select t.v, a.c from t join (select k, count(*) as c from t group by k) a on t.k <=> a.k", "select t.v, t.k, t.rid, b.rid from t join t b on t.k is not distinct from b.k"),
    ("select a.c, b.s, a.k from (select k, count(*) as c from t group by k) a join (select k, sum(w) as s from u group by k) b on a.k <=> b.k", "select t.k, t.rid, u.rid from t join u on t.k is not distinct from u.k"),
    ("select a.k, u.w from (select k, count(*) as c from t group by k) a left join u on a.k = u.k and w > 150", "select t.k, t.rid, u.rid from t left join u on t.k = u.k and w > 150"),
    ("select u.w, a.c from u left join (select k, count(*) as c from t group by k) a on u.k = a.k", "select u.rid, u.rid, t.rid from u left join t on u.k = t.k"),
    ("select t.v, row_number() over (order by t.v, a.k) as r from t join (select k, count(*) as c from t group by k having count(*) < 3) a on t.k > a.k", "select t.rid, b.rid from t join t b on t.k > b.k and (select count(*) from t c where c.k = b.k) < 3"),
]


@pytest.mark.parametrize(("sql", "pairs"), BELOW_JOINS)
@pytest.mark.parametrize("persist", [True, False])
@pytest.mark.parametrize("heavy", [256, 1])
def test_groups_below_joins(spark, monkeypatch, sql, pairs, persist, heavy):
    monkeypatch.setattr(block, "HEAVY", heavy)
    tables = {"t": ("k int, v int", [(1, 10), (1, 20), (2, 30), (None, 40), (3, 50), (1, 10)]), "u": ("k int, w int", [(1, 100), (2, 200), (9, 900), (None, 0)])}
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"create table {name} (rid int, {schema})")
        con.executemany(f"insert into {name} values (?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
        spark.createDataFrame(rows, schema).coalesce(1).createOrReplaceTempView(name)
    s = ProvenanceSession(spark)
    s.set_persist_provenance(persist)
    df = spark.sql(sql)
    qid = s.capture(df)
    got = [tuple(r) for r in s.read_block(qid).collect()]
    assert sorted(map(repr, (r[-2:] for r in got))) == sorted(repr(r[-2:]) for r in con.execute(pairs).fetchall())
    result = {r["output_id"]: tuple(r)[1:] for r in s.result(qid).collect()}
    assert sorted(map(repr, result.values())) == sorted(map(repr, map(tuple, df.collect())))
    assert {r[0] for r in got} <= set(result) == set(range(len(result)))
    s.clear_provenance()


def test_all_bits_of_the_target_matrix(spark, tmp_path):
    got, want = both(spark, "target_matrix_all")
    assert got == want
    large = spark.read.parquet(f"{SF}/lineitem.parquet").limit(4).withColumn("l_quantity", F.expr("element_at(array(1.0D, 57.5D, 58.5D, 61.0D), cast(row_number() over (order by l_orderkey, l_linenumber) as int))"))
    large.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = both(spark, "target_matrix_all", str(tmp_path), "lineitem.parquet/*.parquet")
    assert got == want and {(r[1] >> 62) & 3 for r in got} == {0, 1, 3}
