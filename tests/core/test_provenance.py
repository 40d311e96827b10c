"""Blocks of single operators on tiny tables, with edges worked out by hand, and properties of all queries."""

import json

import pytest

from tracewell import tpch
from tracewell.plans import nodes
from tracewell.plans.annotate import UnsupportedPlan
from tracewell.plans.block import most_bytes
from tracewell.plans.catalyst import Catalyst
from tracewell.session import ProvenanceSession, UnknownQuery
from tracewell.sources.readers import read_csv
from tracewell.sources.row_ids import with_row_ids


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tiny")
    made = {
        "t": ([(1, 10), (1, 20), (2, 30), (None, 40), (3, 50), (1, 10)], "k int, v int"),
        "u": ([(1, 100), (2, 200), (9, 900), (None, 0)], "k int, w int"),
        "n": ([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 1), (4, 4), (4, None)], "a int, b int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
        spark.read.parquet(f"{d}/{name}.parquet").createOrReplaceTempView(name)
    return d


def block(spark, sql, mode="left"):
    s = ProvenanceSession(spark, mode)
    s.set_provenance(True)
    df = s.sql(sql)
    rows = sorted((tuple(r) for r in s.read_block(0).collect()), key=lambda r: [-1 if x is None else x for x in r])
    result = sorted(map(repr, (tuple(r)[1:] for r in s.result(0).collect())))
    assert result == sorted(map(repr, map(tuple, df.collect())))  # annotation doesn't change the result
    s.clear_provenance()
    return rows


CASES = [
    ("select v from t where v > 25", "left", [(0, 2), (1, 3), (2, 4)]),
    ("select v + 1 as x from t where k = 1 order by v desc", "left", [(0, 1), (1, 0), (2, 5)]),
    ("select k, v from t order by v, k limit 2", "left", [(0, 0), (1, 5)]),
    ("select t.v, u.w from t join u on t.k = u.k", "left", [(0, 0, 0), (1, 5, 0), (2, 1, 0), (3, 2, 1)]),
    ("select t.v, u.w from t left join u on t.k = u.k where v > 25", "left", [(0, 2, 1), (1, 3, None), (2, 4, None)]),
    ("select t.v, u.w from t right join u on t.k = u.k and v > 25", "left", [(0, None, 3), (1, None, 0), (2, None, 2), (3, 2, 1)]),
    ("select u.k from u full join (select * from t where v = 50) t on t.k = u.k", "left", [(0, None, 4), (1, 3, None), (2, 0, None), (3, 1, None), (4, 2, None)]),
    ("select v from t where k in (select k from u)", "left", [(0, 0), (1, 5), (2, 1), (3, 2)]),
    ("select distinct k from t where k in (select k from u where w < 500)", "full", [(0, 0, 0), (0, 1, 0), (0, 5, 0), (1, 2, 1)]),
    ("select w from u where not exists (select 1 from t where t.k = u.k)", "left", [(0, 3), (1, 2)]),
    ("select v from t where v = 50 or exists (select 1 from u where u.k = t.k and w = 200)", "left", [(0, 2), (1, 4)]),
    ("select k, sum(v) as s from t group by k", "left", [(0, 3), (1, 0), (1, 1), (1, 5), (2, 2), (3, 4)]),
    ("select count(*) as c from t where v > 35", "left", [(0, 3), (0, 4)]),
    ("select count(*) as c from t where v > 999", "left", []),
    ("select k, count(distinct v) as c, count(distinct v % 3) as d from t where k is not null group by k", "left", [(0, 0), (0, 1), (0, 5), (1, 2), (2, 4)]),
    ("select c, count(*) as m from (select a, count(b) as c from n group by a) x group by c", "left", [(0, 6), (0, 7), (1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5)]),
    ("select k, count(*) as c from t group by k having count(*) > 1", "left", [(0, 0), (0, 1), (0, 5)]),
    ("select v from t where v > 35 union all select w from u where w > 500", "left", [(0, 3, None), (1, 4, None), (2, None, 2)]),
    ("select k from t where v < 35 union select k from u where w < 500", "left", [(0, None, 3), (1, 0, None), (1, 1, None), (1, 5, None), (1, None, 0), (2, 2, None), (2, None, 1)]),
    ("select k from t intersect select k from u", "left", [(0, 3), (1, 0), (1, 1), (1, 5), (2, 2)]),
    ("select k from t except select k from u", "left", [(0, 4)]),
    ("select v from t where v > (select avg(w) * 0.15 from u)", "left", [(0, 4)]),
    ("select w from u where w > (select max(v) * 10 from t)", "full", [(0, 2, k) for k in range(6)]),
    ("select a, rank() over (order by a) as r from (select a, count(*) as c from n where b = 1 group by a) x", "left", [(0, 0), (1, 2), (2, 4), (2, 5)]),
    ("select a, c from (select a, count(*) as c from n where b = 1 group by a) x order by c desc, a limit 1", "left", [(0, 4), (0, 5)]),
    ("select v, x from t lateral view explode(array(7, 8)) as x where v = 30", "left", [(0, 2), (1, 2)]),
    ("select k, v, count(*) as c from t where v > 35 group by rollup(k, v)", "left", [(0, 3), (1, 3), (1, 4), (2, 3), (3, 4), (4, 4)]),
]


@pytest.mark.parametrize(("sql", "mode", "want"), CASES)
def test_edges(spark, tables, sql, mode, want):
    got = block(spark, sql, mode)
    assert got == sorted(want, key=lambda r: [-1 if x is None else x for x in r])


def test_rows_of_several_files_are_numbered_on(spark, tmp_path):
    spark.range(0, 30, 1, 3).selectExpr("id as x").write.parquet(f"{tmp_path}/many.parquet")
    df = spark.read.parquet(f"{tmp_path}/many.parquet")
    rows = with_row_ids(df, "rid").collect()
    assert sorted(r["rid"] for r in rows) == [*range(30)] and len({r["x"] for r in rows}) == 30
    assert sorted((r["rid"], r["x"]) for r in with_row_ids(df, "rid").collect()) == sorted((r["rid"], r["x"]) for r in rows)


def test_sources_other_than_files(spark):
    s = ProvenanceSession(spark)
    s.set_provenance(True)
    s.sql("select x from values (3), (1), (2) as t(x) where x < 3")
    s.sql("select id from range(5, 10) where id > 7")
    frame = spark.sparkContext.parallelize([(i,) for i in range(20)], 4).toDF(["x"])
    s.capture(frame.where("x >= 17"))
    assert sorted(map(tuple, s.read_block(1).collect())) == [(0, 3), (1, 4)]
    assert sorted(map(tuple, s.read_block(2).collect())) == [(0, 17), (1, 18), (2, 19)]


def test_csv_with_nulls_filled(spark, tmp_path):
    (tmp_path / "r.csv").write_text("hrint,moteid,temp\n1,7,20.5\n1,,21.0\n2,8,\n")
    df = read_csv(spark, str(tmp_path / "r.csv"), {"temp": 0.0, "moteid": -1})
    assert [tuple(r) for r in df.collect()] == [(1, 7, 20.5), (1, -1, 21.0), (2, 8, 0.0)]
    df.createOrReplaceTempView("readings")
    assert block(spark, "select hrint, avg(temp) as a from readings group by hrint") == [(0, 0), (0, 1), (1, 2)]


def test_tables_made_and_blocks_saved(spark, tables, tmp_path):
    s = ProvenanceSession(spark)
    spark.sql("drop table if exists made_here")
    qid = s.create_table_as("made_here", "select k, count(*) as c from t group by k")
    s.save_block(qid, str(tmp_path / "block"))
    assert spark.table("made_here").count() == 4 and spark.read.parquet(str(tmp_path / "block")).count() == 6
    spark.sql("drop table made_here")


def test_the_switches_and_statements(spark, tables):
    s = ProvenanceSession(spark)
    s.sql("select * from t")
    assert s.provenance_meta().count() == 0
    s.sql("PRAGMA set_provenance(True)")
    s.sql("select k, sum(v) as s from t group by k")
    s.sql("PRAGMA set_provenance(False)")
    s.sql("select * from u")
    meta = s.sql("select * from provenance_meta()").collect()
    assert [(r["query_id"], r["size_mb"]) for r in meta] == [(0, 0.0)]
    plan = json.loads(meta[0]["plan"])
    assert set(plan) >= {"opid", "name", "sink_opid", "source_opids", "table", "materializes", "children"}
    assert plan["opid"] == 0 and plan["sink_opid"] == -1
    s.sql("PRAGMA PrepareProvenance(0)")
    rows = s.sql("select * from read_block((select max(query_id) from provenance_meta()))")
    assert rows.columns[0] == "output_id" and rows.columns[1].endswith("_t") and rows.count() == 6
    assert s.provenance_meta().first()["size_mb"] == 12 * 8 / 1e6
    assert s.sql("select count(*) as n from global_provenance(0) where sink_opid = -1").first()["n"] == 4
    assert s.sql("select sum(value) as n from PolyEval(0, 'count')").first()["n"] == 6
    assert {r["value"] for r in s.sql("select value from PolyEval(0, 'boolean')").collect()} == {True}
    with pytest.raises(UnknownQuery):
        s.prepare_provenance(7)
    s.sql("PRAGMA clear_provenance")
    assert s.provenance_meta().count() == 0 and s.capture(spark.table("t")) == 0
    with pytest.raises(ValueError, match="unknown pragma"):
        s.sql("PRAGMA nonsense(1)")
    with s:
        assert s.capturing
    s.set_debug_provenance(True)
    s.set_persist_provenance(False)
    s.prepare_provenance(0)
    s.overhead(0)
    assert not s._queries[0].kept


def test_whatif_of_a_captured_query(spark, tables):
    s = ProvenanceSession(spark)
    qid = s.capture(spark.sql("select a, count(*) as c, sum(b) as s, avg(b) as m from n group by a"))
    found = {r["predicate"]: (r["g0"], r["g1"]) for r in s.whatif(qid, 0, [0, 3], ["n.b"]).collect()}
    assert found == {"b=1": (1.0, 2.0), "b=2": (1.0, 2.0), "b=4": (2.0, 1.0), "b=NULL": (2.0, 1.0)}
    assert {r["predicate"]: r["g0"] for r in s.whatif(qid, 1, [0], ["n.b"]).collect()} == {"b=1": 2.0, "b=2": 1.0}
    matrix, catalog = s.prepare_interventions(qid, {"n": ["b = 1", "a > 2"]})["n"]
    assert [r["mask_0"] for r in matrix.orderBy("iid").collect()] == [1, 0, 1, 0, 3, 3, 2, 2] and catalog.count() == 2
    with pytest.raises(ValueError, match="no aggregate"):
        s.whatif(s.capture(spark.table("n")), 0, [0], ["n.b"])


def test_statements_go_by_their_first_word(spark, tables):
    s = ProvenanceSession(spark)
    s.sql("pragma set_edges(True)")
    s.sql("select k, sum(v) as s from t group by k")
    s.sql("create table made_there as select k, max(v) as m from t group by k;")
    s.sql("PRAGMA set_edges(0)")
    assert not s.capturing and spark.table("made_there").count() == 4 and s.read_block(1).count() == 6
    spark.sql("drop table made_there")
    s.sql("PRAGMA set_persist_edges(false)")
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    s.sql("PRAGMA prepare_edges(0)")
    s.read_block(0).count()
    assert not s.persisting and not s._queries[0].kept and len(spark.sparkContext._jsc.getPersistentRDDs()) == held
    assert s.sql("select max(query_id) as n from edges_meta()").first()["n"] == 1
    assert s.sql("select count(*) as n from global_edges(0) where sink_opid = -1").first()["n"] == 4
    s.sql("PRAGMA clear_edges")
    assert s.provenance_meta().count() == 0


def test_whatif_statements(spark, tables):
    s = ProvenanceSession(spark)
    s.set_provenance(True)
    s.sql("select t.k, sum(t.v * u.w) as s, count(*) as c from t join u on t.k = u.k group by t.k")
    # k=1: rows (10, 20, 10) * 100, k=2: 30 * 200
    s.sql("PRAGMA Whatif(0, 0, [0, 1], ['t.v', 'u.w'])")
    found = {r["pid"]: (r["g0"], r["g1"]) for r in s.sql("select * from any_reader(0, 0)").collect()}
    named = {s.sql(f"select * from GetPredicates({p})").first()[0]: g for p, g in found.items()}
    assert named == {"t_v=10 AND u_w=100": (2000.0, 6000.0), "t_v=20 AND u_w=100": (2000.0, 6000.0), "t_v=30 AND u_w=200": (4000.0, None)}
    s.sql("PRAGMA Whatif(0, 1, [0], ['t.v'])")
    assert {r["g0"] for r in s.sql("select g0 from any_reader(0, 1)").collect()} == {1.0, 2.0}
    assert s.sql("select * from GetPredicates(0)").first()[0].startswith("t_v=")
    for wrong in ("PRAGMA Whatif(0)", "PRAGMA Whatif(0, 0, [0], ['nosuch.v'])", "PRAGMA Whatif(0, 0, [0], ['v'])"):
        with pytest.raises(ValueError):
            s.sql(wrong)
    with pytest.raises(UnknownQuery):
        s.sql("select * from any_reader(0, 7)")


def test_models_with_values_of_rows(spark, tables):
    s = ProvenanceSession(spark)
    qid = s.capture(spark.sql("select k, count(*) as n from t where v < 45 group by k"))
    # outputs: null: row 3; 1: rows 0, 1, 5; 2: row 2
    values = lambda rows, kind: spark.createDataFrame(rows, f"rid long, value {kind}")
    got = lambda model: {r["output_id"]: r["value"] for r in s.sql(f"select * from PolyEval({qid}, '{model}')").collect()}
    assert got("multiplicity") == got("count") == {0: 1, 1: 3, 2: 1} and set(got("security").values()) == {0} and set(got("probability").values()) == {1.0}
    s.set_values("t", values([(0, 3), (1, 4), (3, 0)], "long"), "multiplicity")
    s.set_values("t", values([(0, 2), (1, 5), (5, 3), (2, 7)], "int"), "security")
    s.set_values("t", values([(0, 0.5), (1, 0.5), (5, 0.0)], "double"), "probability")
    s.set_values("t", values([(2, False), (0, False)], "boolean"), "boolean")
    assert got("multiplicity") == {0: 0, 1: 8, 2: 1} and got("security") == {0: 0, 1: 2, 2: 7}
    assert got("probability") == {0: 1.0, 1: 0.75, 2: 1.0} and got("boolean") == {0: True, 1: True, 2: False}
    with pytest.raises(ValueError):
        s.poly_eval(qid, "nosuch")


def test_ids_of_ranges_need_no_order(spark):
    df = with_row_ids(spark.range(40, -20, -7, 3), "rid", "Range")
    assert [r["id"] for r in df.orderBy("rid").collect()] == [40, 33, 26, 19, 12, 5, -2, -9, -16]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_results_that_may_be_large_are_numbered_over_many_tasks(spark, tables):
    cat = Catalyst(spark)
    size = lambda sql: most_bytes(cat, nodes.build(cat, cat.optimized(spark.sql(sql))))
    t, u = size("select * from t"), size("select * from u")
    assert size("select * from t join u on t.k = u.k") <= t + u < size("select * from t join u on t.v > u.w")
    assert size("select t.v from t, u where t.k <=> u.k and t.v > u.w") <= t + u
    assert size("select * from t where k in (select k from u)") <= t
    assert size("select count(*) from t join u on t.v > u.w") < 100 and size("select * from t cross join u limit 3") < 200


def test_plans_without_a_rule_say_so(spark, tables):
    s = ProvenanceSession(spark)
    qid = s.capture(spark.table("t").mapInPandas(lambda x: x, "k int, v int").where("v > 3"))
    with pytest.raises(UnsupportedPlan, match="no rule for"):
        s.prepare_provenance(qid)


def test_recursion_in_a_captured_plan(spark, tables):
    rows = "with recursive p(a, b) as (select a, b from n where a < b union all select p.a, n.b from p join n on p.b = n.a and n.a < n.b) "
    # n: 0 (1,1) 1 (1,2) 2 (2,1) 3 (2,2) 4 (3,1) 5 (3,1) 6 (4,4) 7 (4,null)
    spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4), (9, 9)], "a int, b int").coalesce(1).write.mode("overwrite").parquet(f"{tables}/e.parquet")
    spark.read.parquet(f"{tables}/e.parquet").createOrReplaceTempView("e")
    assert block(spark, rows + "select * from p") == [(0, 1, None)]
    paths = "with recursive p(a, b) as (select a, b from e where a < b union all select p.a, e.b from p join e on p.b = e.a where e.a < e.b) "
    got = block(spark, paths + "select a, b from p where a = 1 and b = 3")
    assert got == [(0, None, 1), (0, 0, None)]
    got = block(spark, paths + "select b, count(*) as n from p where a = 1 group by b")
    assert sorted(got, key=repr) == sorted([(0, 0, None), (1, 0, None), (1, None, 1), (2, 0, None), (2, 0, None), (2, None, 1), (2, None, 2), (2, None, 3)], key=repr)  # two ways to 4
    assert block(spark, "with recursive r(x) as (select 1 union all select x + 1 from r where x < 4) select r.x, t.v from r join t on r.x = t.k where v > 25") == [(0, 2), (1, 4)]
    s = ProvenanceSession(spark)
    s.capture(spark.sql(paths + "select b, count(*) as n from p where a = 1 group by b"))
    assert s.sql("select count(*) as n from global_edges(0) where sink_opid = -1").first()["n"] == 3


@pytest.fixture(scope="module")
def workload(spark):
    for t in "region nation customer supplier part orders lineitem".split():
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").createOrReplaceTempView(t)


@pytest.mark.parametrize("name", tpch.QUERIES)
def test_the_workload_is_captured(spark, workload, name):
    s = ProvenanceSession(spark)
    s.set_persist_provenance(False)
    df = spark.sql(tpch.QUERIES[name])
    qid = s.capture(df)
    ids = {r[0] for r in s.read_block(qid).select("output_id").distinct().collect()}
    result = s.result(qid).collect()
    assert sorted(repr(tuple(r)[1:]) for r in result) == sorted(repr(tuple(r)) for r in df.collect())
    assert ids <= {r["output_id"] for r in result} == {*range(len(result))}


MONOTONE = [
    "select c_mktsegment, o_orderkey from customer join orders on c_custkey = o_custkey where o_totalprice > 350000",
    "select l_returnflag, cast(sum(cast(l_quantity as decimal(12,2))) as double) as q, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where o_totalprice > 300000 group by l_returnflag",
    "select distinct o_orderpriority from orders where o_totalprice > 380000",
]


@pytest.mark.parametrize("sql", MONOTONE)
def test_witnesses_alone_give_the_row_back(spark, workload, sql):
    """Deleting all rows that don't stand behind an output leaves that output as it was."""
    s = ProvenanceSession(spark)
    qid = s.capture(spark.sql(sql))
    first = s.result(qid).where("output_id = 0").drop("output_id").first()
    rows = s.read_block(qid).where("output_id = 0").persist()
    for c in s.block_columns(qid):
        table = c.split("_", 2)[2]
        base = with_row_ids(spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet"), "rid")
        base.join(rows.selectExpr(f"{c} as rid").distinct(), "rid", "left_semi").drop("rid").createOrReplaceTempView(f"only_{table}")
    reduced = sql
    for table in ("customer", "orders", "lineitem"):
        reduced = reduced.replace(f"from {table}", f"from only_{table}").replace(f"join {table}", f"join only_{table}")
    assert first in spark.sql(reduced).collect()


def test_group_sizes_are_witness_counts(spark, workload):
    s = ProvenanceSession(spark)
    qid = s.capture(spark.sql("select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name"))
    counts = {r["output_id"]: r["count"] for r in s.read_block(qid).groupBy("output_id").count().collect()}
    assert {r["output_id"]: r["n"] for r in s.result(qid).collect()} == counts
