"""The registered queries of the provenance engine, and the same relations in SQL.

Blocks are written in SQL by hand: row ids as row_number() over the table, joins and groups spelled out."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import tpch
from tracewell.functions import semirings
from tracewell.operators import explain, interventions, trace
from tracewell.session import ProvenanceSession
from tracewell.sources.row_ids import with_row_ids

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _views(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Views of the tables that a text names, or of all."""
    for t in TABLES if sql is None else (t for t in TABLES if re.search(rf"\b{t}\b", sql)):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _session(spark: SparkSession, sf_dir: str, mode: str = "left", sql: str | None = None) -> ProvenanceSession:
    _views(spark, sf_dir, sql)
    s = ProvenanceSession(spark, mode)
    s.set_persist_provenance(False)
    return s


def _block(spark: SparkSession, sf_dir: str, sql: str, mode: str = "left") -> tuple[ProvenanceSession, DataFrame]:
    s = _session(spark, sf_dir, mode, sql)
    return s, s.read_block(s.capture(spark.sql(sql)))


def _base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return with_row_ids(spark.read.parquet(f"{sf_dir}/{table}.parquet"), "rid")


def _rid(table: str) -> str:
    return f"(select row_number() over () - 1 as rid, * from {table})"


#: Row-numbered tables for the SQL side.
_WITH = "with " + ", ".join(f"{a} as {_rid(t)}" for a, t in (("li", "lineitem"), ("od", "orders"), ("cu", "customer"), ("na", "nation"), ("re", "region"), ("pa", "part"), ("su", "supplier"), ("ev", "events")))


def _query(name: str, oracle: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def _captured(name: str, sql: str, columns: list[str], oracle: str, mode: str = "left") -> None:
    """A block, its row-id columns under stable names, in order of opid."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _block(spark, sf_dir, sql, mode)[1].toDF("output_id", *columns)

    _query(name, f"{_WITH} {oracle}")(run)


def _tpch(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir, sql)
        return spark.sql(sql)

    _query(f"tpch_{name}", sql)(run)


for _name, _sql in tpch.QUERIES.items():
    _tpch(_name, _sql)


@_query("scan_rid", f"select rid, l_orderkey, l_quantity from {_rid('lineitem')}")
def scan_rid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir, "lineitem").select("rid", "l_orderkey", "l_quantity")


# selection, projection, order, limit

_captured(
    "lin_filter", "select l_orderkey, l_linenumber from lineitem where l_quantity < 3", ["lineitem_rid"],
    "select row_number() over (order by l_orderkey, l_linenumber, rid) - 1 as output_id, rid as lineitem_rid from li where l_quantity < 3",
)
_captured(
    "lin_project", "select l_orderkey * 2 as k, l_tax from lineitem where l_discount > 0.05", ["lineitem_rid"],
    "select row_number() over (order by l_orderkey * 2, l_tax, rid) - 1 as output_id, rid as lineitem_rid from li where l_discount > 0.05",
)
_captured(
    "lin_sort", "select o_orderkey from orders where o_orderstatus = 'P' order by o_totalprice desc", ["orders_rid"],
    "select row_number() over (order by o_totalprice desc, rid) - 1 as output_id, rid as orders_rid from od where o_orderstatus = 'P'",
)
_captured(
    "lin_topn", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25", ["orders_rid"],
    "select row_number() over (order by o_totalprice desc, o_orderkey, rid) - 1 as output_id, rid as orders_rid from od order by o_totalprice desc, o_orderkey, rid limit 25",
)
_captured(
    "lin_limit_offset", "select n_name from nation order by n_name limit 7 offset 3", ["nation_rid"],
    "select row_number() over (order by n_name) - 4 as output_id, rid as nation_rid from na order by n_name limit 7 offset 3",
)

# joins

_captured(
    "lin_join_inner", "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey where o_totalprice > 200000", ["orders_rid", "lineitem_rid"],
    """select row_number() over (order by o_orderkey, l_linenumber, od.rid, li.rid) - 1 as output_id, od.rid as orders_rid, li.rid as lineitem_rid
    from od join li on o_orderkey = l_orderkey where o_totalprice > 200000""",
)
_captured(
    "lin_join_left", "select o_orderkey, l_partkey from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 48", ["orders_rid", "lineitem_rid"],
    """select row_number() over (order by o_orderkey, l_partkey nulls first, od.rid, li.rid) - 1 as output_id, od.rid as orders_rid, li.rid as lineitem_rid
    from od left join li on o_orderkey = l_orderkey and l_quantity > 48""",
)
_captured(
    "lin_join_right", "select o_orderkey, c_custkey from (select * from orders where o_totalprice > 300000) o right join customer on o_custkey = c_custkey", ["orders_rid", "customer_rid"],
    """select row_number() over (order by o_orderkey nulls first, c_custkey, od.rid nulls first, cu.rid) - 1 as output_id, od.rid as orders_rid, cu.rid as customer_rid
    from (select * from od where o_totalprice > 300000) od right join cu on o_custkey = c_custkey""",
)
_captured(
    "lin_join_full", "select r_regionkey, n_nationkey from (select * from region where r_regionkey < 3) r full join (select * from nation where n_regionkey > 1) n on r_regionkey = n_regionkey", ["region_rid", "nation_rid"],
    """select row_number() over (order by r_regionkey nulls first, n_nationkey nulls first) - 1 as output_id, re.rid as region_rid, na.rid as nation_rid
    from (select * from re where r_regionkey < 3) re full join (select * from na where n_regionkey > 1) na on r_regionkey = n_regionkey""",
)
_captured(
    "lin_self_join", "select n1.n_name as a, n2.n_name as b from nation n1 join nation n2 on n1.n_regionkey = n2.n_regionkey and n1.n_nationkey < n2.n_nationkey", ["nation1_rid", "nation2_rid"],
    """select row_number() over (order by a.n_name, b.n_name) - 1 as output_id, a.rid as nation1_rid, b.rid as nation2_rid
    from na a join na b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey""",
)
_captured(
    "lin_cross", "select n_name, r_name from nation cross join region", ["nation_rid", "region_rid"],
    "select row_number() over (order by n_name, r_name) - 1 as output_id, na.rid as nation_rid, re.rid as region_rid from na cross join re",
)
_captured(
    "lin_theta", "select s_suppkey, p_partkey from supplier join part on s_acctbal > p_retailprice * 4 and s_suppkey < 20", ["supplier_rid", "part_rid"],
    """select row_number() over (order by s_suppkey, p_partkey) - 1 as output_id, su.rid as supplier_rid, pa.rid as part_rid
    from su join pa on s_acctbal > p_retailprice * 4 and s_suppkey < 20""",
)
_captured(
    "lin_theta_all", "select s_suppkey, p_partkey from supplier join part on s_acctbal > p_retailprice * 4", ["supplier_rid", "part_rid"],
    """select row_number() over (order by s_suppkey, p_partkey) - 1 as output_id, su.rid as supplier_rid, pa.rid as part_rid
    from su join pa on s_acctbal > p_retailprice * 4""",
)
_captured(
    "lin_semi", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 49)", ["orders_rid"],
    """select row_number() over (order by o_orderkey, rid) - 1 as output_id, rid as orders_rid from od
    where exists (select 1 from li where l_orderkey = o_orderkey and l_quantity > 49)""",
)
_captured(
    "lin_semi_full", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)", ["orders_rid", "lineitem_rid"],
    """, v as (select row_number() over (order by o_orderkey, rid) - 1 as output_id, rid, o_orderkey from od where o_orderkey in (select l_orderkey from li where l_quantity > 49))
    select output_id, v.rid as orders_rid, li.rid as lineitem_rid from v join li on l_orderkey = o_orderkey and l_quantity > 49""",
    "full",
)
_captured(
    "lin_anti", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 10)", ["orders_rid"],
    """select row_number() over (order by o_orderkey, rid) - 1 as output_id, rid as orders_rid from od
    where not exists (select 1 from li where l_orderkey = o_orderkey and l_quantity > 10)""",
)
_captured(
    "lin_not_in", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)", ["customer_rid"],
    """select row_number() over (order by c_custkey) - 1 as output_id, rid as customer_rid from cu
    where c_custkey not in (select o_custkey from od where o_totalprice > 100000)""",
)
_captured(
    "lin_mark", "select p_partkey from part where p_size < 5 or exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49)", ["part_rid"],
    """select row_number() over (order by p_partkey) - 1 as output_id, rid as part_rid from pa
    where p_size < 5 or exists (select 1 from li where l_partkey = p_partkey and l_quantity > 49)""",
)
_captured(
    "lin_mark_full", "select p_partkey from part where p_size < 5 or exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49)", ["part_rid", "lineitem_rid"],
    """, v as (select rid, p_partkey, row_number() over (order by p_partkey) - 1 as output_id from pa
        where p_size < 5 or exists (select 1 from li where l_partkey = p_partkey and l_quantity > 49))
    select output_id, v.rid as part_rid, li.rid as lineitem_rid from v left join li on l_partkey = p_partkey and l_quantity > 49""",
    "full",
)
_captured(
    "lin_range", "select id * 2 as x, n_name from range(5, 50000, 3) join nation on id % 1000 = n_nationkey where id % 2 = 0", ["range_rid", "nation_rid"],
    """, r as (select range as id from range(5, 50000, 3))
    select row_number() over (order by id * 2, n_name) - 1 as output_id, (id - 5) // 3 as range_rid, na.rid as nation_rid from r join na on id % 1000 = n_nationkey where id % 2 = 0""",
)
_captured(
    "lin_values", "select k, n_name from (values (1), (3), (9)) as t(k) join nation on k = n_nationkey", ["values_rid", "nation_rid"],
    """select row_number() over (order by k) - 1 as output_id, i as values_rid, na.rid as nation_rid from (values (1, 0), (3, 1), (9, 2)) as t(k, i) join na on k = n_nationkey""",
)


@_query(
    "lin_asof",
    f"""{_WITH}, a as (select rid, event_id, user_id, ts from ev where event_type = 'purchase'),
    pairs as (select a.rid as a, a.event_id, max(struct_pack(ts := b.ts, rid := b.rid)) as b from a join ev b on a.user_id = b.user_id and b.event_type = 'click' and b.ts <= a.ts group by a.rid, a.event_id)
    select row_number() over (order by event_id) - 1 as output_id, a as left_rid, b.rid as right_rid from pairs""",
)
def lin_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row on the right at or before each on the left, of the same key."""
    from tracewell.operators.asof import asof_rows

    ev = _base(spark, sf_dir, "events")
    left, right = (ev.where(F.col("event_type") == t).select("rid", "event_id", "user_id", "ts") for t in ("purchase", "click"))
    return asof_rows(left, right, "user_id", "ts", ["event_id"])


_captured(
    "lin_asof_plan",
    """select a.event_id from (select * from events where event_type = 'purchase') a join
    (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as until from events where event_type = 'click') b
    on a.user_id = b.user_id and b.ts <= a.ts and (b.until is null or a.ts < b.until)""", ["left_rid", "right_rid"],
    """, a as (select rid, event_id, user_id, ts from ev where event_type = 'purchase'),
    pairs as (select a.rid as a, a.event_id, max(struct_pack(ts := b.ts, e := b.event_id, rid := b.rid)) as b from a join ev b on a.user_id = b.user_id and b.event_type = 'click' and b.ts <= a.ts group by a.rid, a.event_id)
    select row_number() over (order by event_id, a, b.rid) - 1 as output_id, a as left_rid, b.rid as right_rid from pairs""",
)


# aggregates

_captured(
    "lin_agg", "select l_returnflag, l_linestatus, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus", ["lineitem_rid"],
    "select dense_rank() over (order by l_returnflag, l_linestatus) - 1 as output_id, rid as lineitem_rid from li where l_shipdate <= date '1998-09-02'",
)
_captured(
    "lin_agg_global", "select sum(l_quantity) as q from lineitem where l_discount > 0.07", ["lineitem_rid"],
    "select cast(0 as bigint) as output_id, rid as lineitem_rid from li where l_discount > 0.07",
)
_captured(
    "lin_agg_join", "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name", ["customer_rid", "nation_rid"],
    """select dense_rank() over (order by n_name) - 1 as output_id, cu.rid as customer_rid, na.rid as nation_rid from cu join na on c_nationkey = n_nationkey""",
)
_captured(
    "lin_count_distinct", "select l_linestatus, count(distinct l_partkey) as p, count(distinct l_suppkey) as s, count(*) as n from lineitem where l_quantity < 20 group by l_linestatus", ["lineitem_rid"],
    "select dense_rank() over (order by l_linestatus) - 1 as output_id, rid as lineitem_rid from li where l_quantity < 20",
)
_captured(
    "lin_having", "select l_orderkey, count(*) as n from lineitem group by l_orderkey having count(*) > 8", ["lineitem_rid"],
    """, g as (select l_orderkey, count(*) as n from li group by l_orderkey having count(*) > 8), v as (select *, row_number() over (order by l_orderkey) - 1 as output_id from g)
    select output_id, rid as lineitem_rid from v join li using (l_orderkey)""",
)
_captured(
    "lin_nested_agg", "select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left join orders on c_custkey = o_custkey and o_totalprice > 150000 group by c_custkey) as t group by c_count order by custdist desc, c_count desc", ["customer_rid", "orders_rid"],
    """, inn as (select c_custkey, count(o_orderkey) as c_count from cu left join od on c_custkey = o_custkey and o_totalprice > 150000 group by c_custkey),
    v as (select c_count, row_number() over (order by count(*) desc, c_count desc) - 1 as output_id from inn group by c_count)
    select output_id, cu.rid as customer_rid, od.rid as orders_rid from v join inn using (c_count) join cu using (c_custkey) left join od on c_custkey = o_custkey and o_totalprice > 150000""",
)
_captured(
    "lin_agg_both_sides", "select a.o_custkey, a.n, b.m from (select o_custkey, count(*) as n from orders where o_totalprice > 250000 group by o_custkey) a join (select o_custkey, count(*) as m from orders where o_totalprice < 50000 group by o_custkey) b on a.o_custkey = b.o_custkey", ["orders1_rid", "orders2_rid"],
    """, a as (select * from od where o_totalprice > 250000), b as (select * from od where o_totalprice < 50000)
    select dense_rank() over (order by a.o_custkey) - 1 as output_id, a.rid as orders1_rid, b.rid as orders2_rid from a join b on a.o_custkey = b.o_custkey""",
)
_captured(
    "lin_join_above_agg", "select n_name, c from nation join (select c_nationkey, count(*) as c from customer where c_acctbal > 9000 group by c_nationkey) t on n_nationkey = c_nationkey", ["nation_rid", "customer_rid"],
    "select dense_rank() over (order by n_name) - 1 as output_id, na.rid as nation_rid, cu.rid as customer_rid from na join cu on n_nationkey = c_nationkey where c_acctbal > 9000",
)
_captured(
    "lin_topn_above_agg", "select o_custkey, count(*) as n from orders group by o_custkey order by n desc, o_custkey limit 5", ["orders_rid"],
    """, v as (select o_custkey, count(*) as n from od group by o_custkey order by n desc, o_custkey limit 5), w as (select *, row_number() over (order by n desc, o_custkey) - 1 as output_id from v)
    select output_id, rid as orders_rid from w join od using (o_custkey)""",
)
_captured(
    "lin_window_above_agg", "select o_custkey, n, rank() over (order by n desc) as r from (select o_custkey, count(*) as n from orders where o_totalprice > 300000 group by o_custkey) t", ["orders_rid"],
    """, t as (select o_custkey, count(*) as n from od where o_totalprice > 300000 group by o_custkey), v as (select *, row_number() over (order by o_custkey) - 1 as output_id from t)
    select output_id, rid as orders_rid from v join od using (o_custkey) where o_totalprice > 300000""",
)
_captured(
    "lin_rollup", "select l_returnflag, l_linestatus, count(*) as n from lineitem where l_quantity < 5 group by rollup(l_returnflag, l_linestatus)", ["lineitem_rid"],
    """, t as (select rid, l_returnflag as f, l_linestatus as s, 0 as g from li where l_quantity < 5 union all select rid, l_returnflag, null, 1 from li where l_quantity < 5 union all select rid, null, null, 3 from li where l_quantity < 5)
    select dense_rank() over (order by f nulls first, s nulls first, g) - 1 as output_id, rid as lineitem_rid from t""",
)
_captured(
    "lin_cube", "select o_orderstatus, o_orderpriority, count(*) as n from orders where o_totalprice > 200000 group by cube(o_orderstatus, o_orderpriority)", ["orders_rid"],
    """, o as (select * from od where o_totalprice > 200000), t as (select rid, o_orderstatus as f, o_orderpriority as s from o union all select rid, o_orderstatus, null from o union all select rid, null, o_orderpriority from o union all select rid, null, null from o)
    select dense_rank() over (order by f nulls first, s nulls first) - 1 as output_id, rid as orders_rid from t""",
)

# set operations, CTEs, subqueries

_captured(
    "lin_distinct", "select distinct o_orderstatus, o_orderpriority from orders where o_totalprice > 100000", ["orders_rid"],
    "select dense_rank() over (order by o_orderstatus, o_orderpriority) - 1 as output_id, rid as orders_rid from od where o_totalprice > 100000",
)
_captured(
    "lin_union_all", "select n_name as x from nation union all select r_name from region", ["nation_rid", "region_rid"],
    """, u as (select n_name as x, 0 as b, rid as n, null as r from na union all select r_name, 1, null, rid from re)
    select row_number() over (order by x, b, n nulls first, r nulls first) - 1 as output_id, n as nation_rid, r as region_rid from u""",
)
_captured(
    "lin_union", "select n_regionkey as x from nation union select r_regionkey from region", ["nation_rid", "region_rid"],
    """, u as (select n_regionkey as x, rid as n, null as r from na union all select r_regionkey, null, rid from re)
    select dense_rank() over (order by x) - 1 as output_id, n as nation_rid, r as region_rid from u""",
)
_captured(
    "lin_intersect", "select n_regionkey as x from nation intersect select r_regionkey from region where r_regionkey > 1", ["nation_rid"],
    "select dense_rank() over (order by n_regionkey) - 1 as output_id, rid as nation_rid from na where n_regionkey in (select r_regionkey from re where r_regionkey > 1)",
)
_captured(
    "lin_intersect_full", "select n_regionkey as x from nation intersect select r_regionkey from region where r_regionkey > 1", ["nation_rid", "region_rid"],
    "select dense_rank() over (order by n_regionkey) - 1 as output_id, na.rid as nation_rid, re.rid as region_rid from na join re on n_regionkey = r_regionkey where r_regionkey > 1",
    "full",
)
_captured(
    "lin_except", "select n_regionkey as x from nation except select r_regionkey from region where r_regionkey > 1", ["nation_rid"],
    "select dense_rank() over (order by n_regionkey) - 1 as output_id, rid as nation_rid from na where n_regionkey not in (select r_regionkey from re where r_regionkey > 1)",
)
_captured(
    "lin_cte", "with t as (select c_custkey, c_nationkey from customer where c_acctbal > 9000) select a.c_custkey, b.c_custkey as other from t a join t b on a.c_nationkey = b.c_nationkey", ["customer1_rid", "customer2_rid"],
    """, t as (select * from cu where c_acctbal > 9000)
    select row_number() over (order by a.c_custkey, b.c_custkey) - 1 as output_id, a.rid as customer1_rid, b.rid as customer2_rid from t a join t b on a.c_nationkey = b.c_nationkey""",
)
_captured(
    "lin_scalar_sub", "select o_orderkey from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders)", ["orders_rid", "inner_rid"][:1],
    "select row_number() over (order by o_orderkey) - 1 as output_id, rid as orders_rid from od where o_totalprice > (select avg(o_totalprice) * 1.8 from od)",
)
_captured(
    "lin_scalar_full", "select n_name from nation where n_nationkey > (select max(r_regionkey) * 4 from region)", ["nation_rid", "region_rid"],
    """, v as (select rid, row_number() over (order by n_name) - 1 as output_id from na where n_nationkey > (select max(r_regionkey) * 4 from re))
    select output_id, v.rid as nation_rid, re.rid as region_rid from v cross join re""",
    "full",
)
_captured(
    "lin_corr_sub", "select p_partkey from part p where p_retailprice > (select max(q.p_retailprice) * 0.99 from part q where q.p_brand = p.p_brand)", ["part_rid", "inner_rid"],
    """, m as (select p_brand, max(p_retailprice) * 0.99 as x from pa group by p_brand),
    v as (select rid, p_brand, row_number() over (order by p_partkey) - 1 as output_id from pa join m using (p_brand) where p_retailprice > x)
    select output_id, v.rid as part_rid, pa.rid as inner_rid from v join pa using (p_brand)""",
)

# row-wise operators

_captured(
    "lin_window", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders where o_totalprice > 200000", ["orders_rid"],
    """, t as (select rid, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from od where o_totalprice > 200000)
    select row_number() over (order by o_orderkey, r, rid) - 1 as output_id, rid as orders_rid from t""",
)


@_query("lin_unnest", f"{_WITH} select row_number() over (order by n_name, x) - 1 as output_id, rid as nation_rid from (select rid, n_name, unnest([1, 2, 3]) as x from na)")
def lin_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block(spark, sf_dir, "select n_name, x from nation lateral view explode(array(1, 2, 3)) t as x")[1].toDF("output_id", "nation_rid")


@_query("lin_sample")
def lin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _session(spark, sf_dir)
    return s.read_block(s.capture(spark.table("orders").sample(0.1, seed=3).select("o_orderkey"))).toDF("output_id", "orders_rid")


@_query("lin_recursive", f"{_WITH}, recursive_edges as (select rid, n_nationkey as src, (n_nationkey * 7 + 3) % 25 as dst from na), one as (select src, dst, rid, 1 as depth from recursive_edges), two as (select one.src, e.dst, e.rid, one.depth + 1 as depth, one.rid as first from one join recursive_edges e on one.dst = e.src) select src, dst, rid as edge_rid from one union select src, dst, rid from two union select src, dst, first from two")
def lin_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of at most two edges, with the edges on them."""
    from tracewell.operators.recursive import reachable_paths

    edges = _base(spark, sf_dir, "nation").select("rid", F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("dst"))
    out = reachable_paths(edges, depth=2)
    return out.select("src", "dst", F.explode("edges").alias("edge_rid")).distinct()


@_query(
    "lin_recursive_all",
    f"""with recursive na as {_rid('nation')}, e as (select rid, cast(n_nationkey as bigint) as src, cast((n_nationkey * 7 + 3) % 25 as bigint) as dst from na),
    p as (select src, dst, [rid] as edges from e union all select p.src, e.dst, list_append(p.edges, e.rid) from p join e on p.dst = e.src where not list_contains(p.edges, e.rid))
    select distinct src, dst, unnest(edges) as edge_rid from p""",
)
def lin_recursive_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths that pass no edge twice, with the edges on them."""
    from tracewell.operators.recursive import reachable_paths

    edges = _base(spark, sf_dir, "nation").select("rid", F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("dst"))
    return reachable_paths(edges).select("src", "dst", F.explode("edges").alias("edge_rid")).distinct()


@_query(
    "lin_reachable",
    f"""with recursive na as {_rid('nation')}, e as (select rid, cast(n_nationkey as bigint) as src, cast((n_nationkey * 7 + 3) % 25 as bigint) as dst from na),
    p as (select src, dst from e union select p.src, e.dst from p join e on p.dst = e.src), z as (select * from p union select src, src from e union select dst, dst from e)
    select distinct a.src, b.dst, e.rid as edge_rid from e join z a on a.dst = e.src join z b on b.src = e.dst""",
)
def lin_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with a path, with the edges behind each."""
    from tracewell.operators.recursive import reachable_edges

    edges = _base(spark, sf_dir, "nation").select("rid", F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("dst"))
    return reachable_edges(edges).withColumnRenamed("rid", "edge_rid")


_UP = """with recursive e as (select n_nationkey, cast(floor(n_nationkey / 3) as int) as up from nation where n_nationkey > 0),
    p(src, dst) as (select n_nationkey, up from e union all select p.src, e.up from p join e on p.dst = e.n_nationkey)"""


@_query(
    "lin_recursive_plan",
    f"""{_WITH.replace('with ', 'with recursive ', 1)}, e as (select rid, n_nationkey, cast(floor(n_nationkey / 3) as int) as up from na where n_nationkey > 0),
    p as (select n_nationkey as src, up as dst, rid, cast([] as bigint[]) as steps from e union all select p.src, e.up, p.rid, list_append(p.steps, e.rid) from p join e on p.dst = e.n_nationkey),
    v as (select *, row_number() over (order by src, dst) - 1 as output_id from p)
    select output_id, rid as nation1_rid, cast(null as bigint) as nation2_rid from v union all select output_id, null, s from (select output_id, unnest(steps) as s from v)""",
)
def lin_recursive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive query under capture: a row's first edge, and each further one, in rows of their own."""
    return _block(spark, sf_dir, f"{_UP} select src, dst from p")[1].toDF("output_id", "nation1_rid", "nation2_rid")


@_query(
    "lin_recursive_agg",
    f"""{_WITH.replace('with ', 'with recursive ', 1)}, e as (select rid, n_nationkey, cast(floor(n_nationkey / 3) as int) as up from na where n_nationkey > 0),
    p as (select n_nationkey as src, up as dst, rid, cast([] as bigint[]) as steps from e union all select p.src, e.up, p.rid, list_append(p.steps, e.rid) from p join e on p.dst = e.n_nationkey),
    v as (select *, dense_rank() over (order by dst) - 1 as output_id from p)
    select output_id, rid as nation1_rid, cast(null as bigint) as nation2_rid from v union all select output_id, null, s from (select output_id, unnest(steps) as s from v)""",
)
def lin_recursive_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over a recursive query; a row of the block for each row that is counted."""
    return _block(spark, sf_dir, f"{_UP} select dst, count(*) as n from p group by dst")[1].toDF("output_id", "nation1_rid", "nation2_rid")


# the workload under capture

_captured(
    "lin_tpch_q03", tpch.QUERIES["q03"], ["customer_rid", "orders_rid", "lineitem_rid"],
    f""", j as (select cu.rid as c, od.rid as o, li.rid as l, l_orderkey, o_orderdate, {tpch.NET} as x from cu, od, li where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
        and o_orderdate < cast('1998-03-15' as date) and l_shipdate > cast('1998-03-15' as date)),
    v as (select l_orderkey, o_orderdate, cast(sum(x) as double) as revenue from j group by all order by revenue desc, o_orderdate, l_orderkey limit 10),
    w as (select *, row_number() over (order by revenue desc, o_orderdate, l_orderkey) - 1 as output_id from v)
    select output_id, c as customer_rid, o as orders_rid, l as lineitem_rid from w join j using (l_orderkey, o_orderdate)""",
)
_captured(
    "lin_tpch_q18", tpch.QUERIES["q18"], ["customer_rid", "orders_rid", "lineitem_rid"],
    """, big as (select l_orderkey from li group by l_orderkey having sum(l_quantity) > 300),
    v as (select o_orderkey, row_number() over (order by o_totalprice desc, o_orderdate, o_orderkey) - 1 as output_id from od where o_orderkey in (select l_orderkey from big) order by o_totalprice desc, o_orderdate, o_orderkey limit 100)
    select output_id, cu.rid as customer_rid, od.rid as orders_rid, li.rid as lineitem_rid from v join od using (o_orderkey) join cu on c_custkey = o_custkey join li on l_orderkey = o_orderkey""",
)

def _by_table(name: str, order: str, keys: str, witnesses: str) -> None:
    """A workload query's block, row-id columns by table (numbered, if it stands there several times). witnesses: (keys,
    <table>_rid...) in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, block = _block(spark, sf_dir, tpch.QUERIES[name])
        tables = [c.split("_", 2)[2] for c in s.block_columns(0)]
        return block.toDF("output_id", *(f"{t}{tables[: k + 1].count(t) if tables.count(t) > 1 else ''}_rid" for k, t in enumerate(tables)))

    numbered = f"w as (select *, row_number() over (order by {order}) - 1 as output_id from ({tpch.QUERIES[name]}) q), j as ({witnesses})"
    joined = f"select output_id, j.* exclude ({keys}) from w join j using ({keys})" if keys else "select output_id, j.* from w cross join j"
    _query(f"lin_tpch_{name}", f"{_WITH}, {numbered} {joined}")(run)


_SOLD = "cu, od, li where c_custkey = o_custkey and l_orderkey = o_orderkey"
_by_table("q01", "l_returnflag, l_linestatus", "l_returnflag, l_linestatus", "select l_returnflag, l_linestatus, rid as lineitem_rid from li where l_shipdate <= cast('1998-09-02' as date)")
_by_table(
    "q04", "o_orderpriority", "o_orderpriority",
    """select o_orderpriority, rid as orders_rid from od where o_orderdate >= cast('1996-07-01' as date) and o_orderdate < cast('1996-10-01' as date)
    and exists (select * from li where l_orderkey = o_orderkey and l_returnflag = 'R')""",
)
_by_table(
    "q05", "revenue desc, n_name", "n_name",
    f"""select n_name, cu.rid as customer_rid, od.rid as orders_rid, li.rid as lineitem_rid, su.rid as supplier_rid, na.rid as nation_rid, re.rid as region_rid
    from su, na, re, {_SOLD} and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_regionkey = 2
    and o_orderdate >= cast('1996-01-01' as date) and o_orderdate < cast('1997-01-01' as date)""",
)
_by_table(
    "q06", "1", "",
    """select rid as lineitem_rid from li where l_shipdate >= cast('1996-01-01' as date) and l_shipdate < cast('1997-01-01' as date)
    and cast(l_discount as decimal(4,2)) between 0.05 and 0.07 and l_quantity < 24""",
)
_by_table(
    "q10", "revenue desc, c_custkey", "c_custkey",
    f"""select c_custkey, cu.rid as customer_rid, od.rid as orders_rid, li.rid as lineitem_rid, na.rid as nation_rid from na, {_SOLD} and l_returnflag = 'R' and c_nationkey = n_nationkey
    and o_orderdate >= cast('1995-10-01' as date) and o_orderdate < cast('1996-01-01' as date)""",
)
_by_table(
    "q11", "value desc, ps_partkey", "ps_partkey",
    """select l_partkey as ps_partkey, li.rid as lineitem_rid, su.rid as supplier_rid, na.rid as nation_rid
    from li, su, na where l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_8'""",
)
_by_table(
    "q12", "l_linestatus", "l_linestatus",
    """select l_linestatus, od.rid as orders_rid, li.rid as lineitem_rid from od, li where o_orderkey = l_orderkey and l_returnflag in ('A', 'R')
    and l_shipdate >= cast('1996-01-01' as date) and l_shipdate < cast('1997-01-01' as date)""",
)
_by_table(
    "q14", "1", "",
    "select li.rid as lineitem_rid, pa.rid as part_rid from li, pa where l_partkey = p_partkey and l_shipdate >= date '1995-09-01' and l_shipdate < cast('1995-10-01' as date)",
)
_by_table(
    "q15", "s_suppkey", "s_suppkey",
    """select s_suppkey, su.rid as supplier_rid, li.rid as lineitem_rid from su, li where s_suppkey = l_suppkey
    and l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '3' month""",
)
_by_table(
    "q16", "supplier_cnt desc, p_brand, p_type, p_size", "p_brand, p_type, p_size",
    """select p_brand, p_type, p_size, pa.rid as part_rid, li.rid as lineitem_rid from pa, li where p_partkey = l_partkey
    and l_suppkey not in (select s_suppkey from su where s_acctbal < 0)""",
)
_by_table(
    "q19", "1", "",
    """select li.rid as lineitem_rid, pa.rid as part_rid from li, pa where p_partkey = l_partkey and (
    (p_brand = 'Brand#12' and l_quantity between 1 and 11 and p_size between 1 and 5) or (p_brand = 'Brand#23' and l_quantity between 10 and 20 and p_size between 1 and 10)
    or (p_brand = 'Brand#34' and l_quantity between 20 and 30 and p_size between 1 and 15))""",
)
_by_table(
    "q21", "numwait desc, s_name", "s_name",
    """select s_name, su.rid as supplier_rid, li.rid as lineitem_rid, od.rid as orders_rid, na.rid as nation_rid from su, li, od, na
    where s_suppkey = l_suppkey and o_orderkey = l_orderkey and o_orderstatus = 'F' and l_returnflag = 'R' and s_nationkey = n_nationkey and n_name = 'NATION_20'
    and exists (select * from lineitem l2 where l2.l_orderkey = li.l_orderkey and l2.l_suppkey <> li.l_suppkey)""",
)
_by_table(
    "q22", "cntrycode", "cntrycode",
    """select substring(cast(c_nationkey + 10 as varchar(2)), 1, 1) as cntrycode, rid as customer_rid from cu
    where c_nationkey in (13, 1, 3, 9, 10, 18, 17) and cast(c_acctbal as decimal(12,2)) > (
        select sum(cast(c_acctbal as decimal(12,2))) / count(*) from cu where c_acctbal > 0.00 and c_nationkey in (13, 1, 3, 9, 10, 18, 17))
    and not exists (select * from od where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""",
)

_by_table(
    "q02", "s_acctbal desc, n_name, s_name, p_partkey", "s_name, p_partkey",
    """select su.s_name, p_partkey, pa.rid as part_rid, li.rid as lineitem1_rid, su.rid as supplier2_rid, na.rid as nation2_rid, re.rid as region2_rid,
    l2.rid as lineitem2_rid, s2.rid as supplier1_rid, n2.rid as nation1_rid, r2.rid as region1_rid
    from pa join li on p_partkey = li.l_partkey join su on su.s_suppkey = li.l_suppkey join na on su.s_nationkey = na.n_nationkey join re on na.n_regionkey = re.r_regionkey
    join li l2 on l2.l_partkey = p_partkey join su s2 on s2.s_suppkey = l2.l_suppkey join na n2 on s2.s_nationkey = n2.n_nationkey join re r2 on n2.n_regionkey = r2.r_regionkey
    where p_size between 10 and 20 and p_type like '%PROMO' and re.r_regionkey = 1 and r2.r_regionkey = 1""",
)
_by_table(
    "q07", "supp_nation, cust_nation, l_year", "supp_nation, cust_nation, l_year",
    """select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as int) as l_year, su.rid as supplier_rid, li.rid as lineitem_rid, od.rid as orders_rid,
    cu.rid as customer_rid, n1.rid as nation1_rid, n2.rid as nation2_rid from su, li, od, cu, na n1, na n2
    where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
    and l_shipdate between cast('1995-01-01' as date) and cast('1998-12-31' as date)""",
)
_by_table(
    "q08", "o_year", "o_year",
    """select cast(extract(year from o_orderdate) as int) as o_year, pa.rid as part_rid, su.rid as supplier_rid, li.rid as lineitem_rid, od.rid as orders_rid, cu.rid as customer_rid,
    n1.rid as nation1_rid, n2.rid as nation2_rid, re.rid as region_rid from pa, su, li, od, cu, na n1, na n2, re
    where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey
    and r_regionkey = 0 and s_nationkey = n2.n_nationkey and o_orderdate between cast('1995-01-01' as date) and cast('1996-12-31' as date) and p_type = 'ECONOMY'""",
)
_by_table(
    "q09", "nation, o_year desc", "nation, o_year",
    """select n_name as nation, cast(extract(year from o_orderdate) as int) as o_year, pa.rid as part_rid, su.rid as supplier_rid, li.rid as lineitem1_rid, l2.rid as lineitem2_rid,
    od.rid as orders_rid, na.rid as nation_rid from pa join li on p_partkey = li.l_partkey join su on s_suppkey = li.l_suppkey join od on o_orderkey = li.l_orderkey
    join na on s_nationkey = n_nationkey join li l2 on l2.l_partkey = li.l_partkey and l2.l_suppkey = li.l_suppkey where p_name like '%blue%'""",
)
_by_table(
    "q13", "custdist desc, c_count desc", "c_count",
    """select c_count, cu.rid as customer_rid, od.rid as orders_rid from cu left join od on c_custkey = o_custkey and o_orderpriority not like '%URGENT%'
    join (select c_custkey, count(o_orderkey) as c_count from cu left join od on c_custkey = o_custkey and o_orderpriority not like '%URGENT%' group by c_custkey) using (c_custkey)""",
)
_by_table(
    "q17", "1", "",
    """select li.rid as lineitem1_rid, pa.rid as part_rid, l2.rid as lineitem2_rid from li join pa on p_partkey = li.l_partkey join li l2 on l2.l_partkey = p_partkey
    where p_brand = 'Brand#23' and li.l_quantity < (select 0.2e0 * avg(l_quantity) from lineitem where l_partkey = p_partkey)""",
)
_by_table("q20", "s_name", "s_name", "select s_name, su.rid as supplier_rid, na.rid as nation_rid from su join na on s_nationkey = n_nationkey")

_captured(
    "lin_lateral", "select r_name, t.n_name from region, lateral (select n_name from nation where n_regionkey = r_regionkey and n_nationkey > 10) t", ["region_rid", "nation_rid"],
    "select row_number() over (order by r_name, n_name) - 1 as output_id, re.rid as region_rid, na.rid as nation_rid from re join na on n_regionkey = r_regionkey where n_nationkey > 10",
)
_captured(
    "lin_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders where o_totalprice > 300000 group by grouping sets ((o_orderstatus), (o_orderpriority))", ["orders_rid"],
    """, o as (select * from od where o_totalprice > 300000), t as (select rid, o_orderstatus as f, null as s from o union all select rid, null, o_orderpriority from o)
    select dense_rank() over (order by f nulls first, s nulls first) - 1 as output_id, rid as orders_rid from t""",
)


# functions of the workload


@_query("fn_statistics", "select event_type, count(*) as n, count(distinct user_id) as users, round(stddev_samp(value), 6) as sd, round(median(value), 6) as med, min(value) as lo, max(value) as hi from events group by event_type")
def fn_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "events")
    return spark.sql("select event_type, count(*) as n, count(distinct user_id) as users, round(stddev_samp(value), 6) as sd, round(median(value), 6) as med, min(value) as lo, max(value) as hi from events group by event_type")


@_query("fn_lists", "select p_brand, list(distinct p_size order by p_size) as sizes, string_agg(distinct p_type, '|' order by p_type) as types from part where p_size < 6 group by p_brand")
def fn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "part")
    part = spark.table("part").where("p_size < 6")
    return part.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("types"))


# applications: polynomials

_FLAG = "select l_returnflag, count(*) as n from lineitem where l_quantity < 2 group by l_returnflag"
_FLAG_SQL = "b as (select dense_rank() over (order by l_returnflag) - 1 as output_id, rid as l from li where l_quantity < 2)"
_NATION = "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9500 group by n_name"
_NATION_SQL = "b as (select dense_rank() over (order by n_name) - 1 as output_id, cu.rid as c, na.rid as n from cu join na on c_nationkey = n_nationkey where c_acctbal > 9500)"


@_query("formula", f"{_WITH}, {_NATION_SQL} select output_id, string_agg('c.' || c || '*n.' || n, ' + ' order by c, n) as formula from b group by output_id")
def formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semirings.formula(_block(spark, sf_dir, _NATION)[1])


@_query("poly_count", f"{_WITH}, {_NATION_SQL} select output_id, count(*) as value from b group by output_id")
def poly_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semirings.poly_eval(_block(spark, sf_dir, _NATION)[1], "count")


@_query("poly_boolean", f"{_WITH}, {_NATION_SQL} select output_id, bool_or(c % 3 = 0 and n % 2 = 1) as value from b group by output_id")
def poly_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _NATION)
    (c,), (n,) = s.block_columns(0, "customer"), s.block_columns(0, "nation")
    values = {c: _base(spark, sf_dir, "customer").select("rid", (F.col("rid") % 3 == 0).alias("value")), n: _base(spark, sf_dir, "nation").select("rid", (F.col("rid") % 2 == 1).alias("value"))}
    return semirings.boolean(block, values)


@_query("poly_multiplicity", f"{_WITH}, {_NATION_SQL} select output_id, cast(sum((c % 3) * (n % 5 + 1)) as bigint) as value from b group by output_id")
def poly_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _NATION)
    (c,), (n,) = s.block_columns(0, "customer"), s.block_columns(0, "nation")
    values = {c: _base(spark, sf_dir, "customer").select("rid", (F.col("rid") % 3).alias("value")), n: _base(spark, sf_dir, "nation").select("rid", (F.col("rid") % 5 + 1).alias("value"))}
    return semirings.counted(block, values)


@_query("poly_security", f"{_WITH}, {_NATION_SQL} select output_id, min(greatest(c % 4, n % 3)) as value from b group by output_id")
def poly_security(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _NATION)
    (c,), (n,) = s.block_columns(0, "customer"), s.block_columns(0, "nation")
    values = {c: _base(spark, sf_dir, "customer").select("rid", (F.col("rid") % 4).alias("value")), n: _base(spark, sf_dir, "nation").select("rid", (F.col("rid") % 3).alias("value"))}
    return semirings.security(block, values)


@_query("poly_probability", f"{_WITH}, {_NATION_SQL} select output_id, round(1 - exp(sum(ln(1 - 0.25 * (1 + c % 3) * 0.5))), 9) as value from b group by output_id")
def poly_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _NATION)
    (c,), (n,) = s.block_columns(0, "customer"), s.block_columns(0, "nation")
    values = {c: _base(spark, sf_dir, "customer").select("rid", (F.lit(0.25) * (1 + F.col("rid") % 3)).alias("value")), n: _base(spark, sf_dir, "nation").select("rid", F.lit(0.5).alias("value"))}
    return semirings.probability(block, values).select("output_id", F.round("value", 9).alias("value"))


@_query("filtered_counts", f"{_WITH}, {_FLAG_SQL} select output_id, cast(sum((l_linestatus = 'O')::int) as bigint) as open, cast(sum((l_discount > 0.05)::int) as bigint) as cheap, count(*) as total from b join li on rid = l group by output_id")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _FLAG)
    predicates = {"open": F.col("l_linestatus") == "O", "cheap": F.col("l_discount") > 0.05}
    return semirings.filtered_counts(block, s.block_columns(0)[0], _base(spark, sf_dir, "lineitem"), predicates)


@_query("where_provenance", f"{_WITH}, {_FLAG_SQL} select distinct output_id, rid, l_quantity as value from b join li on rid = l")
def where_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _FLAG)
    return semirings.where_provenance(block, s.block_columns(0)[0], _base(spark, sf_dir, "lineitem"), "l_quantity")


# applications: traces


@_query("trace_back", f"{_WITH}, {_NATION_SQL} select output_id, 'customer' as source, list(distinct c order by c) as rids from b group by output_id union all select output_id, 'nation', list(distinct n order by n) from b group by output_id")
def trace_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trace.backward(_block(spark, sf_dir, _NATION)[1])
    return out.withColumn("source", F.regexp_replace("source", r"^opid_\d+_", ""))


@_query("trace_forward", f"{_WITH}, {_NATION_SQL} select distinct c as rid, output_id from b where c % 10 = 0")
def trace_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _NATION)
    return trace.forward(block, s.block_columns(0, "customer")[0], _base(spark, sf_dir, "customer").where("rid % 10 = 0"))


@_query("trace_forward_all", f"{_WITH}, {_NATION_SQL} select distinct c as rid, output_id from b")
def trace_forward_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _NATION)
    return trace.forward(block, s.block_columns(0, "customer")[0], _base(spark, sf_dir, "customer"))


@_query("cross_filter", f"{_WITH}, {_FLAG_SQL}, o as (select dense_rank() over (order by l_linestatus) - 1 as output_id, rid from li) select o.output_id, count(*) as n from o where rid in (select l from b where output_id = 1) group by o.output_id")
def cross_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block = _block(spark, sf_dir, _FLAG)
    t, other = _block(spark, sf_dir, "select l_linestatus, count(*) as n from lineitem group by l_linestatus")
    return trace.cross_filter(block, other, s.block_columns(0)[0], t.block_columns(0)[0], [1])


@_query("global_provenance", f"{_WITH}, {_NATION_SQL} select 'LOGICAL_AGGREGATE' as source_table, '' as sink_table, output_id as out_rowid, output_id as in_rowid from (select distinct output_id from b) union all select distinct 'customer', 'LOGICAL_AGGREGATE', output_id, c from b union all select distinct 'nation', 'LOGICAL_AGGREGATE', output_id, n from b")
def global_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without inner operators."""
    s, _ = _block(spark, sf_dir, _NATION)
    return s.top_provenance(0).select("source_table", "sink_table", "out_rowid", "in_rowid")


@_query(
    "global_provenance_all",
    f"""{_WITH}, b as (select dense_rank() over (order by n_name) - 1 as output_id, row_number() over (order by cu.rid, na.rid) - 1 as j, cu.rid as c, na.rid as n from cu join na on c_nationkey = n_nationkey where c_acctbal > 9500)
    select distinct 'LOGICAL_AGGREGATE' as source_table, '' as sink_table, output_id as out_rowid, output_id as in_rowid from b union all select 'LOGICAL_JOIN', 'LOGICAL_AGGREGATE', output_id, j from b
    union all select 'customer', 'LOGICAL_JOIN', j, c from b union all select 'nation', 'LOGICAL_JOIN', j, n from b""",
)
def global_provenance_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _block(spark, sf_dir, _NATION)
    return s.global_provenance(0).select("source_table", "sink_table", "out_rowid", "in_rowid")


@_query("end_to_end", f"{_WITH}, {_NATION_SQL} select 'customer' as source_table, output_id as out_rowid, list(distinct c order by c) as prov from b group by output_id union all select 'nation', output_id, list(distinct n order by n) from b group by output_id")
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _block(spark, sf_dir, _NATION)
    return trace.end_to_end(s.global_provenance(0)).select("source_table", "out_rowid", "prov")


def _end_to_end(name: str, query: str, order: str, keys: str, witnesses: str, tables: tuple[str, ...]) -> None:
    """From the edges of all operators, inner ones too, down to the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, _ = _block(spark, sf_dir, tpch.QUERIES[query])
        return trace.end_to_end(s.global_provenance(0)).groupBy("source_table", "out_rowid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("prov")))).alias("prov"))

    sides = " union all ".join(f"select '{t}' as source_table, output_id as out_rowid, list(distinct {t}_rid order by {t}_rid) as prov from b where {t}_rid is not null group by output_id" for t in tables)
    _query(name, f"{_WITH}, w as (select *, row_number() over (order by {order}) - 1 as output_id from ({tpch.QUERIES[query]}) q), b as (select output_id, j.* from w join ({witnesses}) j using ({keys})) {sides}")(run)


_end_to_end(
    "end_to_end_q13", "q13", "custdist desc, c_count desc", "c_count",
    """select c_count, cu.rid as customer_rid, od.rid as orders_rid from cu left join od on c_custkey = o_custkey and o_orderpriority not like '%URGENT%'
    join (select c_custkey, count(o_orderkey) as c_count from cu left join od on c_custkey = o_custkey and o_orderpriority not like '%URGENT%' group by c_custkey) using (c_custkey)""",
    ("customer", "orders"),
)
_end_to_end(
    "end_to_end_q18", "q18", "o_totalprice desc, o_orderdate, o_orderkey", "o_orderkey",
    "select o_orderkey, cu.rid as customer_rid, od.rid as orders_rid, li.rid as lineitem_rid from cu, od, li where c_custkey = o_custkey and o_orderkey = l_orderkey",
    ("customer", "orders", "lineitem"),
)


@_query("provenance_meta")
def provenance_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _ = _block(spark, sf_dir, _NATION)
    return s.sql("select * from provenance_meta()")


# applications: what-if

_PREDICATES = ["l_extendedprice <= 1000", "l_linestatus = 'O'", "l_discount > 0.05", "l_tax < 0.02", "l_linenumber = 1"] + [f"l_quantity > {q}" for q in range(61)]
_VALUE = "cast(l_extendedprice as decimal(12,2))"


@_query("target_matrix", f"{_WITH} select rid as iid, cast({' + '.join(f'(case when {p} then {1 << j}::hugeint else 0 end)' for j, p in enumerate(_PREDICATES[:62]))} as bigint) as mask_low, {' + '.join(f'(case when {p} then {1 << j} else 0 end)' for j, p in enumerate(_PREDICATES[64:]))} as mask_1 from li")
def target_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    tm = interventions.target_matrix(_base(spark, sf_dir, "lineitem"), _PREDICATES)
    return tm.select("iid", F.col("mask_0").bitwiseAND(F.lit((1 << 62) - 1)).alias("mask_low"), F.col("mask_1").cast("int").alias("mask_1"))


@_query(
    "target_matrix_all",
    f"""{_WITH}, m as (select rid as iid, {' + '.join(f'(case when {p} then {1 << j}::hugeint else 0 end)' for j, p in enumerate(_PREDICATES[:64]))} as bits, {' + '.join(f'(case when {p} then {1 << j} else 0 end)' for j, p in enumerate(_PREDICATES[64:]))} as mask_1 from li)
    select iid, cast(case when bits >= {1 << 63}::hugeint then bits - {1 << 64}::hugeint else bits end as bigint) as mask_0, mask_1 from m""",
)
def target_matrix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64 bits of the first mask, as a signed number."""
    tm = interventions.target_matrix(_base(spark, sf_dir, "lineitem"), _PREDICATES)
    return tm.select("iid", "mask_0", F.col("mask_1").cast("int").alias("mask_1"))


_AGG = "select l_returnflag, sum(l_extendedprice) as s from lineitem group by l_returnflag"
_AGG_SQL = "b as (select dense_rank() over (order by l_returnflag) - 1 as out, * from li)"


@_query("whatif_dense", f"{_WITH}, {_AGG_SQL}, p as (" + " union all ".join(f"select out, {k // 64} as mid, {k % 64} as k, cast(coalesce(sum(case when {p} then {_VALUE} else 0 end), 0) as double) as v, '{p.replace(chr(39), chr(39) * 2)}' as pred from b group by out" for k, p in enumerate(_PREDICATES)) + ") select out, mid, k, v, pred from (select *, row_number() over (partition by mid order by v desc, out, k) as place from p) where place <= 3")
def whatif_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    # output ids in order of the result's columns, flags first
    s, block = _block(spark, sf_dir, _AGG)
    base = _base(spark, sf_dir, "lineitem")
    tm, catalog = interventions.target_matrix(base, _PREDICATES), interventions.predicate_catalog(spark, _PREDICATES)
    found = interventions.dense_whatif(block, s.block_columns(0)[0], tm, base, F.expr(_VALUE), catalog, top=3)
    return found.withColumn("v", F.col("v").cast("double"))


@_query("dictionary", "select p_brand as val, cast(row_number() over (order by p_brand) - 1 as int) as code from (select distinct p_brand from part)")
def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.dictionary(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_brand")


@_query("dictionary_encode", f"{_WITH} select rid as iid, cast(dense_rank() over (order by p_brand) - 1 as int) as p_brand_int, cast(dense_rank() over (order by p_size) - 1 as int) as p_size_int from pa")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.dictionary_encode(_base(spark, sf_dir, "part"), ["p_brand", "p_size"])


def _sparse(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    s, block = _block(spark, sf_dir, _AGG)
    rid = F.col(s.block_columns(0)[0])
    code = lambda f: ((rid * f) % n).cast("int")
    return block.select(F.col("output_id").alias("out"), code(7919).alias("eq_predicate"), code(104729).alias("range_predicate"))


def _sparse_sql(n: int = 64) -> str:
    return f"{_WITH}, {_AGG_SQL}, t as (select out, cast((rid * 7919) % {n} as int) as e, cast((rid * 104729) % {n} as int) as r from b)"


@_query("whatif_sparse_nested", f"{_sparse_sql()} select out, k, cast(sum((k <> e)::int) as bigint) as kept from t cross join (select cast(range as int) as k from range(64)) group by out, k")
def whatif_sparse_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.nested_equality(_sparse(spark, sf_dir), 64)


@_query("whatif_sparse_single", f"{_sparse_sql()}, a as (select out, count(*) as total from t group by out) select out, e as eq_predicate, total - count(*) as kept from t join a using (out) group by out, e, total")
def whatif_sparse_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.single_pass_equality(_sparse(spark, sf_dir))


@_query("whatif_range_nested", f"{_sparse_sql()} select out, k, cast(sum((r > k)::int) as bigint) as kept from t cross join (select cast(range as int) as k from range(64)) group by out, k")
def whatif_range_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.nested_range(_sparse(spark, sf_dir), 64)


@_query("whatif_prefix", f"{_sparse_sql()}, c as (select out, r, count(*) as v from t group by out, r) select out, r as range_predicate, cast(sum(v) over (partition by out) - sum(v) over (partition by out order by r) as bigint) as kept from c")
def whatif_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.prefix_range(_sparse(spark, sf_dir))


@_query("whatif_prefix_eq", f"{_sparse_sql()}, c as (select out, e, r, count(*) as v from t group by out, e, r), p as (select *, sum(v) over (partition by out, e order by r) as removed, sum(v) over (partition by out) as total from c) select out, e as eq_predicate, r as range_predicate, cast(removed as bigint) as removed, cast(total - removed as bigint) as kept from p")
def whatif_prefix_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.prefix_equality_range(_sparse(spark, sf_dir))


@_query("whatif_2d", f"{_sparse_sql(16)} select out, k, rk, cast(sum((k = e and r <= rk)::int) as bigint) as removed, cast(sum((not (k = e and r <= rk))::int) as bigint) as kept from t cross join (select cast(range as int) as k from range(16)) cross join (select cast(range as int) as rk from range(16)) group by out, k, rk")
def whatif_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.nested_equality_range(_sparse(spark, sf_dir, 16), 16)


@_query("whatif_sparse_nested_1024", f"{_sparse_sql(1024)} select out, k, cast(sum((k <> e)::int) as bigint) as kept from t cross join (select cast(range as int) as k from range(1024)) group by out, k")
def whatif_sparse_nested_1024(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.nested_equality(_sparse(spark, sf_dir, 1024), 1024)


@_query("whatif_sparse_single_1024", f"{_sparse_sql(1024)}, a as (select out, count(*) as total from t group by out) select out, e as eq_predicate, total - count(*) as kept from t join a using (out) group by out, e, total")
def whatif_sparse_single_1024(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.single_pass_equality(_sparse(spark, sf_dir, 1024))


@_query("whatif_range_nested_1024", f"{_sparse_sql(1024)} select out, k, cast(sum((r > k)::int) as bigint) as kept from t cross join (select cast(range as int) as k from range(1024)) group by out, k")
def whatif_range_nested_1024(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.nested_range(_sparse(spark, sf_dir, 1024), 1024)


@_query("whatif_prefix_1024", f"{_sparse_sql(1024)}, c as (select out, r, count(*) as v from t group by out, r) select out, r as range_predicate, cast(sum(v) over (partition by out) - sum(v) over (partition by out order by r) as bigint) as kept from c")
def whatif_prefix_1024(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.prefix_range(_sparse(spark, sf_dir, 1024))


@_query("whatif_2d_64", f"{_sparse_sql()}, c as (select out, e, r, count(*) as v from t group by out, e, r), g as (select out, k, rk, sum(v) as total, sum(case when k = e and r <= rk then v else 0 end) as removed from c cross join (select cast(range as int) as k from range(64)) cross join (select cast(range as int) as rk from range(64)) group by out, k, rk) select out, k, rk, cast(removed as bigint) as removed, cast(total - removed as bigint) as kept from g")
def whatif_2d_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interventions.nested_equality_range(_sparse(spark, sf_dir), 64)


@_query(
    "whatif_statement",
    f"""{_WITH}, b as (select dense_rank() over (order by n_name) - 1 as out, n_name, c_mktsegment as m, c_acctbal * 2 as x from cu join na on c_nationkey = n_nationkey where c_acctbal > 0),
    c as (select out, m, sum(x) as s from b where out in (1, 4) group by out, m), z as (select out, sum(s) as s from c group by out),
    g as (select 'customer_c_mktsegment=' || k.m as predicate, z.out, z.s - coalesce(c.s, 0) as g from (select distinct m from c) k cross join z left join c on c.m = k.m and c.out = z.out)
    select predicate, round(max(case when out = 1 then g end), 3) as g0, round(max(case when out = 4 then g end), 3) as g1 from g group by predicate""",
)
def whatif_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement forms, over an expression and a join."""
    s = _session(spark, sf_dir, sql="customer nation")
    s.set_provenance(True)
    s.sql("select n_name, sum(c_acctbal * 2) as t from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0 group by n_name")
    s.sql("PRAGMA Whatif(0, 0, [1, 4], ['customer.c_mktsegment'])")
    found = s.sql("select * from whatif_reader(0, 0)")
    named = s._whatifs[0, 0].select("pid", "predicate")
    return found.join(named, "pid").select("predicate", F.round("g0", 3).alias("g0"), F.round("g1", 3).alias("g1"))


# applications: explanations, over events by hour of day

_HOURS = "select hour(ts) as h, avg(value) as a from events group by hour(ts)"
_EVENTS_SQL = f"{_WITH}, b as (select dense_rank() over (order by hour(ts)) - 1 as out, event_type as a, user_id % 10 as u, value as x from ev)"


def _explained(spark: SparkSession, sf_dir: str) -> tuple[ProvenanceSession, DataFrame, DataFrame]:
    s, block = _block(spark, sf_dir, _HOURS)
    return s, block, _base(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 10)


@_query("explain_whatif", f"{_EVENTS_SQL}, t as (select out, a, count(*) as n, sum(x) as s from b where out in (2, 5) group by out, a), z as (select out, sum(n) as n, sum(s) as s from t group by out), g as (select 'event_type=' || k.a as predicate, z.out, (z.s - coalesce(t.s, 0)) / (z.n - coalesce(t.n, 0)) as g from (select distinct a from t) k cross join z left join t on t.a = k.a and t.out = z.out) select predicate, round(max(case when out = 2 then g end), 6) as g0, round(max(case when out = 5 then g end), 6) as g1 from g group by predicate")
def explain_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block, base = _explained(spark, sf_dir)
    out = explain.whatif(block, s.block_columns(0)[0], base, "avg", "value", [2, 5], ["event_type"])
    return out.select("predicate", F.round("g0", 6).alias("g0"), F.round("g1", 6).alias("g1"))


_GIVEN = "(values (0, 10.0, 12.0, 30.0, 41.0), (1, 11.0, 9.5, 22.0, 45.0), (2, 10.5, 10.0, null, 28.0), (3, 14.0, 10.0, 35.0, 30.0)) as r(pid, g0, g1, g2, g3)"


@_query("explain_score", f"with r as (select * from {_GIVEN}), good as (select pid, unnest([abs(g0 - 10)**0.5, abs(g1 - 10)**0.5]) as y from r), bad as (select pid, unnest([coalesce(40 - g2, 0)**2, coalesce(50 - g3, 0)**2]) as y from r), g as (select pid, max(y) as y from good group by pid), b as (select pid, median(y) as m from bad group by pid) select cast(pid as bigint) as pid, round(m / 45.0 / 2 - y / 10.0, 9) as score from g join b using (pid)")
def explain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = spark.sql(f"select cast(pid as bigint) as pid, cast(g0 as double) as g0, cast(g1 as double) as g1, cast(g2 as double) as g2, cast(g3 as double) as g3 from {_GIVEN}")
    return explain.score(results, [10.0, 10.0], [40.0, 50.0]).select("pid", F.round("score", 9).alias("score"))


_SPECS = {"event_type": "'event_type=' || a", "bucket": "'bucket=' || u", "event_type,bucket": "'event_type=' || a || ' AND bucket=' || u"}


def _search_sql() -> str:
    parts, found = [], []
    for i, (spec, label) in enumerate(_SPECS.items()):
        parts.append(f"""c{i} as (select out, {label} as predicate, count(x) as n, sum(x) as s from t group by all),
    g{i} as (select k.predicate, z.out, case when z.n > coalesce(c.n, 0) then (z.s - coalesce(c.s, 0)) / (z.n - coalesce(c.n, 0)) end as g
        from (select distinct predicate from c{i}) k cross join z left join c{i} c on c.predicate = k.predicate and c.out = z.out)""")
        found.append(f"""select '{spec}' as spec, predicate, median(case when out in (5, 6) then coalesce(60 - g, 0) ** 2 end) / 60 / 2 - max(case when out in (1, 2) then abs(g - 50) ** 0.5 end) / 50 as score
        from g{i} group by predicate""")
    return f"""{_EVENTS_SQL}, t as (select out, coalesce(a, 'NULL') as a, coalesce(cast(u as varchar), 'NULL') as u, x from b where out in (1, 2, 5, 6)), z as (select out, count(x) as n, sum(x) as s from t group by out),
    {", ".join(parts)} select spec, predicate, round(score, 6) as score from ({" union all ".join(found)}) r order by r.score desc, spec, predicate limit 10"""


@_query("explain_search", _search_sql())
def explain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, block, base = _explained(spark, sf_dir)
    specs = [spec.split(",") for spec in _SPECS]
    found = explain.search(block, s.block_columns(0)[0], base, "avg", "value", {1: 50.0, 2: 50.0}, {5: 60.0, 6: 60.0}, specs)
    return found.withColumn("score", F.round("score", 6))


@_query("whatif_rerun", "select hour(ts) as h, round(avg(value), 6) as a from events where not (event_type = 'click') group by hour(ts)")
def whatif_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outputs without what a predicate deletes, from the block; the SQL runs the query again without it."""
    s, block, base = _explained(spark, sf_dir)
    rows = block.withColumnRenamed(s.block_columns(0)[0], "rid").join(base.where("not (event_type = 'click')"), "rid")
    named = s.result(0).select("output_id", "h")
    return rows.groupBy("output_id").agg(F.round(F.avg("value"), 6).alias("a")).join(named, "output_id").select(F.col("h").cast("long").alias("h"), "a")
