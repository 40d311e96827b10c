"""The decision-support workload: 22 queries, over the columns that the given tables have.

Each text runs in Spark SQL and in DuckDB. Where the usual schema has a table or column that these tables
lack, another stands for it: partsupp is derived from lineitem, flags stand for ship and receipt dates,
nations are numbered. Money is summed as decimals, so that sums are exact in any order.
"""

from __future__ import annotations

PRICE = "cast(l_extendedprice as decimal(12,2))"
NET = f"{PRICE} * (1 - cast(l_discount as decimal(4,2)))"
QUANTITY = "cast(l_quantity as decimal(12,2))"
PARTSUPP = f"""(select l_partkey as ps_partkey, l_suppkey as ps_suppkey, min({PRICE}) as ps_supplycost, sum({QUANTITY}) as ps_availqty
    from lineitem group by l_partkey, l_suppkey)"""

QUERIES: dict[str, str] = {
    "q01": f"""select l_returnflag, l_linestatus, cast(sum({QUANTITY}) as double) as sum_qty, cast(sum({PRICE}) as double) as sum_base_price,
        cast(sum({NET}) as double) as sum_disc_price, cast(sum({NET} * (1 + cast(l_tax as decimal(4,2)))) as double) as sum_charge,
        cast(sum({QUANTITY}) as double) / count(*) as avg_qty, count(*) as count_order
        from lineitem where l_shipdate <= cast('1998-09-02' as date) group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
    "q02": f"""select s_acctbal, s_name, n_name, p_partkey, p_brand
        from part, supplier, {PARTSUPP} partsupp, nation, region
        where p_partkey = ps_partkey and s_suppkey = ps_suppkey and p_size between 10 and 20 and p_type like '%PROMO' and s_nationkey = n_nationkey
        and n_regionkey = r_regionkey and r_regionkey = 1 and ps_supplycost = (
            select min(ps_supplycost) from {PARTSUPP} partsupp, supplier, nation, region
            where p_partkey = ps_partkey and s_suppkey = ps_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_regionkey = 1)
        order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
    "q03": f"""select l_orderkey, cast(sum({NET}) as double) as revenue, o_orderdate
        from customer, orders, lineitem
        where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
        and o_orderdate < cast('1998-03-15' as date) and l_shipdate > cast('1998-03-15' as date)
        group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""",
    "q04": """select o_orderpriority, count(*) as order_count from orders
        where o_orderdate >= cast('1996-07-01' as date) and o_orderdate < cast('1996-10-01' as date)
        and exists (select * from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')
        group by o_orderpriority order by o_orderpriority""",
    "q05": f"""select n_name, cast(sum({NET}) as double) as revenue
        from customer, orders, lineitem, supplier, nation, region
        where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey
        and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_regionkey = 2
        and o_orderdate >= cast('1996-01-01' as date) and o_orderdate < cast('1997-01-01' as date)
        group by n_name order by revenue desc""",
    "q06": f"""select cast(sum({PRICE} * cast(l_discount as decimal(4,2))) as double) as revenue from lineitem
        where l_shipdate >= cast('1996-01-01' as date) and l_shipdate < cast('1997-01-01' as date)
        and cast(l_discount as decimal(4,2)) between 0.05 and 0.07 and l_quantity < 24""",
    "q07": f"""select supp_nation, cust_nation, l_year, cast(sum(volume) as double) as revenue from (
            select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as int) as l_year, {NET} as volume
            from supplier, lineitem, orders, customer, nation n1, nation n2
            where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
            and ((n1.n_name = 'NATION_3' and n2.n_name = 'NATION_7') or (n1.n_name = 'NATION_7' and n2.n_name = 'NATION_3'))
            and l_shipdate between cast('1995-01-01' as date) and cast('1998-12-31' as date)) as shipping
        group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year""",
    "q08": f"""select o_year, cast(sum(case when nation = 'NATION_5' then volume else 0 end) as double) / cast(sum(volume) as double) as mkt_share from (
            select cast(extract(year from o_orderdate) as int) as o_year, {NET} as volume, n2.n_name as nation
            from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
            where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey
            and n1.n_regionkey = r_regionkey and r_regionkey = 0 and s_nationkey = n2.n_nationkey
            and o_orderdate between cast('1995-01-01' as date) and cast('1996-12-31' as date) and p_type = 'ECONOMY') as all_nations
        group by o_year order by o_year""",
    "q09": f"""select nation, o_year, cast(sum(amount) as double) as sum_profit from (
            select n_name as nation, cast(extract(year from o_orderdate) as int) as o_year, {NET} - ps_supplycost * {QUANTITY} as amount
            from part, supplier, lineitem, {PARTSUPP} partsupp, orders, nation
            where s_suppkey = l_suppkey and ps_suppkey = l_suppkey and ps_partkey = l_partkey and p_partkey = l_partkey and o_orderkey = l_orderkey
            and s_nationkey = n_nationkey and p_name like '%blue%') as profit
        group by nation, o_year order by nation, o_year desc""",
    "q10": f"""select c_custkey, c_name, cast(sum({NET}) as double) as revenue, c_acctbal, n_name
        from customer, orders, lineitem, nation
        where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= cast('1995-10-01' as date) and o_orderdate < cast('1996-01-01' as date)
        and l_returnflag = 'R' and c_nationkey = n_nationkey
        group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
    "q11": f"""select ps_partkey, cast(sum(ps_supplycost * ps_availqty) as double) as value
        from {PARTSUPP} partsupp, supplier, nation
        where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_8'
        group by ps_partkey having cast(sum(ps_supplycost * ps_availqty) as double) > (
            select cast(sum(ps_supplycost * ps_availqty) as double) * 0.001e0 from {PARTSUPP} partsupp, supplier, nation
            where ps_suppkey = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_8')
        order by value desc, ps_partkey""",
    "q12": """select l_linestatus, cast(sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as bigint) as high_line_count,
        cast(sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as bigint) as low_line_count
        from orders, lineitem where o_orderkey = l_orderkey and l_returnflag in ('A', 'R')
        and l_shipdate >= cast('1996-01-01' as date) and l_shipdate < cast('1997-01-01' as date)
        group by l_linestatus order by l_linestatus""",
    "q13": """select c_count, count(*) as custdist from (
            select c_custkey, count(o_orderkey) as c_count from customer left outer join orders on c_custkey = o_custkey and o_orderpriority not like '%URGENT%'
            group by c_custkey) as c_orders
        group by c_count order by custdist desc, c_count desc""",
    "q14": f"""select cast(100.00 * sum(case when p_type like 'PROMO%' then {NET} else 0 end) as double) / cast(sum({NET}) as double) as promo_revenue
        from lineitem, part where l_partkey = p_partkey and l_shipdate >= date '1995-09-01' and l_shipdate < cast('1995-10-01' as date)""",
    "q15": f"""with revenue0 as (select l_suppkey as supplier_no, sum({NET}) as total_revenue from lineitem
            where l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-01-01' + interval '3' month group by l_suppkey)
        select s_suppkey, s_name, cast(total_revenue as double) as total_revenue from supplier, revenue0
        where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue0) order by s_suppkey""",
    "q16": f"""select p_brand, p_type, p_size, count(distinct ps_suppkey) as supplier_cnt from {PARTSUPP} partsupp, part
        where p_partkey = ps_partkey and p_brand <> 'Brand#45' and p_type not like 'MEDIUM%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)
        and ps_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)
        group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size""",
    "q17": f"""select cast(sum({PRICE}) as double) / 7.0e0 as avg_yearly from lineitem, part
        where p_partkey = l_partkey and p_brand = 'Brand#23' and l_quantity < (select 0.2e0 * avg(l_quantity) from lineitem where l_partkey = p_partkey)""",
    "q18": f"""select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, cast(sum({QUANTITY}) as double) as sum_qty from customer, orders, lineitem
        where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 300) and c_custkey = o_custkey and o_orderkey = l_orderkey
        group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "q19": f"""select cast(sum({NET}) as double) as revenue from lineitem, part
        where (p_partkey = l_partkey and p_brand = 'Brand#12' and l_quantity >= 1 and l_quantity <= 1 + 10 and p_size between 1 and 5)
        or (p_partkey = l_partkey and p_brand = 'Brand#23' and l_quantity >= 10 and l_quantity <= 10 + 10 and p_size between 1 and 10)
        or (p_partkey = l_partkey and p_brand = 'Brand#34' and l_quantity >= 20 and l_quantity <= 20 + 10 and p_size between 1 and 15)""",
    "q20": f"""select s_name, s_acctbal from supplier, nation where s_suppkey in (
            select ps_suppkey from {PARTSUPP} partsupp where ps_partkey in (select p_partkey from part where p_name like '%red%')
            and ps_availqty > (select 0.5 * sum({QUANTITY}) from lineitem where l_partkey = ps_partkey and l_suppkey = ps_suppkey
                and l_shipdate >= cast('1996-01-01' as date) and l_shipdate < cast('1997-01-01' as date)))
        and s_nationkey = n_nationkey and n_name = 'NATION_4' order by s_name""",
    "q21": """select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation
        where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_returnflag = 'R'
        and exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
        and s_nationkey = n_nationkey and n_name = 'NATION_20' group by s_name order by numwait desc, s_name limit 100""",
    "q22": """select cntrycode, count(*) as numcust, cast(sum(cast(c_acctbal as decimal(12,2))) as double) as totacctbal from (
            select substring(cast(c_nationkey + 10 as varchar(2)), 1, 1) as cntrycode, c_acctbal from customer
            where c_nationkey in (13, 1, 3, 9, 10, 18, 17) and cast(c_acctbal as decimal(12,2)) > (
                select sum(cast(c_acctbal as decimal(12,2))) / count(*) from customer where c_acctbal > 0.00 and c_nationkey in (13, 1, 3, 9, 10, 18, 17))
            and not exists (select * from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')) as custsale
        group by cntrycode order by cntrycode""",
}
