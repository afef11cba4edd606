"""Guarded SQL matrix (A8a-A8j): one statement per SQL family, run through the
read-only guard into Spark SQL over the driver tables. The oracle is the very
same statement text executed by DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import support as U
from quire.operators.ranges import interval_join
from quire.plans.registry import register, round_doubles
from quire.sources.tables import read_table, register_views

MATRIX = {
    "sql_join_inner": """SELECT n.n_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name""",
    "sql_join_outer": """SELECT c.c_custkey, c.c_mktsegment, count(o.o_orderkey) AS n_orders,
       round(coalesce(sum(o.o_totalprice), 0), 2) AS total
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey
GROUP BY c.c_custkey, c.c_mktsegment""",
    "sql_semi_anti": """SELECT 'with_orders' AS kind, count(*) AS n FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION ALL
SELECT 'without_orders' AS kind, count(*) AS n FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
    "sql_theta": """SELECT r.r_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN region r
  ON o.o_totalprice >= r.r_regionkey * 100000 AND o.o_totalprice < (r.r_regionkey + 1) * 100000
GROUP BY r.r_name""",
    "sql_agg": """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers,
       round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS avg_discount,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
    "sql_grouping_sets": """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total,
       grouping(o_orderstatus) AS g_status, grouping(o_orderpriority) AS g_priority
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    "sql_window": """SELECT o_custkey, o_orderkey,
       rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS price_rank,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_total,
       lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_order
FROM orders""",
    "sql_setops": """SELECT nationkey, 'both' AS kind FROM (
  SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey AS nationkey FROM customer) x
UNION ALL
SELECT nationkey, 'supplier_only' AS kind FROM (
  SELECT s_nationkey AS nationkey FROM supplier EXCEPT SELECT c_nationkey AS nationkey FROM customer) y
UNION
SELECT n_nationkey AS nationkey, 'region0' AS kind FROM nation WHERE n_regionkey = 0""",
    "sql_cte_topk": """WITH rev AS (
  SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_suppkey)
SELECT s.s_suppkey, s.s_name, round(r.revenue, 2) AS revenue
FROM rev r JOIN supplier s ON s.s_suppkey = r.l_suppkey
ORDER BY r.revenue DESC, s.s_suppkey LIMIT 10""",
    "sql_scalars": """SELECT o_orderkey, year(o_orderdate) AS yr, month(o_orderdate) AS mon, CAST(o_orderdate AS DATE) AS order_day,
       upper(substring(o_orderpriority, 1, 3)) AS prio3, length(o_orderstatus) AS status_len,
       CASE WHEN o_totalprice > 100000 THEN 'large' WHEN o_totalprice > 10000 THEN 'medium' ELSE 'small' END AS size_class,
       CAST(floor(o_totalprice / 1000) AS BIGINT) AS thousands, round(CAST(o_totalprice AS DECIMAL(18,2)) * 1.1, 2) AS with_margin,
       abs(o_custkey - 100) AS dist, concat(o_orderstatus, '-', o_orderpriority) AS label, coalesce(NULL, o_orderstatus) AS st
FROM orders""",
}


def _make(name: str, sql: str):
    def build(spark, sf_dir):
        register_views(spark, sf_dir)
        return U.guarded_sql(spark, sql)

    build.__name__ = name
    return build


for _name, _sql in MATRIX.items():
    register(_name, _sql)(_make(_name, _sql))


@register("sql_theta_bins", MATRIX["sql_theta"])
def sql_theta_bins(spark, sf_dir):
    """The statement of ``sql_theta`` as a join on interval bins."""
    orders, region = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "region")
    k = F.col("r_regionkey")
    found = interval_join(orders, F.col("o_totalprice"), region, k * 100000, (k + 1) * 100000)
    return found.groupBy(F.col("i.r_name").alias("r_name")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("p.o_totalprice"), 2).alias("total"))


BAND = 50


@register(
    "interval_join",
    f"""SELECT s_suppkey, count(*) AS n_customers, round(sum(c_acctbal), 2) AS total, min(c_custkey) AS first_customer
FROM supplier JOIN customer ON c_acctbal >= s_acctbal - {BAND} * (1 + s_suppkey % 4 * s_suppkey % 7) AND c_acctbal < s_acctbal + {BAND}
GROUP BY s_suppkey""",
)
def suppliers_bands(spark, sf_dir):
    """Customers whose balance lies in a band around each supplier's; bands of very different lengths."""
    supplier, customer = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "customer")
    s, k = F.col("s_acctbal"), F.col("s_suppkey")
    totals = {"total": ("sum", F.col("c_acctbal")), "first_customer": ("min", F.col("c_custkey"))}
    found = interval_join(customer, F.col("c_acctbal"), supplier, s - BAND * (1 + k % 4 * k % 7), s + BAND, totals)
    return found.groupBy(F.col("i.s_suppkey").alias("s_suppkey")).agg(F.sum("n").alias("n_customers"), F.round(F.sum("total"), 2).alias("total"), F.min("first_customer").alias("first_customer"))
