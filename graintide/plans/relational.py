"""The relational workload: grouped, joined, banded and dated reports over the star schema.

Each report is one statement that both engines read; Spark plans it over parquet views of the folder.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from graintide.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def r2(x: str) -> str:
    return f"floor(({x}) * 1e2 + 0.5) / 1e2"


SHIP_MONTH = "(year(l_shipdate) * 100 + month(l_shipdate))"
MONTH = "(year(o_orderdate) * 100 + month(o_orderdate))"
DAYS = "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))"
LATE = "CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 60 THEN 1 ELSE 0 END"
CANCELLED = "100.0E0 * sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) / count(*)"
BAND = "CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END"
SQL: dict[str, str] = {
    "rel_orders_per_segment": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "rel_top_customers": f"SELECT c_custkey, c_name, {r2('sum(o_totalprice)')} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY total DESC, c_custkey LIMIT 10",
    "rel_sales_by_supplier_nation": f"SELECT n_name, {r2('sum(l_extendedprice)')} AS sales, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "rel_customers_by_region": "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "rel_late_rate_by_segment": f"SELECT c_mktsegment, {r6(f'avg({LATE})')} AS late_rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "rel_monthly_orders": f"SELECT {MONTH} AS month, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY {MONTH}",
    "rel_yearly_revenue": f"SELECT year(l_shipdate) AS y, {r2('sum(l_extendedprice * (1 - l_discount))')} AS revenue FROM lineitem GROUP BY year(l_shipdate)",
    "rel_customers_many_orders": "SELECT c_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) > 12",
    "rel_order_size_bands": f"SELECT {BAND} AS band, count(*) AS n, {r2('avg(o_totalprice)')} AS mean FROM orders GROUP BY {BAND}",
    "rel_largest_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "rel_parts_per_supplier": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey",
    "rel_average_balance": f"SELECT {r6('avg(c_acctbal)')} AS mean FROM customer",
    "rel_net_by_returnflag": f"""SELECT l_returnflag, {r2("sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE -l_extendedprice END)")} AS net FROM lineitem GROUP BY l_returnflag""",
    "rel_low_balance_suppliers": "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal < 0",
    "rel_late_count": f"SELECT sum({LATE}) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "rel_ship_days_by_flag": f"SELECT l_returnflag, {r6(f'avg({DAYS})')} AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag",
    "rel_value_by_brand": f"SELECT p_brand, {r2('sum(l_quantity * p_retailprice)')} AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "rel_max_order_per_status": "SELECT o_orderstatus, max(o_totalprice) AS largest, min(o_totalprice) AS smallest FROM orders GROUP BY o_orderstatus",
    "rel_priority_share": f"SELECT o_orderpriority, {r6('count(*) * 1.0E0 / (SELECT count(*) FROM orders)')} AS share FROM orders GROUP BY o_orderpriority",
    "rel_open_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "rel_large_order_count": "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000",
    "rel_supplier_count_by_nation": "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "rel_suppliers_late_often": f"SELECT l_suppkey, sum({LATE}) AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey HAVING sum({LATE}) > 3",
    "rel_repeat_ratio": f"SELECT l_linestatus, {r6('sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)')} AS ratio FROM lineitem GROUP BY l_linestatus",
    "rel_year_status": "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY year(o_orderdate), o_orderstatus",
    "rel_cheapest_parts": "SELECT p_partkey, p_retailprice FROM part WHERE p_size IS NOT NULL ORDER BY p_retailprice, p_partkey LIMIT 10",
    "rel_distinct_types": "SELECT DISTINCT p_type FROM part",
    "stats_corr": f"SELECT {r6('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem",
    "stats_weighted_avg": f"SELECT l_returnflag, {r6('sum(l_discount * l_extendedprice) / sum(l_extendedprice)')} AS discount FROM lineitem GROUP BY l_returnflag",
    "stats_zscore_outliers": "SELECT count(*) AS n FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) z WHERE abs(o_totalprice - m) > 2 * s",
    "share_of_total": f"SELECT l_linestatus, {r6('sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem)')} AS share FROM lineitem GROUP BY l_linestatus",
    # further shapes: tops, rates, bands, months, values and single numbers over each table
    "rel_top_suppliers_by_orders": "SELECT s_suppkey, s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name ORDER BY n DESC, s_suppkey LIMIT 7",
    "rel_balance_by_nation": f"SELECT n_name, {r2('avg(s_acctbal)')} AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "rel_on_time_rate": f"SELECT s_suppkey, {r6(f'100.0E0 * sum(1 - {LATE}) / count(*)')} AS pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderstatus = 'F' GROUP BY s_suppkey",
    "rel_below_quantity": "SELECT p_partkey, p_name, sum(l_quantity) AS q, p_size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_size HAVING sum(l_quantity) < 100 * p_size",
    "rel_value_by_nation": f"SELECT n_name, {r2('sum(l_quantity * p_retailprice)')} AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "rel_sales_by_flag_in_year": f"SELECT l_returnflag, {r2('sum(l_extendedprice)')} AS sales FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY l_returnflag",
    "rel_orders_per_status": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "rel_discount_error": f"SELECT p_partkey, p_name, {r6('100.0E0 * avg(abs(l_extendedprice - l_quantity * p_retailprice) / l_extendedprice)')} AS pct FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0 GROUP BY p_partkey, p_name ORDER BY pct DESC, p_partkey LIMIT 9",
    "rel_spend_by_type": f"SELECT p_type, {r2('sum(l_extendedprice)')} AS spend FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type",
    "rel_poor_suppliers": "SELECT s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal < 1500 ORDER BY s_acctbal, s_name",
    "rel_use_of_size": f"SELECT p_partkey, {r6('100.0E0 * sum(l_quantity) / (p_size * 1000)')} AS pct FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_size",
    "rel_top_parts_by_quantity": "SELECT p_partkey, p_name, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name ORDER BY q DESC, p_partkey LIMIT 11",
    "rel_open_orders_per_customer": "SELECT c_custkey, c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY c_custkey, c_name",
    "rel_orders_by_month_of_year": f"SELECT {MONTH} AS month, count(*) AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY {MONTH}",
    "rel_average_order_by_nation": f"SELECT n_name, {r2('avg(o_totalprice)')} AS mean FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "rel_balance_by_segment": f"SELECT c_mktsegment, {r2('sum(c_acctbal)')} AS total FROM customer GROUP BY c_mktsegment",
    "rel_top_balances": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
    "rel_average_by_priority": f"SELECT o_orderpriority, {r2('avg(o_totalprice)')} AS mean FROM orders GROUP BY o_orderpriority",
    "rel_discount_by_status": f"SELECT l_linestatus, {r6('avg(l_discount)')} AS rate, count(*) AS n FROM lineitem GROUP BY l_linestatus",
    "rel_risk_bands": "SELECT CASE WHEN c_acctbal < 0 THEN 'owing' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band, count(*) AS n FROM customer GROUP BY CASE WHEN c_acctbal < 0 THEN 'owing' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END",
    "rel_owing_customers": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 12",
    "rel_payments_late_by_priority": f"SELECT o_orderpriority, {r6(f'100.0E0 * sum({LATE}) / count(*)')} AS pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL GROUP BY o_orderpriority",
    "rel_tax_by_year": f"SELECT year(l_shipdate) AS y, {r2('sum(l_extendedprice * l_tax)')} AS tax FROM lineitem GROUP BY year(l_shipdate)",
    "rel_orders_by_origin_year": "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)",
    "rel_cancel_rate_by_customer": f"SELECT c_custkey, {r6(CANCELLED)} AS pct FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey",
    "rel_debit_share_by_flag": f"SELECT l_returnflag, {r6('100.0E0 * sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*)')} AS pct FROM lineitem GROUP BY l_returnflag",
    "rel_late_rate_by_region": f"SELECT r_name, {r6(f'100.0E0 * sum({LATE}) / count(*)')} AS pct FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "rel_max_order_per_customer": "SELECT c_custkey, max(o_totalprice) AS largest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY largest DESC, c_custkey LIMIT 6",
    "rel_stock_value_by_type": f"SELECT p_type, {r2('sum(p_size * p_retailprice)')} AS value FROM part GROUP BY p_type",
    "rel_ratio_by_segment": f"SELECT c_mktsegment, {r6('avg(o_totalprice / c_acctbal)')} AS ratio FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 1 GROUP BY c_mktsegment",
    "rel_monthly_sales": f"SELECT {SHIP_MONTH} AS month, {r2('sum(l_extendedprice)')} AS sales FROM lineitem WHERE year(l_shipdate) IN (1995, 1996) GROUP BY {SHIP_MONTH}",
    "rel_monthly_lines": f"SELECT {SHIP_MONTH} AS month, count(*) AS n FROM lineitem GROUP BY {SHIP_MONTH}",
    "rel_year_and_flag": "SELECT year(l_shipdate) AS y, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY year(l_shipdate), l_returnflag",
    "rel_top_rated_suppliers": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5",
    "rel_suppliers_of_nation": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7",
    "rel_customers_of_region": "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2",
    "rel_parts_of_brand": "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' ORDER BY p_partkey",
    "rel_biggest_parts": "SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 8",
    "rel_costliest_lines": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 9",
    "rel_big_orders": "SELECT count(*) AS n FROM orders WHERE o_totalprice > 300000",
    "rel_small_parts": "SELECT p_partkey, p_size FROM part WHERE p_size < 3 ORDER BY p_size, p_partkey LIMIT 20",
    "rel_total_size": "SELECT sum(p_size) AS total FROM part",
    "rel_highest_discount": "SELECT max(l_discount) AS highest, CASE WHEN min(l_discount) = 0 THEN 0.0E0 ELSE min(l_discount) END AS lowest FROM lineitem",
    "rel_average_discount": f"SELECT {r6('avg(l_discount)')} AS mean FROM lineitem",
    "rel_max_balance_by_segment": "SELECT c_mktsegment, max(c_acctbal) AS largest FROM customer GROUP BY c_mktsegment",
    "rel_lines_per_status": "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY l_linestatus",
    "rel_brand_average_price": f"SELECT p_brand, {r2('avg(p_retailprice)')} AS mean FROM part GROUP BY p_brand",
    "rel_forecast_bias": f"SELECT p_brand, {r6('avg(l_extendedprice - l_quantity * p_retailprice)')} AS bias FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "rel_flag_share": f"SELECT l_returnflag, {r6('count(*) * 1.0E0 / (SELECT count(*) FROM lineitem)')} AS share FROM lineitem GROUP BY l_returnflag",
    "rel_large_lines": "SELECT count(*) AS n FROM lineitem WHERE l_extendedprice > (SELECT avg(l_extendedprice) + 2 * stddev_samp(l_extendedprice) FROM lineitem)",
    "stats_weighted_price": f"SELECT p_brand, {r6('sum(l_quantity * p_retailprice) / sum(l_quantity)')} AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "stats_price_size_corr": f"SELECT {r6('corr(p_retailprice, p_size)')} AS r FROM part",
}


def spark_text(sql: str) -> str:
    """The one spelling that differs: days between two dates."""
    return sql.replace("date_diff('day', ", "date_diff(DAY, ")


def run_report(spark: SparkSession, sf_dir: str, name: str):
    for t in TABLES:
        if t in SQL[name]:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(spark_text(SQL[name]))


QUERIES = {name: (lambda spark, sf_dir, name=name: run_report(spark, sf_dir, name)) for name in SQL}
ORACLES = dict(SQL)
