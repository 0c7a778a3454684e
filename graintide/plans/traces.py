"""Queries of the traces: templates over the star schema, all seeds at once, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.operators import traces
from graintide.operators.traces import Template, Values
from graintide.session import staged, table

QUERIES: dict = {}
ORACLES: dict = {}
SEEDS = 60

TEMPLATES = [
    Template("orders_of_status", "supply", ("How many orders have status {status}?", "Count the orders with status {status}."), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = '{status}'", (), None, {"status": Values(table="orders", column="o_orderstatus")}),
    Template("suppliers_of_nation", "supply", ("Which {n} suppliers of {nation} have the highest balance?", "Top {n} suppliers in {nation} by balance."),
             "SELECT s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = '{nation}'", ("s_acctbal DESC", "s_name"), "n", {"nation": Values(table="nation", column="n_name"), "n": Values(among=(3, 5, 12))}),
    Template("customers_by_segment", "finance", ("How many customers of each segment owe more than {owed}?", "Count customers by segment with a balance below minus {owed}."),
             "SELECT c_mktsegment, count(*) AS customers, round(avg(c_acctbal), 1) AS mean FROM customer WHERE c_acctbal < -{owed} GROUP BY c_mktsegment", ("customers DESC", "c_mktsegment"), None, {"owed": Values(among=(100, 500, 995))}),
]


def _cell(x: str) -> str:
    """The SQL of traces.cell for a fractional number."""
    d = f"CAST({x} AS DECIMAL(38,10))"
    whens = " ".join(f"WHEN abs({d}) < {10 ** (6 - k)} THEN CAST(round({d}, {k}) AS VARCHAR)" for k in range(5, -1, -1))
    return f"coalesce(regexp_replace(CASE {whens} END, '\\.?0+$', ''), 'NULL')"


def _examples() -> str:
    """One relation of examples: template, seed, question, sql, n, shown, said."""
    draw = lambda t, name, n: f"(CAST('0x' || substr(md5('{t}:' || seed || ':{name}'), 1, 8) AS BIGINT) % {n})"
    q = lambda t, a, b: f"CASE WHEN {draw(t, 'question', 2)} = 0 THEN {a} ELSE {b} END"
    many = "CASE WHEN n > 10 THEN 'The query returned ' || n || ' rows; only the first 10 are shown.' ELSE 'The query returned ' || n || ' rows.' END"
    ends = lambda c, hi, lo: f"{many} || ' {c} is highest for ' || {hi}.a || ' (' || {hi}.c || ') and lowest for ' || {lo}.a || ' (' || {lo}.c || ').'"
    shape = lambda head: f"'{head}' || chr(10) || array_to_string(list_transform(rows[1:10], lambda r: r.t), chr(10)) || CASE WHEN n > 10 THEN chr(10) || '(' || (n - 10) || ' more rows)' ELSE '' END"
    high = "list_aggregate(list_transform(rows[1:10], lambda r: {'v': r.v, 'p': -r.p, 'a': r.a, 'c': r.c}), 'max')"
    low = "list_aggregate(list_transform(rows[1:10], lambda r: {'v': r.v, 'p': r.p, 'a': r.a, 'c': r.c}), 'min')"
    listed = "list({'p': p, 'a': a, 'c': c, 'v': v, 't': t} ORDER BY p)"
    one, two, three = (t.name for t in TEMPLATES)
    two_said = f"CASE WHEN n = 1 THEN 'The result is: s_name = ' || rows[1].a || ', s_acctbal = ' || rows[1].c || '.' ELSE {ends('s_acctbal', 'hi', 'lo')} END"
    three_said = f"CASE WHEN n = 1 THEN 'The result is: c_mktsegment = ' || rows[1].a || ', customers = ' || split_part(rows[1].t, ' | ', 2) || ', mean = ' || rows[1].c || '.' ELSE {ends('mean', 'hi', 'lo')} END"
    return f"""WITH seeds AS (SELECT range AS seed FROM range({SEEDS})),
 st AS (SELECT o_orderstatus AS status, row_number() OVER (ORDER BY o_orderstatus) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL)),
 a1 AS (SELECT seed, status FROM seeds JOIN st ON i = {draw(one, 'status', 1000000)} % m),
 e1 AS (SELECT '{one}' AS template, seed, {q(one, "'How many orders have status ' || status || '?'", "'Count the orders with status ' || status || '.'")} AS question,
   'SELECT count(*) AS n FROM orders WHERE o_orderstatus = ''' || status || '''' AS sql, 1 AS n, 'n' || chr(10) || k AS shown, 'The result is ' || k || '.' AS said
   FROM a1, LATERAL (SELECT count(*) AS k FROM orders WHERE o_orderstatus = status)),
 na AS (SELECT n_name AS nation, row_number() OVER (ORDER BY n_name) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT n_name FROM nation WHERE n_name IS NOT NULL)),
 a2 AS (SELECT seed, nation, [3, 5, 12][1 + {draw(two, 'n', 3)}] AS cap FROM seeds JOIN na ON i = {draw(two, 'nation', 1000000)} % m),
 r2 AS (SELECT seed, nation, cap, row_number() OVER (PARTITION BY seed ORDER BY s_acctbal DESC, s_name) AS p, s_name AS a, {_cell('s_acctbal')} AS c, CAST(s_acctbal AS DOUBLE) AS v FROM a2 JOIN nation ON n_name = nation JOIN supplier ON s_nationkey = n_nationkey),
 g2 AS (SELECT seed, any_value(nation) AS nation, any_value(cap) AS cap, count(*) AS n, {listed} AS rows FROM (SELECT *, a || ' | ' || c AS t FROM r2 WHERE p <= cap) GROUP BY seed),
 e2 AS (SELECT '{two}', seed, {q(two, "'Which ' || cap || ' suppliers of ' || nation || ' have the highest balance?'", "'Top ' || cap || ' suppliers in ' || nation || ' by balance.'")},
   'SELECT s_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = ''' || nation || ''' ORDER BY s_acctbal DESC, s_name LIMIT ' || cap, n, {shape('s_name | s_acctbal')}, {two_said}
   FROM (SELECT *, {high} AS hi, {low} AS lo FROM g2)),
 a3 AS (SELECT seed, [100, 500, 995][1 + {draw(three, 'owed', 3)}] AS owed FROM seeds),
 r3 AS (SELECT seed, owed, c_mktsegment AS a, count(*) AS customers, round(avg(c_acctbal), 1) AS v FROM a3 JOIN customer ON c_acctbal < -owed GROUP BY ALL),
 g3 AS (SELECT seed, any_value(owed) AS owed, count(*) AS n, {listed} AS rows FROM (SELECT *, a || ' | ' || customers || ' | ' || c AS t FROM (SELECT *, {_cell('v')} AS c, row_number() OVER (PARTITION BY seed ORDER BY customers DESC, a) AS p FROM r3)) GROUP BY seed),
 e3 AS (SELECT '{three}', seed, {q(three, "'How many customers of each segment owe more than ' || owed || '?'", "'Count customers by segment with a balance below minus ' || owed || '.'")},
   'SELECT c_mktsegment, count(*) AS customers, round(avg(c_acctbal), 1) AS mean FROM customer WHERE c_acctbal < -' || owed || ' GROUP BY c_mktsegment ORDER BY customers DESC, c_mktsegment', n, {shape('c_mktsegment | customers | mean')}, {three_said}
   FROM (SELECT *, {high} AS hi, {low} AS lo FROM g3)),
 ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question, sql ORDER BY template, seed) AS nth FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3)) WHERE nth <= {traces.REPEATS})"""


def _views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("orders", "supplier", "nation", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir)
    return traces.template_traces(spark, TEMPLATES, spark.range(SEEDS).withColumnRenamed("id", "seed"), "CREATE TABLE ...;")


def template_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _traces(spark, sf_dir)
    return found.select("id", "question", "sql", F.col("n").cast("long").alias("n"), "shown", "said", F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"))


def repair_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = traces.repair_traces(spark, TEMPLATES, _traces(spark, sf_dir))
    untrained = F.size(F.filter("turns", lambda t: ~t["trained"]))
    return made.select("id", "kind", "broken", F.size("turns").cast("long").alias("turns"), untrained.cast("long").alias("untrained"), (F.length("fault") > 10).alias("failed"))


REPAIRS = """ SELECT template || '-' || seed AS id, kind, CASE kind WHEN 'syntax' THEN regexp_replace(sql, '\\bFROM\\b', 'FORM') WHEN 'table' THEN regexp_replace(sql, '\\b' || tb || '\\b', tb || 's')
  ELSE regexp_replace(sql, '\\b' || col || '\\b', left(col, length(col) - 1)) END AS broken, CAST(7 AS BIGINT) AS turns, CAST(1 AS BIGINT) AS untrained, true AS failed
 FROM ex JOIN (VALUES ('orders_of_status', 'o_orderstatus', 'orders'), ('suppliers_of_nation', 'n_name', 'nation'), ('customers_by_segment', 'c_acctbal', 'customer')) AS u(template, col, tb) USING (template), (VALUES ('column'), ('table'), ('syntax')) AS k(kind)"""


def judged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and status: right, in another order and rounded, wrong for some, failing for some."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    gold = staged(orders.groupBy(F.col("c_nationkey").alias("case_id"), F.col("o_orderstatus").alias("c0")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(20,2)")) / 1000, 3).cast("double").alias("c1")), "gold")
    same = gold.repartition(3, "c1").withColumn("candidate", F.lit("same"))
    rounded = gold.withColumn("c1", (F.floor(F.col("c1") * 10 + 0.5) / 10)).withColumn("candidate", F.lit("rounded"))
    wrong = gold.where("case_id % 5 <> 0 or c0 <> 'F'").withColumn("candidate", F.lit("part"))
    cases = gold.select("case_id").distinct().withColumn("candidate", F.lit("broken"))
    return traces.judged_candidates(gold, same.unionByName(rounded).unionByName(wrong), cases, ["case_id"])


JUDGED = """WITH g AS (SELECT c_nationkey AS case_id, o_orderstatus AS c0, CAST(round(sum(CAST(o_totalprice AS DECIMAL(20,2))) / 1000, 3) AS DOUBLE) AS c1 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 r AS (SELECT case_id, count(*) FILTER (c0 = 'F') AS f, bool_and(floor(c1 * 10 + 0.5) / 10 = c1) AS plain FROM g GROUP BY case_id)
 SELECT case_id, 'same' AS candidate, 'match' AS status FROM r UNION ALL SELECT case_id, 'rounded', CASE WHEN plain THEN 'match' ELSE 'match_rounding' END FROM r
 UNION ALL SELECT case_id, 'part', CASE WHEN case_id % 5 = 0 AND f > 0 THEN 'mismatch' ELSE 'match' END FROM r UNION ALL SELECT case_id, 'broken', 'error' FROM r"""

QUERIES |= {"template_traces": template_traces, "repair_traces": repair_traces, "judged_candidates": judged_candidates}
ORACLES |= {
    "template_traces": _examples() + " SELECT template || '-' || seed AS id, question, sql, CAST(n AS BIGINT) AS n, shown, said, 'system,user,assistant,tool,assistant' AS roles FROM ex",
    "repair_traces": _examples() + REPAIRS,
    "judged_candidates": JUDGED,
}
