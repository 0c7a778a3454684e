"""Queries of the sets of examples and of what is measured of answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graintide.operators import builders, convo, sqltext, traces
from graintide.plans import chat, sqlcases
from graintide.plans.instruct import by_character
from graintide.session import dealt, staged, table

QUERIES: dict = {}
ORACLES: dict = {}

DOMAINS = ["retail banking", "poetry", "oceanography", "freight and trade", "history", "arts and culture"]
HELD_OUT = ["oceanography", "arts and culture"]
TASKS = ["analytics and reporting", "data retrieval", "data retrieval", "data manipulation", "data definition", "other", None]
PROMPTS = ["  Which orders has customer {k}?\n", "List the orders of customer {k}.", "Orders of {k}, please", "Change customer {k}.", " \n ", None]
STATEMENTS = [
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = {k};", "select o_orderkey, o_totalprice from orders where o_custkey = {k} ; ;", "WITH x AS (SELECT 1) SELECT * FROM x -- drop",
    "INSERT INTO orders VALUES ({k})", "update customer set c_name = 'x' where c_custkey = {k}", "DROP TABLE IF EXISTS orders", "SELECT 1; SELECT 2", "delete from customer where c_custkey = {k}", None,
]


def drawn(options: list[str | None], seed: str) -> str:
    """The SQL of sqltext.pick by c_custkey, with the key filled in."""
    at = f"1 + CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) % 1000000 % {len(options)}"
    return f"replace(([{sqlcases.listed(options)}])[{at}], '{{k}}', CAST(c_custkey AS VARCHAR))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each customer, of varied kinds."""
    key = F.col("c_custkey")

    def one(options: list, seed: str) -> Column:
        return F.replace(sqltext.pick(F.array(*map(F.lit, options)), key, seed), F.lit("{k}"), key.cast("string"))

    return dealt(table(spark, sf_dir, "customer").select(key)).select(
        key.alias("id"), one(DOMAINS, "domain").alias("domain"), one(TASKS, "task").alias("task_type"), one(PROMPTS, "prompt").alias("prompt"),
        one(sqlcases.SCRIPTS, "script").alias("context"), one(STATEMENTS, "statement").alias("sql"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the statements of all customers give, by one aggregation of orders."""
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seed"), place.alias("pos"), "o_orderkey", "o_totalprice")
    return traces.results_shown(rows)


RECORDS = f"""WITH rc AS (SELECT c_custkey AS id, {drawn(DOMAINS, 'domain')} AS domain, {drawn(TASKS, 'task')} AS task_type, trim(coalesce({drawn(PROMPTS, 'prompt')}, ''), ' ' || chr(10)) AS question,
   coalesce({drawn(sqlcases.SCRIPTS, 'script')}, '') AS s, coalesce({drawn(STATEMENTS, 'statement')}, '') AS sql FROM customer),
 sp AS (SELECT *, CASE WHEN s = '' THEN [] ELSE list_filter(list_transform({sqlcases.PARTS}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') END AS parts FROM rc),
 sc AS (SELECT *, array_to_string(list_transform(list_filter(parts, lambda x: starts_with(lower(x), 'create')), lambda x: x || ';'), chr(10)) AS schema, {chat.PLAIN.replace('(s,', '(sql,')} AS p, {chat.PLAIN} AS ps FROM sp),
 jr AS (SELECT *, CASE WHEN task_type IS NULL OR task_type NOT IN ('analytics and reporting', 'data retrieval') THEN 'task_type' WHEN question = '' THEN 'no_question'
   WHEN NOT (regexp_matches(p, '^\\s*(select|with)\\b') AND NOT contains(p, ';') AND NOT regexp_matches(p, '\\b({'|'.join(sqltext.FORBIDDEN)})\\b')) THEN 'not_read_only'
   WHEN regexp_matches(ps, '\\b({'|'.join(sqltext.FORBIDDEN_SCRIPT)})\\b') THEN 'forbidden_script' WHEN schema = '' THEN 'no_schema' ELSE '' END AS reason FROM sc),
 nr AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY ALL),
 ex AS (SELECT jr.* EXCLUDE (reason), CASE WHEN reason <> '' THEN reason WHEN n IS NULL THEN 'no_rows' WHEN n > {traces.MOST_ROWS} THEN 'truncated' ELSE '' END AS reason FROM jr LEFT JOIN nr USING (id))"""
_VAL = "CASE WHEN CAST('0x' || substr(md5(CAST(id AS VARCHAR) || ':val'), 1, 8) AS BIGINT) % 10000 < {} THEN 'val' ELSE 'train' END"
_HELD = f"coalesce(domain IN ({sqlcases.listed(HELD_OUT)}), false)"
_TARGET = f"regexp_matches(domain, '{'|'.join(sqltext.TARGET_DOMAINS)}')"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _made(spark, sf_dir) -> DataFrame:
    return builders.sql_examples(records(spark, sf_dir), results(spark, sf_dir))


@query(RECORDS + " SELECT id, reason, CASE WHEN reason = '' THEN '<|schema|>' || chr(10) || schema || chr(10) || '<|/schema|>' || chr(10) || question || '<|sql|>' || chr(10) || regexp_replace(trim(sql), '[;\\s]*$', '') || chr(10) || '<|/sql|>' END AS asked FROM ex")
def sql_set_examples(spark, sf_dir):
    """Records with the reason why they are left out, or the question and call of their example."""
    said = lambda k: F.get("turns", F.lit(k))["text"]
    return _made(spark, sf_dir).select("id", "reason", F.concat(said(1), said(2)).alias("asked"))


CAPS = (20, 30)


@query(RECORDS + f""", cp AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY md5(CAST(id AS VARCHAR) || ':domain'), id) AS r FROM ex WHERE reason = ''),
 sl AS (SELECT domain, CASE WHEN {_HELD} THEN 'test_unseen' ELSE {_VAL.format(2000)} END AS split FROM cp WHERE {_HELD} OR r <= CASE WHEN {_TARGET} THEN {CAPS[1]} ELSE {CAPS[0]} END)
 SELECT split, count(*) AS examples, count(*) FILTER ({_TARGET}) AS target_examples, count(DISTINCT domain) AS domains FROM sl GROUP BY split""")
def sql_set_report(spark, sf_dir):
    """Examples of the splits, with a share of a fifth kept aside."""
    made = _made(spark, sf_dir).where("reason = ''")
    return builders.split_report(builders.split_domains(made, HELD_OUT, *CAPS, 0.2))


def _cascade() -> str:
    """The three selections of refusal_set for a side, written out."""
    def side(name: str, rows: str, q: tuple, split: str) -> str:
        return f""", {name}0 AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':cascade'), id) AS k FROM ab WHERE {rows}),
 {name}1 AS (SELECT * FROM {name}0 WHERE refused ORDER BY k LIMIT {q[0]}), {name}2 AS (SELECT *, row_number() OVER (PARTITION BY schema ORDER BY k) AS f FROM {name}0 WHERE schema IS NOT NULL AND id NOT IN (SELECT id FROM {name}1)),
 {name}3 AS (SELECT * FROM {name}2 WHERE f = 1 AND vague ORDER BY k LIMIT {q[1]}), {name}4 AS (SELECT * FROM {name}2 WHERE f = 1 AND lacking AND id NOT IN (SELECT id FROM {name}3) ORDER BY k LIMIT {q[2]}),
 {name} AS (SELECT id, 'refusal' AS kind, {split} AS split FROM {name}1 UNION ALL SELECT id, 'clarify', {split} FROM {name}3 UNION ALL SELECT id, 'missing', {split} FROM {name}4)"""

    free = sqlcases.FREE.replace("lower(s)", "lower(schema)")
    tables = sqlcases.TABLES.split(", ts AS", 1)[1].replace("p_partkey", "id").replace("FROM st ", "FROM rp ")
    return RECORDS + f""", rp AS (SELECT id, domain, question, sql, p, schema AS whole, coalesce(task_type IN ({sqlcases.listed(sqltext.WRITE_TASKS)}), false) AS writes, parts FROM sc), ts AS{tables},
 bt AS (SELECT id, bool_or(len({sqlcases.MEASURES}) >= 2) AS vague FROM tc GROUP BY id),
 ab AS (SELECT id, domain, CASE WHEN NOT writes AND whole <> '' THEN whole END AS schema, writes AND question <> '' AND whole <> '' AND regexp_matches(sql, '(?i)^\\s*({'|'.join(sqltext.VERBS)})\\s') AS refused,
   coalesce(vague, false) AND NOT writes AS vague, NOT writes AND bt.id IS NOT NULL AND len({free}) > 0 AS lacking FROM rp LEFT JOIN bt USING (id))
 {side('tr', f'NOT {_HELD}', QUOTAS, _VAL.format(2000))} {side('un', _HELD, (UNSEEN,) * 3, "'test_unseen'")} SELECT * FROM tr UNION ALL SELECT * FROM un"""


QUOTAS, UNSEEN = (40, 6, 5), 3


@query(_cascade())
def refusal_set(spark, sf_dir):
    """Which records become refusals, questions back and answers without data, within small quotas."""
    return builders.refusal_set(records(spark, sf_dir), HELD_OUT, QUOTAS, UNSEEN, 0.2).select("id", "kind", "split")


GENERAL = {"s0": 20, "s1": 30, "s3": 10_000}


@query(chat.GROUPED + f""", z AS (SELECT conv_id, CAST(sum(length(text)) + 5 + 5 + sum(length(CASE role WHEN 'system' THEN '<|system|>' WHEN 'user' THEN '<|user|>' ELSE '<|assistant|>' END)) + 0 AS BIGINT) AS n FROM conversations GROUP BY conv_id),
 v AS (SELECT conv_id AS id, 's' || conv_id % 4 AS source, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY md5(CAST(conv_id AS VARCHAR) || ':cap'), conv_id) AS r, n FROM r JOIN z USING (conv_id) WHERE reason = '' AND n + 4 <= 1500)
 SELECT id, source, {_VAL.format(1000)} AS split FROM v WHERE r <= CASE source WHEN 's0' THEN 20 WHEN 's1' THEN 30 WHEN 's3' THEN 10000 ELSE 0 END""")
def general_set(spark, sf_dir):
    """Valid conversations of up to 1,500 characters within the caps of their sources."""
    named = convo.turns_of(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("id"), F.concat(F.lit("s"), (F.col("conv_id") % 4).cast("string")).alias("source"), "turns")
    return builders.general_set(named, GENERAL, by_character, 1500, 0.1).select("id", "source", "split")


def _ranked(spark, sf_dir) -> DataFrame:
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return staged(table(spark, sf_dir, "orders").select("o_custkey", place.alias("pos"), "o_orderkey", "o_orderpriority"), "ranked")


@query("""WITH g AS (SELECT o_custkey, list(o_orderkey || o_orderpriority ORDER BY o_orderdate, o_orderkey) AS a, list(o_orderkey || CASE WHEN o_custkey % 4 = 1 AND o_orderkey % 5 = 0 THEN '?' ELSE o_orderpriority END ORDER BY CASE WHEN o_custkey % 4 = 2 THEN o_orderkey END, o_orderdate, o_orderkey)
   FILTER (NOT (o_custkey % 4 = 3 AND o_orderkey % 7 = 0)) AS b FROM orders GROUP BY o_custkey)
 SELECT CASE o_custkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'cells' WHEN 2 THEN 'order' ELSE 'rows' END AS template, count(*) AS n, floor(avg(CAST(coalesce(a = b, false) AS INT)) * 1e6 + 0.5) / 1e6 AS matching FROM g GROUP BY 1
 UNION ALL SELECT NULL, count(*), floor(avg(CAST(coalesce(a = b, false) AS INT)) * 1e6 + 0.5) / 1e6 FROM g""")
def ordered_match_rates(spark, sf_dir):
    """Each customer's orders by date against the same, other cells, another order and fewer rows."""
    gold = _ranked(spark, sf_dir)
    kind = F.col("o_custkey") % 4
    other = gold.where(~((kind == 3) & (F.col("o_orderkey") % 7 == 0)))
    order = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.when(kind == 2, F.col("o_orderkey")), "pos"))
    given = other.select("o_custkey", order.alias("pos"), F.col("o_orderkey").cast("string").alias("k"), F.when((kind == 1) & (F.col("o_orderkey") % 5 == 0), "?").otherwise(F.col("o_orderpriority")).alias("p"))
    named = F.get(F.array(*map(F.lit, ("same", "cells", "order", "rows"))), kind.cast("int"))
    outputs = gold.select("o_custkey").distinct().select("o_custkey", named.alias("template"), F.lit("ran").alias("status"), F.lit(True).alias("strict"))
    return builders.ordered_rates(builders.ordered_matches(gold, given, "o_custkey"), outputs, "o_custkey").select("template", "n", "matching")


OUTPUTS = ["<|insight|>\nI can't do that.", "<|insight|>\nCould you CLARIFY?", "<|sql|>\nSELECT 1\n<|/sql|><|insight|> no data about it", "<|insight|>\nThere is no data about {c}.", "I cannot", None]


@query(f"""WITH o AS (SELECT ['refusal', 'missing', 'clarify', 'other'][1 + c_custkey % 4] AS kind, {drawn(OUTPUTS, 'output')} AS text FROM customer),
 w AS (SELECT kind, coalesce(contains(text, '<|sql|>'), false) AS calls, coalesce(contains(text, '<|insight|>') AND NOT contains(text, '<|sql|>') AND regexp_matches(lower(text), CASE kind WHEN 'refusal' THEN 'read-only|can''t|cannot|not able' WHEN 'missing' THEN 'no data about' ELSE 'clarify' END), false) AS fine FROM o WHERE kind <> 'other')
 SELECT kind, count(*) AS n, floor(avg(CAST(fine AS INT)) * 1e6 + 0.5) / 1e6 AS correct, floor(avg(CAST(calls AS INT)) * 1e6 + 0.5) / 1e6 AS wrote_sql FROM w GROUP BY kind""")
def behaviour_rates(spark, sf_dir):
    """Answers of varied kinds to a request of each customer."""
    key = F.col("c_custkey")
    kind = F.get(F.array(*map(F.lit, ("refusal", "missing", "clarify", "other"))), (key % 4).cast("int"))
    return builders.behaviour(table(spark, sf_dir, "customer").select(kind.alias("kind"), F.replace(sqltext.pick(F.array(*map(F.lit, OUTPUTS)), key, "output"), F.lit("{k}"), key.cast("string")).alias("text")))
