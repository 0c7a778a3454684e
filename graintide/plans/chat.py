"""Conversation and SQL-checking queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graintide.functions import quality as Q
from graintide.functions import text as T
from graintide.operators import convo, sqlcheck, sqltext
from graintide.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def turns(spark, sf_dir):
    return convo.turns_of(table(spark, sf_dir, "conversations"))


GROUPED = """WITH c AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, bool_or(trim(coalesce(text, '')) = '') AS hole,
 bool_or(length(text) > 0 AND length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) < 0.97) AS odd FROM conversations GROUP BY conv_id),
 r AS (SELECT conv_id, CASE WHEN hole THEN 'empty_turn' WHEN regexp_matches(roles, 'user$') THEN 'ends_with_user'
 WHEN NOT regexp_matches(roles, '^(system,)?user,assistant(,user,assistant)*$') THEN 'bad_order' WHEN coalesce(odd, false) THEN 'not_ascii' ELSE '' END AS reason FROM c)"""


@query(GROUPED + " SELECT conv_id, reason FROM r")
def convo_drop_reason(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", convo.drop_reason(F.col("turns")).alias("reason"))


@query(GROUPED + " SELECT reason, count(*) AS n FROM r GROUP BY reason")
def convo_valid(spark, sf_dir):
    return convo_drop_reason(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, md5(replace(text, '<|', '< |')) AS text_md5 FROM conversations")
def convo_neutralised(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.neutralise_specials(F.col("text"))).alias("text_md5"))


@query("SELECT conv_id, turn, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1) >= 0.97 OR length(text) = 0 AS ascii FROM conversations")
def convo_mostly_ascii(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", Q.mostly_ascii(F.col("text")).alias("ascii"))


@query("SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY turn)) AS chat_md5, CAST(sum(CASE WHEN role = 'assistant' THEN length(replace(text, '<|', '< |')) ELSE 0 END) AS BIGINT) AS trained_chars FROM conversations GROUP BY conv_id")
def convo_render(spark, sf_dir):
    made = turns(spark, sf_dir).select("conv_id", convo.render(F.col("turns")).alias("r"))
    total = F.aggregate("r.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return made.select("conv_id", F.md5("r.text").alias("chat_md5"), total.alias("trained_chars"))


@query("SELECT conv_id, turn, trim(text) AS block FROM conversations WHERE role = 'assistant'")
def extract_blocks(spark, sf_dir):
    tagged = table(spark, sf_dir, "conversations").where("role = 'assistant'").withColumn("text", F.concat(F.lit("<x> </y><sql> "), F.col("text"), F.lit(" </sql><sql>b</sql>")))
    return tagged.select("conv_id", "turn", T.extract_block(F.col("text"), "sql").alias("block"))


BATCH_TOKENS = 20_000


@query(f"""WITH RECURSIVE s AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (ORDER BY least(n, {BATCH_TOKENS} + 1), conv_id) AS i FROM s),
g AS (SELECT i, conv_id, n, CAST(0 AS BIGINT) AS batch_id, 1 AS filled FROM r WHERE i = 1 UNION ALL
SELECT r.i, r.conv_id, r.n, CASE WHEN r.n * (filled + 1) > {BATCH_TOKENS} THEN batch_id + 1 ELSE batch_id END, CASE WHEN r.n * (filled + 1) > {BATCH_TOKENS} THEN 1 ELSE filled + 1 END FROM g JOIN r ON r.i = g.i + 1)
SELECT conv_id, n, batch_id FROM g""")
def length_bucket_batches(spark, sf_dir):
    sized = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("n"))
    return convo.token_batches(sized, "n", "conv_id", BATCH_TOKENS)


CASES = [
    "SELECT 1", "select a from t; drop table t", "WITH x AS (SELECT 1) SELECT * FROM x;", "DELETE FROM t", "select 'drop table' as s", "/* note */ select 2 -- update", "explain select 1", "select * from t where a = \"x;y\"", "SELECT create_time FROM t",
    "select `drop` from t", "select 1;;", "select 1; ;", "", "select ';' || `a;b` from t",
]
CASE_LIST = ", ".join("'{}'".format(s.replace("'", "''")) for s in CASES)
PLAIN = r'''regexp_replace(trim(lower(regexp_replace(regexp_replace(regexp_replace(s, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '\x27[^\x27]*\x27|"[^"]*"|`[^`]*`', '', 'g'))), '[;\s]*$', '')'''


@query(f"SELECT o_orderkey, coalesce(regexp_matches(p, '^\\s*(select|with)\\b') AND NOT contains(p, ';') AND NOT regexp_matches(p, '\\b({'|'.join(sqltext.FORBIDDEN)})\\b'), false) AS ok FROM (SELECT o_orderkey, {PLAIN} AS p FROM (SELECT o_orderkey, ([{CASE_LIST}])[1 + o_orderkey % {len(CASES)}] || CASE WHEN o_custkey % 3 = 0 THEN ' -- ' || o_custkey ELSE '' END AS s FROM orders))")
def sql_read_only_gate(spark, sf_dir):
    """A statement for each order, one in three with a remark."""
    s = F.concat(F.get(F.array(*map(F.lit, CASES)), (F.col("o_orderkey") % len(CASES)).cast("int")), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit(" -- "), F.col("o_custkey").cast("string"))).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", sqltext.is_read_only(s).alias("ok"))


VOTES = "WITH v AS (SELECT o_custkey AS case_id, o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS sql, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS signature FROM orders), g AS (SELECT case_id, signature, count(*) AS votes, arg_min(sql, pos) AS sql, min(pos) AS pos FROM v WHERE signature IS NOT NULL GROUP BY ALL)"


@query(VOTES + " SELECT case_id, sql, votes, executed, signature FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY votes DESC, pos) AS r, CAST(sum(votes) OVER (PARTITION BY case_id) AS BIGINT) AS executed FROM g) WHERE r = 1")
def vote_majority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return sqlcheck.vote(o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("sql"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("signature")))


RECORDS = "SELECT quality, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 3 = 0 THEN 'match' WHEN doc_id % 7 = 0 THEN 'match_rounding' ELSE 'mismatch' END AS status, doc_id % 2 = 0 AS format_ok, CASE WHEN doc_id % 4 = 0 THEN toxic = 0 END AS faithful FROM labels"


@query(f"SELECT quality, count(*) AS n, floor(avg(CAST(status = 'match' AS INT)) * 1e6 + 0.5) / 1e6 AS strict, floor(avg(CAST(status IN ('match', 'match_rounding') AS INT)) * 1e6 + 0.5) / 1e6 AS tolerant, floor(avg(CAST(status NOT IN ('no_sql', 'error') AS INT)) * 1e6 + 0.5) / 1e6 AS executed, floor(avg(CAST(format_ok AS INT)) * 1e6 + 0.5) / 1e6 AS format_rate, floor(coalesce(avg(CAST(faithful AS INT)), 0) * 1e6 + 0.5) / 1e6 AS faithful_rate FROM ({RECORDS}) GROUP BY quality")
def judge_rates(spark, sf_dir):
    table(spark, sf_dir, "labels").createOrReplaceTempView("labels")
    return sqlcheck.rates(spark.sql(RECORDS), "quality")


@query("""SELECT NOT EXISTS (SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL SELECT o_orderkey, o_totalprice FROM orders) AS same,
 NOT EXISTS (SELECT o_orderkey, o_totalprice FROM orders EXCEPT ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1) AS differs,
 NOT EXISTS (SELECT round(o_totalprice, 4) FROM orders EXCEPT ALL SELECT round(o_totalprice + 0.00001, 4) FROM orders) AS rounded""")
def results_equal(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    price = o.select("o_totalprice")
    found = [sqlcheck.frames_equal(o, o.orderBy(F.desc("o_orderkey"))), sqlcheck.frames_equal(o, o.where("o_orderkey > 1")), sqlcheck.frames_equal(price, price.select(F.col("o_totalprice") + 0.00001))]
    return spark.createDataFrame([tuple(found)], "same boolean, differs boolean, rounded boolean")
