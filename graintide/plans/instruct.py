"""Queries of the instruction-data and measuring operators, each over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.functions import text as T
from graintide.operators import convo, dedup, examples, measure, sample, sqlcheck, sqltext
from graintide.session import dealt, fresh_path, small_batches, spread, staged, table
from graintide.sources import datasources, tokenfiles

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def chosen(options: list[str], key: str, seed: str) -> str:
    """The SQL of sqltext.pick over texts."""
    listed = "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"
    return f"({listed})[1 + CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) % 1000000 % {len(options)}]"


# ------------------------------------------------------------------------------------------------ SQL as text
SCRIPT = """concat('CREATE TABLE item_', p_partkey, ' (item_id INT, price DECIMAL(10, 2), qty INTEGER, "label" VARCHAR(20), PRIMARY KEY (item_id, qty));', chr(10),
 'CREATE TABLE IF NOT EXISTS shop_', p_partkey, ' (shop_id INT, item_id INT, ', CASE WHEN p_size % 2 = 0 THEN 'rent REAL, ' ELSE '' END, 'opened DATE, FOREIGN KEY (item_id) REFERENCES item(item_id));', chr(10),
 'INSERT INTO item_', p_partkey, ' VALUES (1, ', p_retailprice, ', ', p_size, ', ''', p_name, '; old'');', chr(10), ' SELECT 1')"""


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with two tables, one row and a query for each part."""
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")).selectExpr("p_partkey", "p_name", "p_size", SCRIPT + " AS script")


@query("SELECT p_partkey, CAST(4 AS BIGINT) AS n, 'INSERT INTO item_' || p_partkey || ' VALUES (1, ' || p_retailprice || ', ' || p_size || ', ''' || p_name || '; old'')' AS third FROM part")
def sql_statements(spark, sf_dir):
    found = scripts(spark, sf_dir).select("p_partkey", sqltext.statements(F.col("script")).alias("s"))
    return found.select("p_partkey", F.size("s").cast("long").alias("n"), F.get("s", F.lit(2)).alias("third"))


@query(f"SELECT p_partkey, md5(string_agg(s || ';', chr(10) ORDER BY k)) AS schema_md5 FROM (SELECT p_partkey, unnest(string_split({SCRIPT}, ';' || chr(10))) AS s, generate_subscripts(string_split({SCRIPT}, ';' || chr(10)), 1) AS k FROM part) WHERE s LIKE 'CREATE%' GROUP BY p_partkey")
def schema_from_script(spark, sf_dir):
    return scripts(spark, sf_dir).select("p_partkey", F.md5(sqltext.schema_of(F.col("script"))).alias("schema_md5"))


@query("""SELECT p_partkey, 'item_' || p_partkey AS "table", 'item_id int,price decimal(10, 2),qty integer,label varchar(20)' AS columns, 'price,qty' AS measures FROM part
 UNION ALL SELECT p_partkey, 'shop_' || p_partkey, 'shop_id int,item_id int,' || CASE WHEN p_size % 2 = 0 THEN 'rent real,' ELSE '' END || 'opened date', CASE WHEN p_size % 2 = 0 THEN 'rent' ELSE '' END FROM part""")
def ddl_tables(spark, sf_dir):
    found = scripts(spark, sf_dir).select("p_partkey", F.inline(sqltext.tables_of(F.col("script"))))
    listed = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"])), ",")
    return found.select("p_partkey", "table", listed.alias("columns"), F.array_join(sqltext.measures(F.col("columns")), ",").alias("measures"))


@query("SELECT p_partkey, 'opened,' || CASE WHEN p_size % 2 = 0 THEN 'rent,' ELSE '' END || 'shop_id' AS missing FROM part")
def foreign_columns(spark, sf_dir):
    used = F.array(F.concat(F.lit("item_"), F.col("p_partkey").cast("string")))
    return scripts(spark, sf_dir).select("p_partkey", F.array_join(sqltext.foreign_columns(sqltext.tables_of(F.col("script")), used), ",").alias("missing"))


VERB = "(['insert into stock values (1)', 'UPDATE  prices SET a = 1', 'delete from old_rows where x = 1', 'DROP TABLE IF EXISTS tmp', 'alter table t add c int', 'select * from t', 'CREATE TABLE IF NOT EXISTS fresh (a int)', 'grant all'])[1 + c_custkey % 8]"
VERBS_SQL = "CASE verb " + " ".join(f"WHEN '{v}' THEN '{p}'" for v, p in sqltext.VERBS.items()) + " END"


def requests(spark, sf_dir):
    listed = "element_at(array('insert into stock values (1)', 'UPDATE  prices SET a = 1', 'delete from old_rows where x = 1', 'DROP TABLE IF EXISTS tmp', 'alter table t add c int', 'select * from t', 'CREATE TABLE IF NOT EXISTS fresh (a int)', 'grant all'), CAST(1 + c_custkey % 8 AS INT))"
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{listed} AS s")


@query(f"""WITH s AS (SELECT c_custkey, {VERB} AS s FROM customer), v AS (SELECT *, lower(regexp_extract(s, '^\\s*(\\S+)', 1)) AS verb FROM s)
 SELECT c_custkey, CASE WHEN verb IN ('insert', 'update', 'delete', 'create', 'alter', 'drop') THEN verb END AS verb,
 nullif(regexp_extract(s, '(?i)(?:into|update|from|exists|alter table)\\s+([a-z_]+)', 1), CASE WHEN verb = 'select' THEN 't' ELSE '' END) AS target FROM v""")
def write_requests(spark, sf_dir):
    return requests(spark, sf_dir).select("c_custkey", sqltext.write_verb(F.col("s")).alias("verb"), sqltext.target_table(F.col("s")).alias("target"))


@query(f"""WITH s AS (SELECT c_custkey, {VERB} AS s FROM customer), v AS (SELECT *, lower(regexp_extract(s, '^\\s*(\\S+)', 1)) AS verb,
 nullif(regexp_extract(s, '(?i)(?:into|update|from|exists|alter table)\\s+([a-z_]+)', 1), '') AS target FROM s)
 SELECT c_custkey, replace(replace({chosen(sqltext.REFUSALS, 'c_custkey', 'refusal')}, '{{phrase}}', {VERBS_SQL}), '{{table}}', coalesce(target, 'the database')) AS answer FROM v""")
def refusal_answers(spark, sf_dir):
    return requests(spark, sf_dir).select("c_custkey", sqltext.refusal(F.col("s"), F.col("c_custkey")).alias("answer"))


@query(f"""WITH v AS (SELECT p_partkey, p_size, {chosen([q.replace('{t}', 'item ') for _, q in sqltext.VAGUE], 'p_partkey', 'vague')} AS q, {chosen([t for t, _ in sqltext.VAGUE], 'p_partkey', 'vague')} AS term FROM part)
 SELECT p_partkey, replace(q, 'item ', 'item ' || p_partkey) AS question,
 'Could you clarify what you mean by "' || term || '"? I can rank item ' || p_partkey || ' by price or qty. Tell me which one you want and I will run the query.' AS answer FROM v""")
def clarifying_answers(spark, sf_dir):
    return scripts(spark, sf_dir).select("p_partkey", sqltext.clarification(F.col("script"), F.col("p_partkey")).alias("c")).select("p_partkey", "c.question", "c.answer")


@query(f"""SELECT p_partkey, 'I can''t answer that from this schema because it has no data about ' || {chosen(sqltext.CONCEPTS, 'p_partkey', 'concept')} || '. The available tables are item_' || p_partkey || ', shop_' || p_partkey ||
 '. If you can point me to the right table or share its schema, I can write the query.' AS answer FROM part""")
def missing_data_answers(spark, sf_dir):
    named = F.concat(F.lit("create table item_"), F.col("p_partkey").cast("string"), F.lit(" (a int); create table shop_"), F.col("p_partkey").cast("string"), F.lit(" (b int);"))
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", sqltext.missing_data(named, F.col("p_partkey")).alias("m")).select("p_partkey", "m.answer")


@query("""SELECT o_orderkey, kind, CASE kind WHEN 'column' THEN 'SELECT amoun FROM sales WHERE amount > ' || o_custkey WHEN 'table' THEN 'SELECT amount FROM saless WHERE amount > ' || o_custkey ELSE 'SELECT amount FORM sales WHERE amount > ' || o_custkey END AS sql
 FROM orders, (VALUES ('column'), ('table'), ('syntax')) AS k(kind)""")
def sql_mutations(spark, sf_dir):
    good = F.concat(F.lit("SELECT amount FROM sales WHERE amount > "), F.col("o_custkey").cast("string"))
    broken = sqltext.mutations(good, F.array(F.lit("amount")), F.array(F.lit("sales")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(broken))


@query(f"""WITH p AS (SELECT c_custkey, c_name, {chosen(sqltext.PREFIXES, 'c_custkey', 'prefix')} AS prefix FROM customer)
 SELECT c_custkey, CASE WHEN prefix = '' THEN 'What does ' || c_name || ' owe?' ELSE prefix || 'what does ' || c_name || CASE WHEN prefix LIKE '%show me ' THEN ' owe.' ELSE ' owe?' END END AS question FROM p""")
def paraphrased_questions(spark, sf_dir):
    asked = F.concat(F.lit("What does "), F.col("c_name"), F.lit(" owe?"))
    return table(spark, sf_dir, "customer").select("c_custkey", sqltext.paraphrase(asked, F.col("c_custkey")).alias("question"))


@query("SELECT source, CASE WHEN regexp_matches(lower(source), 'src1|src2') THEN 'x' END AS marked, CAST(CASE WHEN regexp_matches(lower(lang || ' trade'), 'trade') AND lang = 'en' THEN 2 WHEN lang = 'de' THEN 2 ELSE 1 END AS BIGINT) AS weight, count(*) AS n FROM documents GROUP BY ALL")
def domain_weights(spark, sf_dir):
    domain = F.when(F.col("lang") == "en", "Foreign Trade").when(F.col("lang") == "de", "retail BANKING").otherwise("poetry")
    rows = table(spark, sf_dir, "documents").select("source", F.when(F.lower("source").rlike("src1|src2"), "x").alias("marked"), sqltext.domain_weight(domain).cast("long").alias("weight"))
    return rows.groupBy("source", "marked", "weight").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, 'select a, ''x  ,  y'' from t where k = ' || o_custkey AS sql FROM orders")
def normalised_sql(spark, sf_dir):
    odd = F.concat(F.lit("  select a  ,\n 'x  ,  y'   from\tt where k = "), F.col("o_custkey").cast("string"), F.lit(" ; ;"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sqltext.normalised_sql(odd).alias("sql"))


@query("SELECT doc_id % 5 AS kind, CASE WHEN doc_id % 5 = 1 THEN 'read' WHEN doc_id % 5 = 2 THEN 'write' END AS task, count(*) AS n FROM documents GROUP BY ALL")
def task_kinds(spark, sf_dir):
    kind = F.col("doc_id") % 5
    name = F.when(kind == 1, "data retrieval").when(kind == 2, "data definition").when(kind == 3, "other")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("kind"), sqltext.task_kind(name).alias("task")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------------------------ examples
EXAMPLES = """WITH r AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, max(turn) AS last FROM conversations GROUP BY conv_id),
 t AS (SELECT c.conv_id, CASE role WHEN 'system' THEN '<|system|>' WHEN 'user' THEN '<|user|>' ELSE '<|assistant|>' END AS mark, text || CASE WHEN role = 'assistant' AND turn = last THEN '<|eos|>' ELSE '' END AS body, role, turn
       FROM conversations c JOIN r USING (conv_id) WHERE regexp_matches(roles, 'assistant$')),
 x AS (SELECT conv_id, '<|bos|>' || string_agg(mark || body, '' ORDER BY turn) AS text, CAST(sum(CASE WHEN role = 'assistant' THEN length(body) ELSE 0 END) AS BIGINT) AS trained FROM t GROUP BY conv_id)"""


def turns(spark, sf_dir):
    return convo.turns_of(table(spark, sf_dir, "conversations"))


@query(EXAMPLES + " SELECT conv_id, md5(text) AS text_md5, trained FROM x")
def rendered_examples(spark, sf_dir):
    made = turns(spark, sf_dir).select("conv_id", examples.render(F.col("turns")).alias("r")).where("r is not null")
    return made.select("conv_id", F.md5("r.text").alias("text_md5"), F.aggregate("r.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("trained"))


def by_character():
    """An encoder for tests and reports: an id for each character."""
    return lambda text: ([min(ord(c), 65_535) for c in text], list(range(len(text))))


@query(EXAMPLES + " SELECT conv_id, length(text) AS tokens, trained FROM x WHERE length(text) <= 3000")
def encoded_examples(spark, sf_dir):
    made = examples.encode_examples(turns(spark, sf_dir), by_character, 3000)
    return made.select("conv_id", F.size("ids").cast("long").alias("tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("trained"))


@query(EXAMPLES + ", y AS (SELECT *, conv_id % 7 AS batch, max(length(text)) OVER (PARTITION BY conv_id % 7) AS width FROM x WHERE length(text) <= 3000) SELECT conv_id, batch, CAST(width AS BIGINT) AS width, length(text) AS attended, width - trained AS masked FROM y")
def collated_batches(spark, sf_dir):
    made = examples.encode_examples(turns(spark, sf_dir), by_character, 3000).select("conv_id", (F.col("conv_id") % 7).alias("batch"), "ids", "mask")
    padded = examples.collated(made, "batch", 0)
    count = lambda c, v: F.size(F.filter(c, lambda x: x == v)).cast("long")
    return padded.select("conv_id", "batch", F.size("input_ids").cast("long").alias("width"), count("attention_mask", 1).alias("attended"), count("labels", examples.UNTRAINED).alias("masked"))


@query("SELECT conv_id, turn, length('<|bos|><|system|>Answer.<|user|><|schema|>' || chr(10) || 'a int' || chr(10) || '<|/schema|>' || chr(10) || trim(text) || '<|assistant|>') AS chars FROM conversations WHERE role = 'user' AND length('<|bos|><|system|>Answer.<|user|><|schema|>' || chr(10) || 'a int' || chr(10) || '<|/schema|>' || chr(10) || trim(text) || '<|assistant|>') <= 1700")
def prompts_within_limit(spark, sf_dir):
    made = examples.prompt(F.lit("Answer."), examples.asked(F.lit(" a int "), F.col("text")))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.length(made).cast("long").alias("chars")).where("chars <= 1700")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN trim(text) END AS code, turn % 3 = 1 AS lenient FROM conversations WHERE role = 'assistant'")
def code_blocks(spark, sf_dir):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("so <|python|> "), F.col("text"), F.lit(" <|/python|> end"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<|think|> "), F.col("text"), F.lit(" <|/python|>"))).otherwise(F.col("text"))
    made = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", examples.code_of(said).alias("c"))
    return made.select("conv_id", "turn", "c.code", F.col("c.warning").isNotNull().alias("lenient"))


HASHED = "md5(CAST({key} AS VARCHAR) || ':{seed}')"


@query(f"SELECT 'few' AS source, doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY {HASHED.format(key='doc_id', seed='mix')}, doc_id LIMIT 25) UNION ALL SELECT 'many', doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY {HASHED.format(key='doc_id', seed='mix')}, doc_id LIMIT 300)")
def mixture_of_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return examples.mixture({"few": (docs.where("lang = 'de'"), 25), "many": (docs.where("lang = 'en'"), 300)}, "doc_id").select("source", "doc_id")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {HASHED.format(key='doc_id', seed='cap')}, doc_id) AS r FROM documents) WHERE r <= CASE source WHEN 'src1' THEN 5 WHEN 'src2' THEN 20 ELSE 0 END")
def cap_by_listed_source(spark, sf_dir):
    return examples.cap_by_source(table(spark, sf_dir, "documents").select("source", "doc_id"), {"src1": 5, "src2": 20}, "doc_id")


@query("SELECT item_id, CAST(e AS BIGINT) AS epoch FROM (SELECT item_id, unnest(range(item_id % 4)) AS e FROM benchmark)")
def mixture_repeats(spark, sf_dir):
    return examples.repeated(table(spark, sf_dir, "benchmark").select("item_id"), F.col("item_id") % 4).select("item_id", F.col("epoch").cast("long").alias("epoch"))


CASCADE = f"""WITH o AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (ORDER BY {HASHED.format(key='doc_id', seed='cascade')}, doc_id) AS k FROM documents),
 a AS (SELECT * FROM o WHERE lang = 'fr' ORDER BY k LIMIT 9), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) AS s FROM o WHERE doc_id NOT IN (SELECT doc_id FROM a)),
 b AS (SELECT * FROM f WHERE s = 1 AND n_chars % 2 = 0 ORDER BY k LIMIT 4), c AS (SELECT * FROM f WHERE s = 1 AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY k LIMIT 5)
 SELECT doc_id, 'refusal' AS kind FROM a UNION ALL SELECT doc_id, 'clarify' FROM b UNION ALL SELECT doc_id, 'missing' FROM c"""


@query(CASCADE)
def quota_cascade(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    steps = [("refusal", F.col("lang") == "fr", 9), ("clarify", F.col("n_chars") % 2 == 0, 4), ("missing", F.lit(True), 5)]
    return examples.quota_cascade(docs, "doc_id", steps, "source").select("doc_id", "kind")


@query("""WITH w AS (SELECT source, sum(n_chars) * 1.0 AS w FROM documents GROUP BY source), c AS (SELECT source, (sum(w) OVER (ORDER BY source) - w) / sum(w) OVER () AS lo, sum(w) OVER (ORDER BY source) / sum(w) OVER () AS hi FROM w),
 d AS (SELECT s AS step, n AS draw, CAST('0x' || substr(md5(s || ':' || n || ':sample7'), 1, 8) AS BIGINT) % 1000000 / 1000000.0 AS u FROM range(50) AS a(s), range(8) AS b(n)) SELECT step, draw, source FROM d JOIN c ON u >= lo AND u < hi""")
def weighted_draws(spark, sf_dir):
    groups = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("w"))
    draws = spark.range(50).withColumnRenamed("id", "step").select("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("draw"))
    return sample.sampled_with_weights(groups, F.col("w"), draws, "source", 7).select("step", "draw", "source")


# ------------------------------------------------------------------------------------------------ measures
@query("SELECT count(*) AS files, count(*) FILTER (quality = 1) AS permissive_files, count(*) FILTER (quality = 1 AND doc_id % 6 >= 4) AS permissive_high_files, CAST(sum(n_chars) AS BIGINT) AS total_bytes, CAST(sum(n_chars) FILTER (quality = 1) AS BIGINT) AS permissive_bytes, floor(count(*) FILTER (quality = 1) / count(*) * 1e6 + 0.5) / 1e6 AS file_share, floor(sum(n_chars) FILTER (quality = 1) / sum(n_chars) * 1e6 + 0.5) / 1e6 AS byte_share FROM documents JOIN labels USING (doc_id)")
def licence_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("length_bytes")).join(table(spark, sf_dir, "labels"), "doc_id")
    return measure.licence_summary(rows.select(F.when(F.col("quality") == 1, "permissive").otherwise("other").alias("license_type"), "length_bytes", (F.col("doc_id") % 6).alias("int_score")))


@query("SELECT count(*) AS attempted, count(*) FILTER (doc_id % 10 > 1) AS ok, count(*) FILTER (doc_id % 10 = 0) AS missing, count(*) FILTER (doc_id % 10 = 1) AS errors, floor(count(*) FILTER (doc_id % 10 < 2) / count(*) * 1e6 + 0.5) / 1e6 AS failure_rate, floor(sum(strlen(text)) FILTER (doc_id % 10 > 1) / count(*) FILTER (doc_id % 10 > 1) * 1e6 + 0.5) / 1e6 AS mean_bytes, count(*) / 4.0 AS files_per_second FROM documents")
def fetch_report(spark, sf_dir):
    kind = F.col("doc_id") % 10
    fetched = table(spark, sf_dir, "documents").select(F.when(kind == 0, "missing").when(kind == 1, "error:OSError").otherwise("ok").alias("status"), F.when(kind > 1, F.encode("text", "UTF-8")).alias("raw"))
    made = measure.fetch_summary(fetched, 4.0)
    return made.withColumns({c: T.quantised(F.col(c)) for c in ("failure_rate", "mean_bytes")})


@query("SELECT CASE WHEN n_chars < 600 THEN 'short' ELSE 'fine' END AS reason, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def merged_reasons(spark, sf_dir):
    reason = F.when(F.col("n_chars") < 600, "short").otherwise("fine")
    counted = table(spark, sf_dir, "documents").groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))
    parts = counted.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("reasons"))
    return measure.merged_reasons(parts)


@query("SELECT source, floor(avg(length(text)) * 1e6 + 0.5) / 1e6 AS avg_chars, CAST(floor(5000 * avg(length(text)) / 4.0) AS BIGINT) AS projected_tokens FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10 GROUP BY source")
def yield_of_first_docs(spark, sf_dir):
    return measure.yield_of_first(table(spark, sf_dir, "documents"), 10, F.lit(5000))


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?[\p{L}]+|[0-9]| ?[^\s\p{L}0-9]+|\s+')) AS token FROM documents) GROUP BY token")
def pre_token_counts(spark, sf_dir):
    return measure.pre_token_counts(spread(table(spark, sf_dir, "documents").select("text")))


def byte_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.no_truncation()
    made.no_padding()
    return made


@query()
def fertility(spark, sf_dir):
    return measure.fertility(spread(table(spark, sf_dir, "documents").select("source", "text")), byte_tokenizer)


@query()
def pack_windows_bpe(spark, sf_dir):
    def ids():
        made = byte_tokenizer()
        return lambda text: (made.encode(text, add_special_tokens=False).ids, [])

    small_batches(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    coded = staged(docs.select("doc_id", "source", examples.encoded(F.col("text"), ids).alias("e")).select("doc_id", "source", F.col("e.ids").alias("ids")), "coded")
    return sample.route(sample.pack_stream(coded, 2048, F.lit(50_256))).select("source", "window_id", F.md5(F.concat_ws(" ", F.transform("ids", lambda i: i.cast("string")))).alias("ids_md5"), "split")


LENGTHS = """WITH w AS (SELECT doc_id, source, list_append(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x)), 0) AS w FROM documents),
 o AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
 t AS (SELECT source, start + unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS id FROM o),
 p AS (SELECT source, CAST(pos // 256 AS BIGINT) AS window_id, max(id) AS top, sum(id) AS total, count(*) FILTER (id = 0) AS ends FROM t GROUP BY ALL HAVING count(*) = 256)"""


def length_windows(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("doc_id", "source", F.transform(T.words(F.col("text")), F.length).alias("ids"))
    return sample.route(sample.pack_stream(ids, 256, F.lit(0)))


@query(LENGTHS + " SELECT source, CASE WHEN window_id % 100 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS windows, true AS size_matches, CAST(max(top) AS BIGINT) AS max_id, CAST(arg_min(ends, window_id) AS BIGINT) AS first_ends FROM p GROUP BY ALL")
def token_files(spark, sf_dir):
    """Windows written as raw files of 16-bit ids, read back by their place and inspected."""
    files = staged(tokenfiles.write_windows(length_windows(spark, sf_dir), fresh_path(spark, "tokens")), "files")
    seen = tokenfiles.inspect(tokenfiles.read_windows(files, 256), 256, 0)
    return files.select("source", "split", "file").join(seen, "file").drop("file")


@query(LENGTHS + """, s AS (SELECT *, CASE WHEN window_id % 100 = 0 THEN 'val' ELSE 'train' END AS split FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY source, split ORDER BY window_id) - 1 AS i FROM s)
 SELECT source, split, CAST(i AS BIGINT) AS place, CAST(total AS BIGINT) AS total FROM r WHERE i BETWEEN 2 AND 5""")
def token_windows_scan(spark, sf_dir):
    """Windows at some places of each raw file, read as a data source that opens each file there alone."""
    datasources.register(spark)
    folder = fresh_path(spark, "tokens")
    files = staged(tokenfiles.write_windows(length_windows(spark, sf_dir), folder), "files")
    scan = spark.read.format("token_windows").option("width", 256).load(folder).where("window between 2 and 5")
    # a lost task may have left a file that isn't listed
    mine = scan.join(files, "file")
    return mine.select("source", "split", F.col("window").alias("place"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("total"))


@query(LENGTHS + " SELECT source, window_id, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY window_id) AS r FROM p WHERE window_id % 100 = 0) WHERE r <= 2")
def first_val_windows(spark, sf_dir):
    val = tokenfiles.first_windows(length_windows(spark, sf_dir).where("split = 'val'"), 2)
    return val.select("source", "window_id", F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i).alias("total"))


GARBLED = """WITH b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS word FROM benchmark), w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS word FROM documents),
 c AS (SELECT doc_id, count(*) AS words, count(*) FILTER (b.word IS NULL) AS unknown FROM w LEFT JOIN b USING (word) GROUP BY doc_id),
 r AS (SELECT doc_id, coalesce(words, 0) AS words, CASE WHEN coalesce(words, 0) < 50 THEN 0.0 ELSE unknown / words END AS ratio FROM documents LEFT JOIN c USING (doc_id))"""


def garble_ratios(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(measure.WORD), F.lit(0))).alias("word"))
    return measure.unknown_ratios(table(spark, sf_dir, "documents"), known)


@query(GARBLED + " SELECT doc_id, CAST(words AS BIGINT) AS words, floor(ratio * 1e6 + 0.5) / 1e6 AS ratio, ratio > 0.2 AS garbled FROM r")
def ocr_garble(spark, sf_dir):
    return garble_ratios(spark, sf_dir).select("doc_id", "words", T.quantised(F.col("ratio")).alias("ratio"), measure.is_garbled(F.col("ratio")).alias("garbled"))


@query(GARBLED + " SELECT threshold, count(*) FILTER (ratio > threshold) AS dropped, floor(count(*) FILTER (ratio > threshold) / count(*) * 1e6 + 0.5) / 1e6 AS share FROM r, (VALUES (0.1::DOUBLE), (0.15::DOUBLE), (0.2::DOUBLE), (0.25::DOUBLE), (0.3::DOUBLE)) AS t(threshold) WHERE words >= 50 GROUP BY threshold")
def ocr_sweep(spark, sf_dir):
    return measure.threshold_sweep(staged(garble_ratios(spark, sf_dir), "ratios"))


@query("SELECT id, arg_min(role, p) AS role FROM (SELECT DISTINCT source AS id, 'pretrain' AS role, 0 AS p FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT DISTINCT source, 'sft_or_eval', 1 FROM documents) GROUP BY id")
def role_ledger(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return measure.ledger([("pretrain", docs.where("doc_id % 3 = 0").select(F.col("source").alias("id"))), ("sft_or_eval", docs.select(F.col("source").alias("id")))])


@query("SELECT source, CAST(ceil(sum(n_chars) / 7) AS BIGINT) AS budget FROM documents GROUP BY source")
def worker_budgets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(measure.budget_of(F.sum("n_chars"), 7).alias("budget"))


@query("""WITH t AS (SELECT count(*) AS n FROM documents), s AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS step, CAST(n // 10 AS BIGINT) AS warm, CAST(floor(n * 0.9) AS BIGINT) AS start, n FROM documents, t),
 r AS (SELECT *, CASE WHEN step < warm THEN 3.0 * (step + 1) / warm WHEN step < start THEN 3.0 ELSE 0.3 + 0.5 * 2.7 * (1 + cos(pi() * least(1.0, (step - start) / greatest(1, n - 1 - start)))) END AS rate FROM s)
 SELECT doc_id, step, floor(rate * 1e6 + 0.5) / 1e6 AS rate FROM r""")
def learning_rates(spark, sf_dir):
    """The rate at which each document would be learnt, were it a step in the order of ids."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    steps = sample.placed(staged(ids.orderBy("doc_id").withColumn("_p", F.spark_partition_id()), "steps"), "doc_id")
    total = ids.count()
    return steps.select("doc_id", F.col("i").alias("step"), T.quantised(measure.learning_rate(F.col("i"), total, total // 10, 3.0, 0.3)).alias("rate"))


@query("SELECT c_nationkey, arg_max(c_name, (c_acctbal, -c_custkey)) AS highest, arg_min(c_name, (c_acctbal, c_custkey)) AS lowest FROM customer GROUP BY c_nationkey")
def extreme_customers(spark, sf_dir):
    return measure.extremes(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "c_name", "c_custkey")


@query("SELECT floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean FROM events WHERE event_id >= 100")
def steady_mean(spark, sf_dir):
    return measure.steady_mean(table(spark, sf_dir, "events"), "value", 100, "event_id")


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), ' ')) AS flat_md5, md5(concat_ws(chr(10), lang, source, text)) AS record_md5 FROM documents")
def flattened_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(measure.flat(F.col("text"))).alias("flat_md5"), F.md5(measure.record_text(F.col("lang"), F.array("source", F.lit(None).cast("string"), "text"))).alias("record_md5"))


# ------------------------------------------------------------------------------------------------ joins, votes, repairs
@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def restricted_to_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("SELECT source, n, rank, epochs FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) JOIN (VALUES ('src1', CAST(1 AS BIGINT), 2.0::DOUBLE), ('src2', 2, 1.0), ('src3', 3, 0.5)) AS d(source, rank, epochs) USING (source)")
def source_dimension(spark, sf_dir):
    dim = spark.createDataFrame([("src1", 1, 2.0), ("src2", 2, 1.0), ("src3", 3, 0.5)], "source string, rank long, epochs double")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(dim), "source")


@query("SELECT i, item_id, doc_id FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) USING (i)")
def zipped_by_place(spark, sf_dir):
    def placed(name, key):
        return sample.placed(staged(table(spark, sf_dir, name).select(key).orderBy(key).withColumn("_p", F.spark_partition_id()), "placed"), key)

    return placed("benchmark", "item_id").join(placed("documents", "doc_id"), "i").select("i", "item_id", "doc_id")


VOTED = "WITH s AS (SELECT o_custkey AS case_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderstatus AS signature FROM orders), g AS (SELECT case_id, mode FROM (SELECT o_custkey AS case_id, min(o_orderstatus) AS mode FROM orders GROUP BY 1)), "


@query(VOTED + """k AS (SELECT unnest([0, 2, 4]) AS k), c AS (SELECT k, case_id, signature, count(*) AS v, min(pos) AS p FROM s, k WHERE (k = 0 AND pos = 0) OR (k > 0 AND pos <= k) GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY k, case_id ORDER BY v DESC, p) AS r FROM c) SELECT k, floor(count(*) FILTER (signature = mode) / (SELECT count(DISTINCT o_custkey) FROM orders) * 1e6 + 0.5) / 1e6 AS accuracy FROM b JOIN g USING (case_id) WHERE r = 1 GROUP BY k""")
def vote_curve(spark, sf_dir):
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders")
    cand = o.select(F.col("o_custkey").alias("case_id"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("pos"), F.col("o_orderkey").cast("string").alias("sql"), F.col("o_orderstatus").alias("signature"))
    gold = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.min("o_orderstatus").alias("gold_signature"))
    made = sqlcheck.vote_curve(cand, gold, [0, 2, 4], gold.count())
    return made.select("k", T.quantised(F.col("accuracy")).alias("accuracy"))


SIGNED = """WITH r AS (SELECT l_linenumber, l_orderkey, round(l_quantity, 4) AS q, round(CASE WHEN l_linenumber > 3 AND l_orderkey % 2 = 0 THEN l_quantity + 1 ELSE l_quantity END, 4) AS q2 FROM lineitem),
 a AS (SELECT l_linenumber, l_orderkey, q, count(*) AS n FROM r GROUP BY ALL), b AS (SELECT l_linenumber, l_orderkey, q2 AS q, count(*) AS n FROM r GROUP BY ALL),
 d AS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
 SELECT DISTINCT l_linenumber, true AS same_any_order, l_linenumber NOT IN (SELECT l_linenumber FROM d) AS same_changed FROM r"""


@query(SIGNED)
def result_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", "l_quantity")
    made = sqlcheck.result_signatures(rows, "l_linenumber", ["l_orderkey", "l_quantity"])
    other = sqlcheck.result_signatures(rows.repartition(5, "l_quantity"), "l_linenumber", ["l_orderkey", "l_quantity"]).withColumnRenamed("signature", "again")
    changed = sqlcheck.result_signatures(rows.withColumn("l_quantity", F.when((F.col("l_linenumber") > 3) & (F.col("l_orderkey") % 2 == 0), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))), "l_linenumber", ["l_orderkey", "l_quantity"]).withColumnRenamed("signature", "changed")
    return made.join(other, "l_linenumber").join(changed, "l_linenumber").select("l_linenumber", (F.col("signature") == F.col("again")).alias("same_any_order"), (F.col("signature") == F.col("changed")).alias("same_changed"))


@query(r"SELECT source, count(*) FILTER (r > 1) AS dups FROM (SELECT source, row_number() OVER (PARTITION BY source, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY doc_id) AS r FROM documents) GROUP BY source")
def exact_dups_within_source(spark, sf_dir):
    key = F.sha2(F.concat_ws("\x1f", "source", T.normalize(F.col("text"))), 256)
    docs = table(spark, sf_dir, "documents")
    found = dedup.first_of_each(docs, key)
    return docs.select("doc_id", "source").join(found, "doc_id").groupBy("source").agg(F.count_if("exact_dup").alias("dups"))


@query("SELECT count(*) AS streamed, count(*) FILTER (n_chars >= 600) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 40")
def clean_pilot(spark, sf_dir):
    first = sample.stride_sample(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), 0, "source", 1)
    from pyspark.sql import Window as W

    pilot = first.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("r <= 40")
    return pilot.agg(F.count("*").alias("streamed"), F.count_if(F.col("n_chars") >= 600).alias("kept"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_custkey % 30 AS INTEGER) AS due, CAST(o_orderdate AS DATE) > DATE '1996-06-01' AS late FROM orders")
def dates_with_offset(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(day, (F.col("o_custkey") % 30).cast("int")).alias("due"), (day > F.lit("1996-06-01").cast("date")).alias("late"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY event_type")
def json_round_trip(spark, sf_dir):
    once = F.from_json(F.to_json(F.from_json("props", "k BIGINT")), "k BIGINT")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(once["k"]).alias("total"), F.count("*").alias("n"))


@query("SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, floor(sum(value) * 1e2 + 0.5) / 1e2 AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """What the streaming count of events gives once all have come."""
    made = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("w.start").alias("hour"), "event_type", "n", (F.floor(F.col("total") * 1e2 + 0.5) / 1e2).alias("total"))
