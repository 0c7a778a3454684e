"""Corpus queries over documents, benchmark and labels, each with SQL that DuckDB can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.functions import quality as Q
from graintide.functions import text as T
from graintide.operators import clean, dedup, sample
from graintide.session import dealt, spread, staged, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def dealt_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that take much time for each document."""
    return spread(docs_of(spark, sf_dir).select("doc_id", "source", "text"))


TIDY = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 40 AND length(regexp_replace(x, '[A-Za-z0-9]', '', 'g')) <= 0.3 * length(x))"
BOILER = "(?i)" + "|".join(Q.BOILERPLATE).replace("'", "''")
BODY = f"array_to_string(list_filter({TIDY}, lambda x: NOT regexp_matches(x, '{BOILER}')), chr(10))"
WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
REPEATED = "EXISTS (SELECT 1 FROM rep r WHERE r.doc_id = {t}.doc_id AND repetitive)"
REP_CTE = """
 tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(body), '\\s+'), lambda w: w <> '') AS w FROM {src}),
 g4 AS (SELECT doc_id, len(w) AS n, unnest(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM tok WHERE len(w) >= 8),
 c4 AS (SELECT doc_id, g, count(*) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC) AS r FROM g4 GROUP BY doc_id, g),
 rep AS (SELECT doc_id, sum(CASE WHEN r <= 10 THEN c ELSE 0 END) > 0.5 * sum(c) AS repetitive FROM c4 GROUP BY doc_id)"""
ASCII = "length(regexp_replace(left(body, 5000), '[^\\x00-\\x7F]', '', 'g')) / greatest(length(left(body, 5000)), 1)"
ENGLISH = f"(CASE WHEN {ASCII} >= 0.99 THEN true WHEN {ASCII} < 0.90 THEN false ELSE {ASCII} > 0.95 END)"
REASON = f"CASE WHEN text = '' THEN 'empty_or_unfetched' WHEN length(body) < 600 THEN 'too_short' WHEN coalesce(repetitive, false) THEN 'repetitive' WHEN NOT {ENGLISH} THEN 'non_english' ELSE '' END"


@query(f"SELECT doc_id, length(array_to_string({TIDY}, chr(10))) AS body_chars, md5(array_to_string({TIDY}, chr(10))) AS body_md5 FROM documents")
def clean_line_filter(spark, sf_dir):
    body = Q.filter_lines(F.col("text"))
    return dealt_docs(spark, sf_dir).select("doc_id", body.alias("b")).select("doc_id", F.length("b").cast("long").alias("body_chars"), F.md5("b").alias("body_md5"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{BOILER}')), chr(10))) AS body_md5 FROM documents")
def clean_boilerplate(spark, sf_dir):
    return dealt_docs(spark, sf_dir).select("doc_id", F.md5(Q.strip_boilerplate(F.col("text"))).alias("body_md5"))


@query(f"WITH b AS (SELECT doc_id, text AS body FROM documents), {REP_CTE.format(src='b')} SELECT b.doc_id, coalesce(repetitive, false) AS repetitive FROM b LEFT JOIN rep USING (doc_id)")
def clean_repetition_ratio(spark, sf_dir):
    return dealt_docs(spark, sf_dir).select("doc_id", Q.is_repetitive(F.col("text")).alias("repetitive"))


@query(f"WITH b AS (SELECT doc_id, text AS body FROM documents) SELECT doc_id, {ENGLISH} AS english FROM b")
def clean_ascii_language(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", Q.is_english(F.col("text")).alias("english"))


def _report(df: DataFrame) -> DataFrame:
    return df.groupBy("source", "reason").agg(F.count("*").alias("n"), F.sum("clean_chars").alias("chars"))


CHAIN = "WITH b AS (SELECT doc_id, source, text, {body} AS body FROM documents), " + REP_CTE.format(src="b") + f", j AS (SELECT b.*, {REASON} AS reason FROM b LEFT JOIN rep USING (doc_id))"


def redacted(x: str) -> str:
    """The SQL of Q.redact."""
    mailed = f"regexp_replace({x}, '{Q.EMAIL}', '{Q.EMAIL_TOKEN}', 'g')"
    address = f"'\\b{Q.IPV4}\\b'"
    # between the addresses the text stays, and each is replaced unless it begins like one that isn't public
    between, found = f"regexp_split_to_array({mailed}, {address})", f"regexp_extract_all({mailed}, {address})"
    judged = f"list_append(list_transform({found}, lambda a: CASE WHEN regexp_matches(a, '^(?:{Q.NOT_PUBLIC})') THEN a ELSE '{Q.IP_TOKEN}' END), '')"
    return f"array_to_string(list_transform(list_zip({between}, {judged}), lambda z: z[1] || z[2]), '')"


@query(CHAIN.format(body=BODY) + f" SELECT source, reason, count(*) AS n, CAST(sum(length(CASE WHEN reason = '' THEN {redacted('body')} ELSE body END)) AS BIGINT) AS chars FROM j GROUP BY ALL")
def clean_prose_reasons(spark, sf_dir):
    return _report(clean.clean_prose(dealt_docs(spark, sf_dir)))


@query(CHAIN.format(body="text") + " SELECT source, reason, count(*) AS n FROM j GROUP BY ALL")
def clean_light_reasons(spark, sf_dir):
    return clean.clean_documents(dealt_docs(spark, sf_dir), "light").groupBy("source", "reason").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{Q.EMAIL}')) AS emails, len(regexp_extract_all(text, '\\b{Q.IPV4}\\b')) AS addresses FROM documents")
def pii_counts(spark, sf_dir):
    return dealt_docs(spark, sf_dir).select("doc_id", F.regexp_count("text", F.lit(Q.EMAIL)).cast("long").alias("emails"), F.regexp_count("text", F.lit(rf"\b{Q.IPV4}\b")).cast("long").alias("addresses"))


@query(f"SELECT doc_id, md5({redacted('text')}) AS text_md5, true AS idempotent FROM documents")
def pii_redact(spark, sf_dir):
    return dealt_docs(spark, sf_dir).select("doc_id", F.md5(Q.redact(F.col("text"))).alias("text_md5"), (Q.redact(Q.redact(F.col("text"))) == Q.redact(F.col("text"))).alias("idempotent"))


@query("SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in Q.SECRETS) + " AS secret FROM documents")
def secret_flags(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", Q.has_secret(F.col("text")).alias("secret"))


L = "string_split(text, chr(10))"


@query(f"SELECT doc_id, floor(list_sum(list_transform({L}, lambda x: length(x))) / len({L}) * 1e6 + 0.5) / 1e6 AS avg_line, CAST(list_max(list_transform({L}, lambda x: length(x))) AS BIGINT) AS max_line FROM documents")
def line_stats(spark, sf_dir):
    average, longest = Q.line_stats(F.col("text"))
    return docs_of(spark, sf_dir).select("doc_id", T.quantised(average).alias("avg_line"), longest.cast("long").alias("max_line"))


@query("SELECT doc_id, floor(coalesce(length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) / nullif(length(text), 0), 0) * 1e6 + 0.5) / 1e6 AS alnum FROM documents")
def alnum_fraction(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.quantised(F.coalesce(T.alnum_ratio(F.col("text")), F.lit(0.0))).alias("alnum"))


FILLED = f"list_filter(list_transform({L}, lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, floor(coalesce(len(list_filter({FILLED}, lambda x: starts_with(x, '#'))) / nullif(len({FILLED}), 0), 1.0) * 1e6 + 0.5) / 1e6 AS comments FROM documents")
def comment_fraction(spark, sf_dir):
    return dealt_docs(spark, sf_dir).select("doc_id", T.quantised(Q.comment_fraction(F.col("text"))).alias("comments"))


NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY {NORM}) AS exact_dup FROM documents")
def exact_dups(spark, sf_dir):
    return dedup.first_of_each(docs_of(spark, sf_dir), F.sha2(T.normalize(F.col("text")), 256))


@query(f"SELECT source, count(*) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY {NORM} ORDER BY doc_id) AS r FROM documents) WHERE r = 1 GROUP BY source")
def exact_dedup_keep_first(spark, sf_dir):
    judged = dedup.first_of_each(docs_of(spark, sf_dir), F.sha2(T.normalize(F.col("text")), 256), carry=["source"])
    return judged.where("not exact_dup").groupBy("source").agg(F.count("*").alias("kept"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:$|#)')), chr(10))), '\s+', ' ', 'g'))) AS code_md5 FROM documents")
def canonical_code_hash(spark, sf_dir):
    return dealt_docs(spark, sf_dir).select("doc_id", F.md5(Q.canonical(F.col("text"), "code")).alias("code_md5"))


SHINGLES = f"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w)"


@query(SHINGLES + " SELECT doc_id, len(s) AS shingles FROM s")
def shingle_counts(spark, sf_dir):
    return dealt_docs(spark, sf_dir).select("doc_id", F.size(T.shingles(T.words(F.col("text")), 5)).cast("long").alias("shingles"))


CELLS = SHINGLES + f""", u AS (SELECT doc_id, unnest(CASE WHEN len(s) = 0 THEN ['<none>'] ELSE s END) AS x FROM s),
 hs AS (SELECT doc_id, CASE WHEN x = '<none>' THEN NULL ELSE CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) END AS h FROM u),
 p AS (SELECT doc_id, p, min((h * greatest((p * 1103515245 + 12345) % {dedup.PRIME}, 1) + (p * 69069 + 362437) % {dedup.PRIME}) % {dedup.PRIME}) AS m FROM hs, range(1, 31) AS r(p) GROUP BY doc_id, p),
 c AS (SELECT doc_id, (p - 1) // 10 AS band, md5(coalesce(string_agg(m, ',' ORDER BY p), '')) AS cell FROM p GROUP BY ALL)"""
STARS = CELLS + """, e AS (SELECT DISTINCT earlier, doc_id AS later FROM (SELECT *, min(doc_id) OVER (PARTITION BY band, cell) AS earlier FROM c) WHERE earlier < doc_id)"""


def _cells(spark, sf_dir):
    return dedup.lsh_cells(dealt(docs_of(spark, sf_dir).select("doc_id", "text")))


@query(CELLS + " SELECT doc_id, band, cell FROM c")
def minhash_signature(spark, sf_dir):
    return _cells(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("band").cast("long").alias("band"), "cell")


@query(STARS + " SELECT earlier, later FROM e")
def lsh_edges(spark, sf_dir):
    return dedup.lsh_edges(staged(_cells(spark, sf_dir), "cells"))


@query(STARS + " SELECT DISTINCT later AS doc_id FROM e")
def near_dup_has_earlier(spark, sf_dir):
    return lsh_edges(spark, sf_dir).select(F.col("later").alias("doc_id")).distinct()


KEPT = ", e AS (SELECT DISTINCT a.doc_id AS earlier, b.doc_id AS later FROM c a JOIN c b USING (band, cell) WHERE a.doc_id < b.doc_id)"


@query("WITH RECURSIVE " + CELLS.removeprefix("WITH ") + KEPT + """, v AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT earlier AS id FROM e UNION SELECT later FROM e)),
 n AS (SELECT v.id, v.k, list(e.earlier) FILTER (e.earlier IS NOT NULL) AS nb FROM v LEFT JOIN e ON e.later = v.id GROUP BY ALL),
 g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL
       SELECT n.k, CASE WHEN list_has_any(coalesce(n.nb, []), g.kept) THEN g.kept ELSE list_append(g.kept, n.id) END FROM g JOIN n ON n.k = g.k + 1)
 SELECT id AS doc_id FROM v WHERE NOT list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), id)""")
def near_dup_keep_first(spark, sf_dir):
    return dedup.keep_first(_cells(spark, sf_dir)).select(F.col("id").alias("doc_id"))


def _name():
    return F.concat(F.lit("set"), (F.col("item_id") % 4).cast("string"))


GRAMS = """WITH bw AS (SELECT item_id, 'set' || (item_id % 4) AS bench, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
 bg AS (SELECT bench, item_id, unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i+12], ' '))) AS gram FROM bw WHERE len(w) >= 13),
 gi AS (SELECT * FROM bg WHERE len(list_distinct(string_split(gram, ' '))) >= 6 AND len(list_filter(string_split(gram, ' '), lambda t: NOT regexp_matches(t, '^[0-9]+$'))) >= 4),
 gr AS (SELECT gram, arg_min(bench, item_id) AS bench FROM gi GROUP BY gram)"""
HITS = GRAMS + """, dw AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
 dg AS (SELECT doc_id, unnest(generate_series(0, len(w) - 13)) AS i, unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i+12], ' '))) AS gram FROM dw WHERE len(w) >= 13),
 h AS (SELECT doc_id, i, bench FROM dg JOIN gr USING (gram)),
 isl AS (SELECT doc_id, bench, i - row_number() OVER (PARTITION BY doc_id, bench ORDER BY i) AS isl, i FROM h),
 rn AS (SELECT doc_id, bench, count(*) AS n, min(i) AS start FROM isl GROUP BY doc_id, bench, isl HAVING count(*) >= 10),
 con AS (SELECT doc_id, arg_min(bench, start) AS bench FROM rn GROUP BY doc_id)"""


def _grams(spark, sf_dir):
    return dedup.benchmark_grams(table(spark, sf_dir, "benchmark"), _name(), F.col("item_id"))


@query(GRAMS + " SELECT bench, count(*) AS grams FROM gr GROUP BY bench")
def benchmark_grams(spark, sf_dir):
    return _grams(spark, sf_dir).groupBy("bench").agg(F.count("*").alias("grams"))


@query(HITS + " SELECT doc_id, count(*) AS hits FROM h GROUP BY doc_id")
def contam_any_hit(spark, sf_dir):
    return dedup.gram_hits(dealt_docs(spark, sf_dir), _grams(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("hits"))


@query(HITS + " SELECT doc_id, bench FROM con")
def contam_docs(spark, sf_dir):
    return dedup.contaminated(dedup.gram_hits(dealt_docs(spark, sf_dir), _grams(spark, sf_dir)))


FLAGSHIP = (
    "WITH RECURSIVE " + HITS.removeprefix("WITH ") + f""", b AS (SELECT doc_id, source, text, {BODY} AS body FROM documents), {REP_CTE.format(src='b')},
 j AS (SELECT b.*, {REASON} AS reason FROM b LEFT JOIN rep USING (doc_id)),
 jk AS (SELECT doc_id, source, {redacted('body')} AS body FROM j WHERE reason = ''),
 x AS (SELECT doc_id, row_number() OVER (PARTITION BY trim(regexp_replace(lower(body), '\\s+', ' ', 'g')) ORDER BY doc_id) > 1 AS dup FROM jk), """
    + CELLS.removeprefix("WITH ").replace("lower(text)", "lower(body)").replace("FROM documents", "FROM jk JOIN x USING (doc_id) WHERE NOT dup").replace("WITH w AS", "w AS").replace("w AS (", "lw AS (", 1).replace("FROM w)", "FROM lw)")
    + KEPT + """, v AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT earlier AS id FROM e UNION SELECT later FROM e)),
 nb AS (SELECT v.id, v.k, list(e.earlier) FILTER (e.earlier IS NOT NULL) AS nb FROM v LEFT JOIN e ON e.later = v.id GROUP BY ALL),
 g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL
       SELECT nb.k, CASE WHEN list_has_any(coalesce(nb.nb, []), g.kept) THEN g.kept ELSE list_append(g.kept, nb.id) END FROM g JOIN nb ON nb.k = g.k + 1),
 near AS (SELECT id AS doc_id, true AS near FROM v WHERE NOT list_contains((SELECT kept FROM g ORDER BY k DESC LIMIT 1), id)),
 f AS (SELECT j.doc_id, j.source, length(jk.body) AS chars, CASE WHEN reason <> '' THEN reason WHEN dup THEN 'exact_dup' WHEN near THEN 'near_dup' WHEN bench IS NOT NULL THEN 'contaminated' ELSE '' END AS reason
       FROM j LEFT JOIN jk USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN near USING (doc_id) LEFT JOIN con USING (doc_id))
 SELECT source, count(*) AS streamed, count(*) FILTER (reason = '') AS kept, count(*) FILTER (reason = 'too_short') AS too_short, count(*) FILTER (reason = 'repetitive') AS repetitive,
  count(*) FILTER (reason = 'non_english') AS non_english, count(*) FILTER (reason = 'exact_dup') AS exact_dup, count(*) FILTER (reason = 'near_dup') AS near_dup, count(*) FILTER (reason = 'contaminated') AS contaminated,
  CAST(floor(coalesce(sum(chars) FILTER (reason = ''), 0) / 4.0) AS BIGINT) AS est_tokens FROM f GROUP BY source""")


def judged_corpus(spark, sf_dir) -> DataFrame:
    """doc_id, source, chars, reason: cleaning, then exact and near duplicates among what it kept, then contamination."""
    return judged_documents(docs_of(spark, sf_dir), _grams(spark, sf_dir))


def judged_documents(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """judged_corpus of documents (doc_id, a whole number, source and text) against benchmark grams.

    Documents are judged once and written; what follows reads that. Rows are told apart by id and cleaned text, as it
    is normalised for duplicates, so that a repeated id drops no other text and makes no rows; rows that share both have
    one judgement."""
    cleaned = clean.clean_prose(spread(docs.select("doc_id", "source", "text")))
    h = F.sha2(T.normalize(F.col("clean_text")), 256)
    judged = staged(cleaned.select(dedup.row_id(F.col("doc_id"), h).alias("row"), "doc_id", "source", F.col("clean_chars").alias("chars"), "reason", F.col("clean_text").alias("text"), h.alias("h")), "judged")
    kept = judged.where("reason = ''")
    dups = staged(dedup.first_of_each(kept, F.col("h"), "row").where("exact_dup").select("row").distinct(), "exact")
    single = kept.join(dups, "row", "left_anti")
    near = dedup.keep_first(dedup.lsh_cells(single, "row")).select(F.col("id").alias("row"), F.lit(True).alias("near"))
    hits = dedup.gram_hits(kept.select(F.col("row").alias("doc_id"), "text"), grams).distinct()
    bad = dedup.contaminated(hits).withColumnRenamed("doc_id", "row")
    final = judged.select("row", "doc_id", "source", "chars", "reason").join(dups.withColumn("exact_dup", F.lit(True)), "row", "left").join(near, "row", "left").join(bad, "row", "left")
    reason = F.when(F.col("reason") != "", F.col("reason")).when(F.col("exact_dup"), "exact_dup").when(F.col("near"), "near_dup").when(F.col("bench").isNotNull(), "contaminated").otherwise("")
    return final.select("doc_id", "source", "chars", reason.alias("reason"), "bench")


@query(FLAGSHIP)
def corpus_report(spark, sf_dir):
    """Cleaning, exact and near deduplication and decontamination, reported by source."""
    final = judged_corpus(spark, sf_dir)
    count = lambda r: F.count_if(F.col("reason") == r)
    reasons = ("too_short", "repetitive", "non_english", "exact_dup", "near_dup", "contaminated")
    return final.groupBy("source").agg(F.count("*").alias("streamed"), count("").alias("kept"), *(count(r).alias(r) for r in reasons), T.est_tokens(F.coalesce(F.sum(F.when(F.col("reason") == "", F.col("chars"))), F.lit(0))).alias("est_tokens"))


@query("SELECT source, CAST(floor(sum(length(text)) / 4.0) AS BIGINT) AS est_tokens FROM documents GROUP BY source")
def token_estimate_by_source(spark, sf_dir):
    return docs_of(spark, sf_dir).groupBy("source").agg(T.est_tokens(F.sum(F.length("text"))).alias("est_tokens"))


@query("SELECT source, floor(sum(length(text)) * (CASE WHEN source = 'src1' THEN 2 ELSE 1 END) / sum(sum(length(text)) * (CASE WHEN source = 'src1' THEN 2 ELSE 1 END)) OVER () * 1e6 + 0.5) / 1e6 AS share FROM documents GROUP BY source")
def mix_share(spark, sf_dir):
    weight = F.when(F.col("source") == "src1", 2).otherwise(1)
    sums = docs_of(spark, sf_dir).groupBy("source").agg(F.sum(F.length("text")).alias("n")).select("source", (F.col("n") * weight).alias("n"))
    return sums.crossJoin(sums.agg(F.sum("n").alias("total"))).select("source", T.quantised(T.ratio(F.col("n"), F.col("total"))).alias("share"))


@query("SELECT doc_id, source FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 40000")
def budget_prefix_cap(spark, sf_dir):
    return sample.budget_prefix(docs_of(spark, sf_dir).select("doc_id", "source", F.length("text").alias("n")), F.col("n"), 40_000, "source").select("doc_id", "source")


STRIDE = "SELECT doc_id, source, length(left(text, 20000)) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 7 = {}"


@query(STRIDE.format(0))
def stride_sample_train(spark, sf_dir):
    return sample.stride_sample(docs_of(spark, sf_dir), 0, "source").select("doc_id", "source", F.length(F.substring("text", 1, 20_000)).cast("long").alias("chars"))


@query(STRIDE.format(3))
def stride_sample_eval(spark, sf_dir):
    return sample.stride_sample(docs_of(spark, sf_dir), 3, "source").select("doc_id", "source", F.length(F.substring("text", 1, 20_000)).cast("long").alias("chars"))


@query("WITH s AS (" + STRIDE.format(0) + "), b AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s) SELECT doc_id, source, chars FROM b WHERE b < 15000")
def quota_gather(spark, sf_dir):
    return sample.budget_prefix(stride_sample_train(spark, sf_dir), F.col("chars"), 15_000, "source")


QUOTAS = {"src0": 90_000, "src1": 60_000, "src2": 30_000, "src3": 3_000, "src4": 40_000_000}
#: Documents with the file they count as being in: four of a source, of which the last holds seven tenths.
FILED = f"""f AS (SELECT doc_id, source, least(doc_id % 10, 3) AS file, length(text) AS chars, CASE source {' '.join(f"WHEN '{s}' THEN {q}" for s, q in QUOTAS.items())} END AS quota FROM documents WHERE source IN ({', '.join(f"'{s}'" for s in QUOTAS)})),
t AS (SELECT source, file, any_value(quota) AS quota, sum(chars) AS total FROM f GROUP BY source, file)"""
FILLED_TO = "SELECT doc_id, source, file, chars, coalesce(sum(chars) OVER (PARTITION BY source, file ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < level AS taken FROM f JOIN l USING (source, file)"


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", "source", F.least(F.col("doc_id") % 10, F.lit(3)).alias("file"), F.length("text").cast("long").alias("chars"))


@query(f"WITH {FILED}, l AS (SELECT source, file, greatest(1, quota // count(*) OVER (PARTITION BY source)) AS level FROM t), r AS ({FILLED_TO}) SELECT doc_id, source, file, chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY file, doc_id) AS n FROM r WHERE taken) WHERE n <= 30")
def quota_over_files(spark, sf_dir):
    return sample.file_quotas(_filed(spark, sf_dir), F.col("chars"), QUOTAS, max_docs=30)


@query(f"""WITH {FILED}, c AS (SELECT t.source, t.file, t.total, CAST(floor((t.quota - coalesce(sum(o.total) FILTER (o.total < t.total), 0)) / count(*) FILTER (o.total >= t.total)) AS BIGINT) AS share FROM t JOIN t o USING (source) GROUP BY t.source, t.file, t.total, t.quota),
l AS (SELECT source, file, coalesce(max(CASE WHEN total > share THEN greatest(1, share) END) OVER (PARTITION BY source), 9e18) AS level FROM c), r AS ({FILLED_TO}) SELECT doc_id, source, file, chars FROM r WHERE taken""")
def quota_passed_on(spark, sf_dir):
    return sample.file_quotas(_filed(spark, sf_dir), F.col("chars"), QUOTAS, pass_on=True)


BUCKET = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{}'), 1, 8) AS BIGINT) % 10000"


@query(f"SELECT doc_id, {BUCKET.format('val')} < 200 AS is_val FROM documents")
def hash_split_train_val(spark, sf_dir):
    return sample.hash_split(docs_of(spark, sf_dir), F.col("doc_id"), 0.02).select("doc_id", "is_val")


@query("SELECT doc_id, source IN ('src3', 'src7') AS held_out FROM documents")
def holdout_split(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.col("source").isin("src3", "src7").alias("held_out"))


CAP = "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || ':cap'), doc_id) AS r FROM documents) WHERE r <= {}"


@query(CAP.format(12))
def cap_per_group(spark, sf_dir):
    return sample.cap_per_group(docs_of(spark, sf_dir).select("doc_id", "source"), ["source"], 12)


@query(CAP.format("CASE WHEN source = 'src1' THEN 30 ELSE 12 END"))
def cap_per_group_weighted(spark, sf_dir):
    return sample.cap_per_group(docs_of(spark, sf_dir).select("doc_id", "source"), ["source"], F.when(F.col("source") == "src1", 30).otherwise(12))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {NORM} ORDER BY md5(CAST(doc_id AS VARCHAR) || ':cap'), doc_id) AS r FROM documents) WHERE r <= 3")
def repeat_cap(spark, sf_dir):
    return sample.cap_per_group(docs_of(spark, sf_dir).select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("h")), ["h"], 3).select("doc_id")


@query(CHAIN.format(body="text") + " SELECT reason, doc_id, head FROM (SELECT reason, doc_id, left(text, 400) AS head, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS r FROM j) WHERE r <= 3")
def first_k_samples_per_reason(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = clean.clean_documents(dealt_docs(spark, sf_dir).withColumn("head", F.substring("text", 1, 400)), "light")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("reason").orderBy("doc_id"))).where("r <= 3").select("reason", "doc_id", "head")


@query("SELECT doc_id, doc_id % 8 AS worker FROM documents")
def round_robin_partition(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.pmod("doc_id", F.lit(8)).cast("long").alias("worker"))


PACKED = """WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
 o AS (SELECT *, coalesce(sum(len(w) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
 t AS (SELECT source, start + unnest(generate_series(0, len(w))) AS pos, unnest(list_append(w, '</s>')) AS id FROM o),
 p AS (SELECT source, CAST(pos // 256 AS BIGINT) AS window_id, md5(string_agg(id, ' ' ORDER BY pos)) AS ids_md5 FROM t GROUP BY ALL HAVING count(*) = 256)"""


def _packed(spark, sf_dir):
    ids = docs_of(spark, sf_dir).select("doc_id", "source", T.words(F.col("text")).alias("ids"))
    return sample.route(sample.pack_stream(ids, 256, F.lit("</s>"), joint=" "))


@query(PACKED + " SELECT source, window_id, ids_md5, CASE WHEN window_id % 100 = 0 THEN 'val' ELSE 'train' END AS split FROM p")
def pack_windows_words(spark, sf_dir):
    return _packed(spark, sf_dir).select("source", "window_id", F.md5(F.array_join("ids", " ")).alias("ids_md5"), "split")


@query(PACKED + " SELECT source, count(*) FILTER (window_id % 100 <> 0) AS train_windows, count(*) FILTER (window_id % 100 = 0) AS val_windows, count(*) FILTER (window_id % 100 <> 0) * 256 AS train_tokens FROM p GROUP BY source")
def window_index(spark, sf_dir):
    return _packed(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("split") == "train").alias("train_windows"), F.count_if(F.col("split") == "val").alias("val_windows"), (F.count_if(F.col("split") == "train") * 256).alias("train_tokens"))


@query("SELECT count(*) AS files, count(*) FILTER (quality = 1) AS permissive, floor(count(*) FILTER (quality = 1) / count(*) * 1e6 + 0.5) / 1e6 AS share_files, floor(sum(n_chars) FILTER (quality = 1) / sum(n_chars) * 1e6 + 0.5) / 1e6 AS share_bytes FROM documents JOIN labels USING (doc_id)")
def measure_license_summary(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    good = F.col("quality") == 1
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(F.count("*").alias("files"), F.count_if(good).alias("permissive"), zero(T.quantised(T.ratio(F.count_if(good), F.count("*")))).alias("share_files"), zero(T.quantised(T.ratio(F.sum(F.when(good, F.col("n_chars"))), F.sum("n_chars")))).alias("share_bytes"))


@query("SELECT count(*) AS streamed, count(*) FILTER (n_chars >= 600) AS kept, CAST(floor(sum(n_chars) / 4.0) AS BIGINT) AS est_tokens FROM documents")
def merge_reports(spark, sf_dir):
    part = docs_of(spark, sf_dir).groupBy("source").agg(F.count("*").alias("streamed"), F.count_if(F.col("n_chars") >= 600).alias("kept"), F.sum("n_chars").alias("chars"))
    return part.agg(F.coalesce(F.sum("streamed"), F.lit(0)).alias("streamed"), F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"), T.est_tokens(F.coalesce(F.sum("chars"), F.lit(0))).alias("est_tokens"))


@query("SELECT source, floor(avg(n_chars) * 1e6 + 0.5) / 1e6 AS avg_chars, CAST(floor(avg(n_chars) * 1000 / 4.0) AS BIGINT) AS projected_tokens FROM documents GROUP BY source")
def source_yield(spark, sf_dir):
    return docs_of(spark, sf_dir).groupBy("source").agg(T.quantised(F.avg("n_chars")).alias("avg_chars"), F.floor(F.avg("n_chars") * 1000 / 4.0).cast("long").alias("projected_tokens"))
