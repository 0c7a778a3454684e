"""The corpus pipeline: each stage works on all that its predecessor kept, and is written before the next one reads it.

All stages but the last return the columns of documents. STAGES lists (name, function of (spark, docs, sf_dir)).

Defined cases, of every stage: columns beside doc_id, text, lang and n_chars are carried through, whatever their names;
an empty table gives no rows; repeated rows are rows of their own. Language ID drops null texts and such without
letters; rows with a null id are judged like others, but not learned from. Exact dedup counts a null text as empty and
keeps rows of the largest id of a text, null ids only where a text has no other. The Jaccard stage keeps texts without
words and rows with a null id. Substring dedup keeps null texts, rows with a null id and texts without words; a document
all of whose words go is dropped. Packing gives a null or empty text the one piece of its end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.llm import exact_dedup, jaccard, language_id, packing, substring_dedup
from graintide.llm.queries import vocab_path
from graintide.session import staged, table


def placed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named by their place, so that none meets a name of an operator's own, and these names."""
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known with calibrated confidence."""
    rows, c = placed(docs)
    model = language_id.fit(rows, c["doc_id"], c["text"], c["lang"])
    return language_id.identify(rows, model, c["text"]).where("not rejected").select(*c.values()).toDF(*c)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, or all rows that share it; a text that has null ids only keeps them all."""
    rows, c = placed(docs)
    found = exact_dedup.exact_dedup(rows, c["doc_id"], c["text"]).where("kept").select(F.col(c["doc_id"]).alias("kept_id"), F.col("digest").alias("kept_digest"))
    same = F.col(c["doc_id"]).eqNullSafe(F.col("kept_id")) & (exact_dedup.text_digest(c["text"]) == F.col("kept_digest"))
    return rows.join(found.hint("merge"), same, "left_semi").toDF(*c)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 80 percent of their 5-word shingles, directly or along others, that with the smallest doc_id."""
    rows, c = placed(docs)
    groups = jaccard.jaccard_groups(rows, c["doc_id"], c["text"], words=5, percent=80)
    dropped = staged(groups.where(F.col("component_id") != F.col(c["doc_id"])).select(F.col(c["doc_id"]).alias("dropped_id")), "near-copies")
    side = F.broadcast(dropped) if dropped.count() <= jaccard.BROADCAST_ROWS else dropped.hint("merge")
    return rows.join(side, F.col(c["doc_id"]) == F.col("dropped_id"), "left_anti").toDF(*c)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller doc_id has; those left without words go."""
    rows, c = placed(docs)
    cut = substring_dedup.substring_dedup(rows, c["doc_id"], c["text"])
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col(c["text"]))
    cut = cut.where("n_words > n_removed or n_removed = 0")
    if "n_chars" in c:
        cut = cut.withColumn(c["n_chars"], F.when(changed, F.length(text)).otherwise(F.col(c["n_chars"])))
    return cut.withColumn(c["text"], text).select(*c.values()).toDF(*c)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences."""
    pieces = packing.pack_documents(docs, vocab_path("byte_bpe_50k.json"), keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", identified),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("substring dedup", without_repeats),
    ("packing", packed),
]

#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, "stage")
    return docs
