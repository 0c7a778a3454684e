"""Exact deduplication against a persistent digest index (DataFrame and SQL operations only).

The index is a table of (digest, keep_id, n) bucketed and sorted by the digest. A batch is reduced to one row per
digest, anti-joined with the index by sort-merge, and what is new is appended. A text first seen in an earlier batch
stays with the row that was kept then; within a batch the row with the largest id stays.

Defined cases: an index that lost executors or a failed job left behind can be opened again and the batch ingested anew; a
null text counts as the empty text; repeated rows are rows of their own, kept alike; null ids are allowed (a group of null ids only keeps them all,
otherwise a null id is never the one that stays); an empty batch leaves the index as it is and returns no rows;
columns beside id and text take no part, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.session import discard, exists, fresh_path, shuffle_partitions, staged

def text_digest(column: str):
    """SHA-256 of the UTF-8 text as 32 bytes, null as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


class DigestIndex:
    """Digests of all texts ingested so far, kept as an external bucketed table under `path`.

    An index that exists is opened by its path in any session; the number of its buckets is kept beside its rows."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or fresh_path(spark, "digest-index")
        known = exists(spark, f"{self.path}/spec")
        self.buckets = spark.read.schema("buckets INT").json(f"{self.path}/spec").first()["buckets"] if known else buckets or shuffle_partitions(spark)
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n BIGINT) USING parquet"
                f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")
        if not known:
            spark.createDataFrame([(self.buckets,)], "buckets INT").coalesce(1).write.json(f"{self.path}/spec")

    def _append(self, rows: DataFrame) -> None:
        # dealt by the bucket column, so that each task writes the file of one bucket
        dealt = rows.select("digest", "keep_id", "n").repartition(self.buckets, "digest")
        dealt.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Per row of the batch: id, digest, keep_id, group_size (rows of the batch with its text), kept."""
        rows = batch.select(F.col(id_col).cast("long").alias("row_id"), text_digest(text_col).alias("digest"))
        groups = staged(rows.groupBy("digest").agg(F.max("row_id").alias("keep_id"), F.count("*").alias("n")), "digests")
        unseen = groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")
        self._append(unseen)
        known = self.entries().select("digest", F.col("keep_id").alias("first_id"))
        settled = staged(groups.select("digest", "n").join(known.hint("merge"), "digest"), "settled")
        # a digest may be that of a third of all rows: both sides are shuffled here, so that Spark can split it
        joined = rows.join(settled, "digest", "left")
        return joined.select(
            F.col("row_id").alias(id_col),
            "digest",
            F.col("first_id").alias("keep_id"),
            F.col("n").alias("group_size"),
            F.col("row_id").eqNullSafe(F.col("first_id")).alias("kept"),
        )


def exact_dedup(batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row per row of the batch, dropped ones too; without an index one is made and dropped again once all is settled."""
    own = index or DigestIndex(batch.sparkSession)
    try:
        return own.ingest(batch, id_col, text_col)
    finally:
        if index is None:
            own.drop()
