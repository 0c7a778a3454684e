"""Streams whose decisions reach over batches, with what was decided kept as state: first writers, packing, counters.

Only keys and ids reach the workers, never texts, and frames are taken one after another. A key that holds most rows is
split by a salt in a step of its own, so that its rows are thinned out in many tasks before they meet. State lives
in the store that `state_store` sets, survives restarts through the query's checkpoint, and can be given a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Parts into which the rows of one key are dealt before they meet.
SALTS = 16


def state_store(spark: SparkSession) -> None:
    """The state store that keeps maps and lists; to be called before such a stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _First(StatefulProcessor):
    """Of each key the row of the smallest id in the first batch that has it."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "doc_id long", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least = min((int(frame["doc_id"].min()) for frame in rows if len(frame)), default=None)
        if least is not None and not self.taken.exists():
            self.taken.update((least,))
            yield pd.DataFrame({"digest": [key[0]], "doc_id": [least]})

    def close(self) -> None:
        pass


def first_writers(documents: DataFrame, digest: Column, ttl_ms: int | None = None, salts: int = SALTS) -> DataFrame:
    """(digest, doc_id): of all documents of a digest the smallest id in the first batch that has one; rows with a null id take no part.

    Each salt of a digest passes one row on, ever, so that few rows meet however often a text comes. With ttl_ms a digest
    that was taken is forgotten after that time."""
    state_store(documents.sparkSession)
    mode = "none" if ttl_ms is None else "processingTime"
    rows = documents.where("doc_id is not null").select(digest.alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), F.col("doc_id").cast("long").alias("doc_id"))
    thinned = rows.groupBy("digest", "salt").transformWithStateInPandas(_First(ttl_ms), "digest string, doc_id long", "append", mode)
    return thinned.groupBy("digest").transformWithStateInPandas(_First(ttl_ms), "digest string, doc_id long", "append", mode)


class _Packer(StatefulProcessor):
    """Windows of a fixed width from the ids of documents, what is left over being kept for the next batch."""

    def __init__(self, width: int, end: int):
        self.width, self.end = width, end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getListState("left", "id int")
        self.windows = handle.getValueState("windows", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = np.fromiter((r[0] for r in self.left.get()), np.int32) if self.left.exists() else np.zeros(0, np.int32)
        number = self.windows.get()[0] if self.windows.exists() else 0
        frames, made = pd.concat(list(rows)).sort_values("doc_id", kind="stable"), []
        for ids in frames["ids"]:
            held = np.concatenate((held, np.asarray(ids if ids is not None else [], np.int32), np.array([self.end], np.int32)))
            full = len(held) // self.width
            made += list(held[: full * self.width].reshape(full, self.width))
            held = held[full * self.width :]
        self.windows.update((number + len(made),))
        self.left.put([(int(i),) for i in held]) if len(held) else self.left.clear()
        if made:
            yield pd.DataFrame({"source": [key[0]] * len(made), "shard": [key[1]] * len(made), "window_id": range(number, number + len(made)), "ids": made})

    def close(self) -> None:
        pass


def packed_windows(documents: DataFrame, width: int, end: int, shards: int = SALTS) -> DataFrame:
    """(source, shard, window_id, ids): windows of the concatenated ids of each shard of a source, an end id after every document.

    documents: source, doc_id, ids. A source is dealt over shards by a hash of the id, each with a remainder of its own;
    in a batch documents come in the order of their ids."""
    state_store(documents.sparkSession)
    rows = documents.select("source", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.groupBy("source", "shard").transformWithStateInPandas(_Packer(width, end), "source string, shard int, window_id long, ids array<int>", "append", "none")


class _Counter(StatefulProcessor):
    """The first rows of each value, by a map from values to how often they came; a group of values shares one map."""

    def __init__(self, cap: int, ttl_ms: int | None):
        self.cap, self.ttl_ms = cap, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "n int", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[int]] = {}
        for frame in rows:  # of each value no more than the cap of smallest ids is held
            for value, ids in frame.groupby("value", sort=False)["doc_id"]:
                kept[value] = sorted([*kept.get(value, []), *ids.tolist()])[: self.cap]
        out: list[tuple[str, int, int]] = []
        for value, ids in kept.items():
            before = self.seen.getValue((value,))[0] if self.seen.containsKey((value,)) else 0
            taken = ids[: max(0, self.cap - before)]
            out += [(value, i, before + k) for k, i in enumerate(taken)]
            if taken:
                self.seen.updateValue((value,), (before + len(taken),))
        if out:
            yield pd.DataFrame(out, columns=["value", "doc_id", "nth"])

    def close(self) -> None:
        pass


def capped_repeats(rows: DataFrame, value: Column, cap: int, ttl_ms: int | None = None, groups: int = 64) -> DataFrame:
    """(value, doc_id, nth): the first `cap` rows of each value over all batches, in a batch by id; null values take no part."""
    state_store(rows.sparkSession)
    plain = rows.select(value.cast("string").alias("value"), F.col("doc_id").cast("long").alias("doc_id")).where("value is not null and doc_id is not null")
    dealt = plain.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(groups)))
    return dealt.groupBy("bucket").transformWithStateInPandas(_Counter(cap, ttl_ms), "value string, doc_id long, nth int", "append", "none" if ttl_ms is None else "processingTime")
