"""Runs of words looked up in a large set before anything is exploded: 64-bit keys of runs and a Bloom filter of keys.

Words are hashed where they are, runs of hashes combined in Arrow batches. The filter is built in tasks as blocks of bits
and has at most MOST_BITS bits, so that its size is bounded; beyond that it lets more pass, and what passes is compared."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits for each key, positions that a key sets, and the most and fewest bits of a filter (32 MB, 64 kB).
BITS_PER_KEY, POSITIONS, MOST_BITS, FEWEST_BITS = 32, 4, 1 << 28, 1 << 19
#: Bits of a block, as Spark's bitmap functions cut them.
BLOCK_BITS = 32_768


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _run_keys(hashes: pd.Series, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of n words in turn, and how many each row has."""
    sizes = np.array([0 if x is None else len(x) for x in hashes], np.int64)
    runs = np.maximum(sizes - n + 1, 0)
    if not runs.sum():
        return np.zeros(0, np.uint64), runs
    flat = np.concatenate([np.asarray(x, np.int64) for x in hashes if x is not None and len(x)]).view(np.uint64)
    keys = np.zeros(len(flat) - n + 1, np.uint64)
    for k in range(n):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + _scrambled(flat[k : len(flat) - n + 1 + k])
    firsts = np.repeat(np.cumsum(sizes) - sizes, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    return _scrambled(keys[firsts]), runs


def run_keys(hashes: Column, n: int) -> Column:
    """Keys of every run of n words, from their hashes."""

    @F.pandas_udf("array<long>")
    def keys(column: pd.Series) -> pd.Series:
        found, runs = _run_keys(column, n)
        return pd.Series(np.split(found.view(np.int64), np.cumsum(runs)[:-1])) if len(column) else pd.Series([], dtype=object)

    return keys(hashes)


@dataclass
class Bloom:
    bits: int
    words: object  # a broadcast array of bytes

    def places(self, hashes: Column, n: int) -> Column:
        """Places (from 0) of the runs of n words whose key the filter has."""
        bits, words = self.bits, self.words

        @F.pandas_udf("array<int>")
        def pick(column: pd.Series) -> pd.Series:
            keys, runs = _run_keys(column, n)
            table, low, high = words.value, keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
            live = np.arange(len(keys))
            for j in range(POSITIONS):
                at = ((low[live] + np.uint64(j) * high[live]) & np.uint64(bits - 1)).astype(np.int64)
                live = live[(table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            ends = np.cumsum(runs)
            row = np.searchsorted(ends, live, side="right")
            place = (live - (ends - runs)[row]).astype(np.int32)
            return pd.Series(np.split(place, np.searchsorted(row, np.arange(1, len(column)))), dtype=object) if len(column) else pd.Series([], dtype=object)

        return pick(hashes)


def bloom_of(spark: SparkSession, keys: DataFrame, expected: int) -> Bloom:
    """A filter of the column `key` (long)."""
    bits = FEWEST_BITS
    while bits < min(MOST_BITS, BITS_PER_KEY * expected):
        bits *= 2
    low, high = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("key", 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*((low + j * high).bitwiseAND(F.lit(bits - 1)) + 1 for j in range(POSITIONS))))
    placed = keys.where("key is not null").select(at.alias("at"))
    blocks = placed.groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bytes"))
    table = np.zeros(bits // 8, np.uint8)
    for r in blocks.collect():  # at most bits / BLOCK_BITS rows of 4 kB
        at = (r["block"] - 1) * BLOCK_BITS // 8
        table[at : at + len(r["bytes"])] = np.frombuffer(r["bytes"], np.uint8)
    return Bloom(bits, spark.sparkContext.broadcast(table))
