"""Alignment of two tokenizers over the same bytes.

Both encode a text; the running sums of their tokens' bytes (cumsum) are where tokens end, common ends (intersect1d)
cut both sequences into groups, and a search of each end among the cuts labels its token with its group. Tokens of the
two sides that end at the same byte are linked: as many pairs as the product of how many end there, expanded by repeats.
All documents of a batch are aligned at once, one after another on one byte axis, where a document's end is a cut.

A document keeps its distinct pairs with their numbers. Pair counts over the corpus are summed in two shuffles, first
by pair and salt, then by pair; a task's rows have one salt, so that salting sends no more rows than it would without.
Documents look their pairs up in these counts: broadcast while there are at most BROADCAST_PAIRS of them; beyond that
only pairs with more than one in HOT_SHARE of all links are (fewer than HOT_SHARE), and the others meet by a shuffle.

Defined cases: a text that is null or empty, or whose tokens on one side don't spell a space and the text, has no
tokens: zeros and empty groups; strings of special tokens are plain text; repeated rows and ids are documents of their
own, each counted; an empty table gives no rows; columns beside id and text take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graintide.llm.bytebpe import ByteBpe
from graintide.session import small_batches, staged

BROADCAST_PAIRS = 3_000_000
HOT_SHARE = 1000
SALTS = 16
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligner:
    _made: dict[tuple[str, str], "Aligner"] = {}

    @classmethod
    def of(cls, byte_vocab: str, piece_model: str) -> "Aligner":
        """One aligner per worker process."""
        key = (byte_vocab, piece_model)
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    def __init__(self, byte_vocab: str, piece_model: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = ByteBpe.of(byte_vocab), SentencePieceProcessor(model_file=piece_model)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.a_bytes = self.a.token_bytes()
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([*map(len, x)], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.apart = bool(self.a_size.all() and self.b_size.all())
        most = max(len(self.a_bytes), len(self.b_bytes))
        # an id with what follows it: another of its side, the other side, the next group
        self.shown = [np.array([f"{k}{sign}" for k in range(most)], object) for sign in ",|;"]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None if one of them doesn't spell a space and the text."""
        if not text:
            return None
        spelt = (" " + text).encode()
        a, b = self.a.encode_plain(" " + text), self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != spelt or b"".join(map(self.b_bytes.__getitem__, b)) != spelt:
            return None
        return a.astype(np.int64), np.array(b, np.int64)

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Columns n_a, n_b, n_groups, n_links, groups, pairs and times of all texts."""
        found = [self.tokens(t) for t in texts]
        n = len(texts)
        n_a, n_b = (np.array([0 if f is None else len(f[side]) for f in found], np.int64) for side in (0, 1))
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "groups": [""] * n, "pairs": [[]] * n, "times": [[]] * n}
        full = np.flatnonzero(n_a)
        if not len(full):
            return out
        a, b = (np.concatenate([found[k][side] for k in full.tolist()]) for side in (0, 1))
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=self.apart)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        last = np.searchsorted(cuts, end_a[np.cumsum(n_a[full]) - 1])  # the last group of each document
        out["n_groups"][full] = np.diff(np.concatenate(([-1], last)))
        one, two, group = self._links(end_a, end_b, cuts)
        owner = np.searchsorted(last, group)
        out["n_links"][full] = np.bincount(owner, minlength=len(full))
        self._put_pairs(out, full, owner, a[one] * len(self.b_bytes) + b[two])
        self._put_groups(out, full, a, b, group_a, group_b, last)
        return out

    @staticmethod
    def _links(end_a: np.ndarray, end_b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places on both sides of each two tokens that end together, and the group that ends there."""
        first_a, first_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
        many_a, many_b = np.searchsorted(end_a, cuts, side="right") - first_a, np.searchsorted(end_b, cuts, side="right") - first_b
        each = many_a * many_b
        group = np.repeat(np.arange(len(cuts)), each)
        k = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
        return first_a[group] + k // many_b[group], first_b[group] + k % many_b[group], group

    def _put_pairs(self, out: dict, full: np.ndarray, owner: np.ndarray, code: np.ndarray) -> None:
        distinct, which = np.unique(code, return_inverse=True)
        keys, times = np.unique(owner * len(distinct) + which, return_counts=True)
        starts = np.searchsorted(keys, np.arange(len(full) + 1) * len(distinct)).tolist()
        codes, times = distinct[keys % len(distinct)], times.astype(np.int32)
        for k, lo, hi in zip(full.tolist(), starts, starts[1:]):
            out["pairs"][k], out["times"][k] = codes[lo:hi], times[lo:hi]

    def _put_groups(self, out: dict, full: np.ndarray, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last: np.ndarray) -> None:
        """`a1,a2|b1;a3|b2,b3`: tokens in order of group and side, each with the sign that follows it."""
        end_a, end_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        words_a, words_b = np.where(end_a, self.shown[1][a], self.shown[0][a]), np.where(end_b, self.shown[2][b], self.shown[0][b])
        # a token of one side comes after all of the other side's that belong before it
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        words = np.empty(len(a) + len(b), object)
        words[at_a], words[at_b] = words_a, words_b
        ends = (np.searchsorted(group_a, last, side="right") + np.searchsorted(group_b, last, side="right")).tolist()
        for k, lo, hi in zip(full.tolist(), [0, *ends], ends):
            out["groups"][k] = "".join(words[lo:hi].tolist())[:-1]


def aligned(docs: DataFrame, byte_vocab: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups, pairs (distinct, A id times the size of B's vocabulary plus B id) and times."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(byte_vocab, piece_model)
        kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32())}
        for batch in batches:
            found = aligner.align(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c], kind) for c, kind in kinds.items())], names=["doc_id", *kinds])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def pair_counts(documents: DataFrame, size_b: int) -> DataFrame:
    """pair, a_id, b_id, count (its links in all documents) and best (whether no pair of its B id has more)."""
    each = documents.select(F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), F.arrays_zip("pairs", "times").alias("z")).select("salt", F.inline("z"))
    parts = each.groupBy(F.col("pairs").alias("pair"), "salt").agg(F.sum("times").alias("n"))
    counts = parts.groupBy("pair").agg(F.sum("n").alias("count"))
    ids = counts.withColumn("a_id", F.floor(F.col("pair") / size_b).cast("long")).withColumn("b_id", F.pmod("pair", F.lit(size_b)))
    # a B id has at most as many rows here as A's vocabulary has tokens
    return ids.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b_id"))).select("pair", "a_id", "b_id", "count", "best")


def counted(documents: DataFrame, piece_model: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """documents (rows of `aligned`; written once, since they are counted first) with n_best and count_sum, without pairs."""
    from sentencepiece import SentencePieceProcessor

    documents = staged(documents.withColumn("row_key", F.monotonically_increasing_id()), "alignment")
    pairs = staged(pair_counts(documents, SentencePieceProcessor(model_file=piece_model).get_piece_size()), "pair-counts").select("pair", "count", "best")
    each = documents.select("row_key", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    if pairs.count() <= broadcast_pairs:
        looked = each.join(F.broadcast(pairs), "pair")
    else:
        links = documents.agg(F.sum("n_links")).first()[0]
        hot = F.col("count") > links / HOT_SHARE
        flagged = each.join(F.broadcast(pairs.where(hot)), "pair", "left")  # fewer than HOT_SHARE rows
        rest = flagged.where("count is null").select("row_key", "pair", "times").join(pairs.where(~hot).hint("merge"), "pair")
        looked = flagged.where("count is not null").unionByName(rest)
    sums = looked.groupBy("row_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    joined = documents.drop("pairs", "times").join(sums.hint("merge"), "row_key", "left").drop("row_key")
    return joined.fillna(0, ["n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, byte_vocab: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", groups: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Alignment with corpus counts; groups are kept as text, or with groups="digest" as their SHA-256 (an empty string where there are none)."""
    rows = aligned(docs, byte_vocab, piece_model, id_col, text_col)
    if groups == "digest":
        rows = rows.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    return counted(rows, piece_model, broadcast_pairs)
