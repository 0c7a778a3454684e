"""Substring deduplication over super-k-mers.

A window is `width` consecutive words. Its minimiser is the smallest hash of the short word runs in it, and
consecutive windows of a document that share one travel as one packed string to the bucket of that minimiser. In a
bucket the windows are sorted by hashes, those of equal ones are compared word by word, since the strings are there,
and each that a document with a smaller id has too is marked. Word hashes have a key of the job.

Before they travel, windows that a smaller document of the same batch has are marked on the spot, so that of a
passage that very many documents share each batch sends one copy. Minimisers that more than a bounded share of the
remaining super-k-mers have are counted first (there are at most a few times as many as shuffle partitions); their
windows are dealt by the hash of the whole window instead, for all documents alike.

Defined cases: a null text has no words; texts of fewer words than a window lose none; rows with one id are one
document, of which no row removes words from another; rows with a null id are kept whole and remove nothing; no
documents give no rows; columns beside id and text take no part, and such as have the name of a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graintide.llm.wordbytes import blobs, eights, equal_words, give_back, hashed_words, mix, new_key, powers, window_hash
from graintide.session import shuffle_partitions, small_batches, staged

WIDTH, SHORT = 13, 3
#: Windows that a bucket has on average.
BUCKET_WINDOWS = 1_000_000
#: Documents with marks, and bytes of these, up to which they are broadcast; beyond, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 64 << 20


def rolling(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each `width` consecutive words."""
    n = max(0, len(words) - width + 1)
    up, down = powers(len(words) + 1)
    both = []
    for seed in (101, 202):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words, seed) * up[: len(words)], dtype=np.uint64)))
        both.append(mix((sums[width:] - sums[:-width])[:n] * down[:n], seed) if n else np.zeros(0, np.uint64))
    return both[0], both[1]


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each `span` consecutive values."""
    have, out = 1, values
    while 2 * have <= span:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(out) - (span - have)], out[span - have :]) if span > have else out


class Words:
    """Windows of words by their bytes; a window is the number of its first word."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int):
        self.raw, self.starts, self.ends, self.width = raw, starts, ends, width
        self.view = eights(raw)

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        same = np.ones(len(i), bool)
        for k in range(self.width):
            live = np.flatnonzero(same)
            same[live] = equal_words(self.view, self.starts, self.ends, i[live] + k, j[live] + k)
        return same

    def words(self, i: int) -> tuple[bytes, ...]:
        return tuple(self.raw[a:b].tobytes() for a, b in zip(self.starts[i : i + self.width].tolist(), self.ends[i : i + self.width].tolist(), strict=True))


def repeated(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, window: np.ndarray, words: Words) -> np.ndarray:
    """Which windows a smaller document has too, all those given being compared: by hashes first, then by their words."""
    if not len(h1):
        return np.zeros(0, bool)
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    least = np.minimum.reduceat(doc[order], first)
    later = doc[order] > least[group]
    head = np.minimum.reduceat(np.where(later, len(order), np.arange(len(order))), first)  # one of the smallest document
    out, place = np.zeros(len(h1), bool), np.flatnonzero(later)
    same = words.equal(window[order[place]], window[order[head[group[place]]]])
    out[order[place[same]]] = True
    for g in np.unique(group[place[~same]]).tolist():  # different windows of equal hashes: settled by their words
        members = order[np.flatnonzero(group == g)].tolist()
        smallest_of: dict[tuple, int] = {}
        for k in members:
            said = words.words(int(window[k]))
            smallest_of[said] = min(int(doc[k]), smallest_of.get(said, int(doc[k])))
        out[members] = [int(doc[k]) > smallest_of[words.words(int(window[k]))] for k in members]
    return out


def runs_of(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where breaks is true."""
    starts = np.flatnonzero(breaks)
    return starts, np.diff(np.append(starts, len(breaks)))


class Batch:
    """The windows of a few whole texts: which are repeats already, and the super-k-mers of the others."""

    def __init__(self, raw: bytes, offsets: np.ndarray, ids: np.ndarray, width: int, hot: np.ndarray, secret: int):
        self.starts, self.ends, h = hashed_words(raw, key=secret)
        edges = np.searchsorted(self.starts, offsets)
        row = np.repeat(np.arange(len(ids)), np.diff(edges))
        self.first_word = edges[:-1]
        n = max(0, len(h) - width + 1)
        at = np.flatnonzero(row[:n] == row[width - 1 :]) if n else np.zeros(0, np.int64)
        h1, h2 = rolling(h, width)
        least = smallest(window_hash(h, SHORT), width - SHORT + 1) if n else np.zeros(0, np.uint64)
        dup = repeated(h1[at], h2[at], ids[row[at]], at, Words(np.frombuffer(raw, np.uint8), self.starts, self.ends, width))
        self.marked, self.marked_row = at[dup], row[at[dup]]
        at = at[~dup]
        key = least[at]
        if len(hot):
            key = np.where(np.isin(key, hot), h1[at], key)
        breaks = np.ones(len(at), bool)
        breaks[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]) | (key[1:] != key[:-1])
        k, self.windows = runs_of(breaks)
        self.word, self.key, self.row = at[k], key[k], row[at[k]]

    def mark_spans(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and end word (within its text) of each run of marked windows."""
        breaks = np.ones(len(self.marked), bool)
        breaks[1:] = (self.marked[1:] != self.marked[:-1] + 1) | (self.marked_row[1:] != self.marked_row[:-1])
        k, n = runs_of(breaks)
        row = self.marked_row[k]
        start = self.marked[k] - self.first_word[row]
        return row, start, start + n + width - 1


def _batches(batch: pa.RecordBatch, width: int, hot: np.ndarray, secret: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, Batch]]:
    ids = np.asarray(batch.column(0).to_pylist(), np.int64)
    keys = np.asarray(batch.column(1).to_pylist(), np.int64)
    for first, end, raw, offsets in blobs(batch.column(2).to_pylist()):
        yield raw, ids[first:end], keys[first:end], Batch(raw, offsets, ids[first:end], width, hot, secret)


def hot_minimisers(rows: DataFrame, width: int, partitions: int, secret: int) -> tuple[np.ndarray, int]:
    """Minimisers that more than 1 / (2 * partitions) of all super-k-mers have, and the number of windows.

    Each batch reports those that have half that share of it, so none can be missed; at most 4 * partitions pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, found in _batches(batch, width, np.zeros(0, np.uint64), secret):
                key, n = np.unique(found.key, return_counts=True)
                often = n * 4 * partitions >= max(1, len(found.key))
                key, n = key[often].view(np.int64), n[often]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.append(key, 0)), pa.array(np.append(n, 0)),
                    pa.array(np.append(np.zeros(len(key), np.int64), len(found.key))), pa.array(np.append(np.zeros(len(key), np.int64), found.windows.sum())),
                ], names=["key", "n", "total", "windows"])
        give_back()

    counted = rows.mapInArrow(count, "key long, n long, total long, windows long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "total", "windows")))
    counted = staged(counted, "minimisers")
    total, windows = counted.agg(F.sum("total"), F.sum("windows")).first()
    hot = counted.where((F.col("n") > 0) & (F.col("n") * 4 * partitions >= (total or 0))).select("key").collect()
    return np.sort(np.array([r["key"] for r in hot], np.int64).view(np.uint64)), int(windows or 0)


def repeat_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, row_key, first, end): spans of words to remove; spans of a row can touch or overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row_key"), F.col(text_col).alias("text"))
    partitions = shuffle_partitions(spark)
    secret = new_key()
    hot, windows = hot_minimisers(rows, width, partitions, secret)
    buckets = max(4 * partitions, windows // BUCKET_WINDOWS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for raw, ids, keys, found in _batches(batch, width, hot, secret):
                to, payload = [], []
                row, first, end = found.mark_spans(width)
                if len(row):
                    to.append(int(ids[0]) % buckets)
                    payload.append(b"M" + squeeze.compress(np.stack([ids[row], keys[row], first, end]).tobytes()))
                bucket = (mix(found.key, 303) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                begin = found.starts[found.word]
                stop = found.ends[found.word + found.windows + width - 2] if len(found.word) else begin
                place = found.word - found.first_word[found.row]
                for k, n in zip(*runs_of(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))) if len(order) else ((), ()), strict=True):
                    part = order[k : k + n]
                    here, local = np.unique(found.row[part], return_inverse=True)
                    head = np.concatenate(([len(here), n], ids[here], keys[here], local, place[part], found.windows[part])).astype(np.int64)
                    text = b"\n".join([raw[a:b] for a, b in zip(begin[part].tolist(), stop[part].tolist(), strict=True)])
                    to.append(int(bucket[part[0]]))
                    payload.append(b"S" + squeeze.compress(head.tobytes() + text))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(payload, pa.binary())], names=["bucket", "payload"])
        give_back()

    def settle(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        parts: list[tuple] = []
        raws, edges, words, size = [], [], 0, 0
        for p in payloads:
            data = expand.decompress(p[1:])
            if p[:1] == b"M":
                yield out(*np.frombuffer(data, np.int64).reshape(4, -1))
                continue
            d, n = np.frombuffer(data, np.int64, 2)
            head = np.frombuffer(data, np.int64, 2 + 2 * d + 3 * n)[2:]
            local, place, count = head[2 * d :].reshape(3, n)
            raw = np.frombuffer(data, np.uint8)[8 * (2 + 2 * d + 3 * n) :]
            starts, ends, h = hashed_words(raw, key=secret)
            h1, h2 = rolling(h, width)
            skmer = np.repeat(np.arange(n), count)
            step = np.arange(len(skmer)) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(count + width - 1) - (count + width - 1), count) + step
            parts.append((h1[at], h2[at], head[:d][local][skmer], head[d : 2 * d][local][skmer], place[skmer] + step, at + words))
            raws.append(raw)
            edges.append((starts + size, ends + size))
            words, size = words + len(starts), size + len(raw)
        if not parts:
            return
        h1, h2, doc, key, place, window = (np.concatenate(x) for x in zip(*parts, strict=True))
        dup = repeated(h1, h2, doc, window, Words(np.concatenate(raws), *(np.concatenate(x) for x in zip(*edges, strict=True)), width))
        doc, key, place = doc[dup], key[dup], place[dup]
        order = np.lexsort((place, key, doc))
        doc, key, place = doc[order], key[order], place[order]
        breaks = np.ones(len(doc), bool)
        breaks[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] > place[:-1] + 1)
        k, n = runs_of(breaks)
        if len(k):
            yield out(doc[k], key[k], place[k], place[k + n - 1] + width)

    def out(*cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "row_key", "first", "end"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and held:
                    yield from settle(held)
                    held = []
                bucket = b
                held.append(p)
        if held:
            yield from settle(held)
        give_back()

    dealt = rows.mapInArrow(cut, "bucket long, payload binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(compare, "doc_id long, row_key long, first long, end long")


def merged_spans(marks: DataFrame) -> DataFrame:
    """(_id, _key, _spans): the marked spans of each row, those that touch made one, as pairs of 32-bit numbers."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, spans = None, []
        done: list[tuple] = []
        for batch in batches:
            for doc, key, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, key) != at:
                    if at:
                        done.append((*at, np.array(spans, "<i4").tobytes()))
                    at, spans = (doc, key), [first, end]
                elif first <= spans[-1]:
                    spans[-1] = max(spans[-1], end)
                else:
                    spans += [first, end]
            yield rows(done)
            done = []
        if at:
            yield rows([(*at, np.array(spans, "<i4").tobytes())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["_id", "_key", "_spans"])

    n = shuffle_partitions(marks.sparkSession)
    return marks.repartition(n, "doc_id", "row_key").sortWithinPartitions("doc_id", "row_key", "first", "end").mapInArrow(merge, "_id long, _key long, _spans binary")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: its columns, n_words, n_removed and kept, the kept words joined by one space."""
    docs = docs.drop("n_words", "n_removed", "kept")
    marks = staged(merged_spans(repeat_marks(docs, id_col, text_col, width)), "marks")
    names = docs.columns
    at, text_at = names.index(id_col), names.index(text_col)
    # columns go by place, so that no name of theirs meets one of ours
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))
    count, size = marks.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_spans") + 16), F.lit(0))).first()
    side = F.broadcast(marks) if count <= BROADCAST_ROWS and size <= BROADCAST_BYTES else marks.hint("merge")
    joined = rows.join(side, (F.col(f"c{at}").cast("long") == F.col("_id")) & (F.xxhash64(f"c{text_at}") == F.col("_key")), "left").drop("_id", "_key")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # bytes split on the same white space
                left, at = [], 0
                for first, end in np.frombuffer(spans or b"", "<i4").reshape(-1, 2).tolist():
                    left += words[at:first]
                    at = end
                left += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept"])
        give_back()

    return joined.mapInArrow(remove, schema)
