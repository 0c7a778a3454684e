"""Near duplicates among embeddings by spherical-cap filters.

A filter is a direction put together from one codeword for each of two blocks of coordinates (a random product code,
made from a seed), after a seeded rotation. A vector goes to every filter whose direction exceeds a score; these are
list-decoded block by block, without listing the filters that don't. There are about as many filters as vectors, so
that a filter holds few of them however many there are. The score is set on seeded random pairs that lie exactly at
the threshold, so that the wanted share of them meets in a filter; closer pairs meet more surely.

Filters travel in cells, a cell being those with one first codeword and a range of second ones: a vector is sent once
to each of its cells, not to each of its filters, with the list of them. In a cell the vectors of each filter are
compared in double precision; a pair counts under the first filter that it shares, so that links are counted once.
Equal vectors are one node with a number of its own and a multiplicity. A cell that very many vectors enter is cut
into parts, and each two parts meet in a task of their own, which returns counts and a spanning forest, never pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
their own component; vectors of different lengths never link; rows with one id are separate rows of one id; a null id
is kept with a null component unless its vector equals another; an empty table gives no rows; columns beside id and
vector take no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graintide.llm.components import connected_components
from graintide.llm.jaccard import Forest
from graintide.llm.wordbytes import mix
from graintide.session import shuffle_partitions, small_batches, staged

#: Blocks of a code, and the share of pairs at the threshold that must meet.
BLOCKS, RECALL = 2, 0.93
#: Vectors of a cell that one task takes from each of its two parts, and how many a cell is meant to hold at most.
PART, CELL = 8192, 6000
#: Cells up to which their sizes are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000


class ProductCode:
    """Filters for vectors of one length; words is the number of codewords of each block."""

    def __init__(self, dim: int, words: int, cosine: float, recall: float = RECALL, seed: int = 20, trials: int = 400):
        rng = np.random.default_rng([seed, dim, words])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.cuts = np.array_split(np.arange(dim), min(BLOCKS, dim))
        self.words = []
        for cut in self.cuts:
            c = rng.standard_normal((words, len(cut)))
            self.words.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(len(cut) / dim))
        met = []
        for _ in range(trials):
            x, y = (v / np.linalg.norm(v) for v in rng.standard_normal((2, dim)))
            y = y - (x @ y) * x
            y = cosine * x + math.sqrt(1 - cosine**2) * y / max(np.linalg.norm(y), 1e-300) if dim > 1 else x
            met.append(self._best(x, y))
        self.score = float(np.quantile(met, 1 - recall))

    def _best(self, x: np.ndarray, y: np.ndarray) -> float:
        """The highest score that both turned vectors reach in one filter; of each block only codewords that no other beats for both matter."""
        both = np.zeros((1, 2))
        for cut, w in zip(self.cuts, self.words, strict=True):
            scores = np.stack([w @ x[cut], w @ y[cut]], axis=1)
            scores = scores[np.argsort(-scores[:, 0], kind="stable")]
            top = np.maximum.accumulate(scores[:, 1])
            front = scores[np.concatenate(([True], scores[1:, 1] > top[:-1]))]
            both = (both[:, None, :] + front[None, :, :]).reshape(-1, 2)
        return float(both.min(axis=1).max())

    def exceeded(self, vectors: np.ndarray) -> list[list[int]]:
        """The filters that each unit vector exceeds, ascending; the best one where it exceeds none."""
        turned = vectors @ self.turn
        scores = [turned[:, cut] @ w.T for cut, w in zip(self.cuts, self.words, strict=True)]
        return [self._decode([s[k] for s in scores]) for k in range(len(vectors))]

    def _decode(self, scores: list[np.ndarray]) -> list[int]:
        n = len(scores[0])
        best_after = [*itertools.accumulate((s.max() for s in reversed(scores[1:])), initial=0.0)][::-1]
        codes, sums = np.zeros(1, np.int64), np.zeros(1)
        for s, rest in zip(scores, best_after, strict=True):
            reach = sums[:, None] + s[None, :]
            a, b = np.nonzero(reach + rest >= self.score)
            codes, sums = codes[a] * n + b, reach[a, b]
            if not len(codes):
                return [int(sum(int(s.argmax()) * n ** (len(scores) - 1 - k) for k, s in enumerate(scores)))]
        return sorted(codes.tolist())


def _unit(vectors: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision from float32 (exact) or float64 bytes, which the first byte tells apart."""
    v = np.stack([np.frombuffer(x, np.float32 if x[:1] == b"f" else np.float64, offset=1).astype(np.float64) for x in vectors])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def code_words(rows: int) -> int:
    """Codewords of a block: there are as many filters as vectors."""
    return max(12, math.ceil(rows ** (1 / BLOCKS)))


def cell_width(rows: int, words: int) -> int:
    """Second codewords of a cell, so that it holds CELL vectors at most on the whole (a vector enters some ten first codewords)."""
    return max(1, words // max(1, math.ceil(10 * rows / words / CELL)))


def _bytes(vector: list[float]) -> bytes:
    v = np.asarray(vector, np.float64)
    with np.errstate(over="ignore", under="ignore"):
        single = v.astype(np.float32)
    return b"f" + single.tobytes() if (single == v).all() else b"d" + v.tobytes()


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    small_batches(spark, 2048)
    rows = embeddings.select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 becomes 0.0, so that equal vectors have equal text
    rows = rows.select("row_id", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))).alias("v"))
    keyed = rows.select("row_id", "v", F.sha2(F.to_json(F.struct("v")), 256).alias("digest"))
    classes = keyed.where("v is not null and row_id is not null").groupBy("digest").agg(F.min("row_id").alias("rep"), F.count("*").alias("copies"))
    # several vectors may have one id, so that nodes have numbers, which staging fixes
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    member = staged(keyed.select("row_id", "v", "digest").join(classes, "digest", "left").select("row_id", F.when(F.col("rep") == F.col("row_id"), F.col("v")).alias("v"), "node", "copies"), "vectors")
    nodes = member.where("v is not null").dropDuplicates(["node"]).select(F.col("node").alias("row_id"), "copies", "v")
    count = nodes.count()
    words = code_words(count)
    width = cell_width(count, words)
    coded = staged(_coded(nodes, words, width, cosine), "filters")
    per = staged(coded.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("size")).where("size > 1").select("cell", F.ceil(F.col("size") / PART).cast("long").alias("parts")), "cell-sizes")
    small = per.count() <= BROADCAST_ROWS
    met = coded.select("row_id", "copies", "v", "listed", F.explode("cells").alias("cell")).join(F.broadcast(per) if small else per.hint("merge"), "cell")
    found = staged(_met(met, words, width, cosine), "found")
    groups = connected_components(found.where("other is not null").select(F.col("row_id").alias("u"), F.col("other").alias("v"))).select(F.col("id").alias("node"), "component")
    links = found.groupBy(F.col("row_id").alias("node")).agg(F.sum("links").alias("links"))
    known = staged(classes.select("node", "rep", "copies").join(links, "node", "left").join(groups, "node", "left"), "linked")
    firsts = staged(known.where("component is not null").groupBy("component").agg(F.min("rep").alias("first")), "components")
    known = known.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts.hint("merge"), "component", "left")
    known = staged(known.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id")), "known")
    joined = member.select("row_id", "node").join(known, "node", "left")
    return joined.select(
        F.col("row_id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "row_id").alias("component_id"),
        F.col("row_id").eqNullSafe(F.coalesce("component_id", "row_id")).alias("kept"),
    )


def _coded(nodes: DataFrame, words: int, width: int, cosine: float) -> DataFrame:
    """Each vector with the cells that it enters and the filters that it exceeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(k)
            raw = [_bytes(v) for v in vectors]
            cells: list[list[int]] = [[] for _ in vectors]
            listed: list[bytes] = [b""] * len(vectors)
            for dim, which in by_dim.items():
                if dim not in codes:
                    codes[dim] = ProductCode(dim, words, cosine)
                for k, found in zip(which, codes[dim].exceeded(_unit([raw[k] for k in which])), strict=True):
                    cells[k] = [c * 65_536 + dim % 65_536 for c in sorted({_cell(f, words, width) for f in found})]
                    listed[k] = np.array(found, _kind(words)).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(cells, pa.list_(pa.int64())), pa.array(listed, pa.binary())], names=["row_id", "copies", "v", "cells", "listed"])

    return nodes.mapInArrow(run, "row_id long, copies long, v binary, cells array<long>, listed binary")


def _kind(words: int) -> type:
    return np.uint32 if words < 65_536 else np.int64


def _cell(filters, words: int, width: int):
    """The cell of a filter, or of each of an array of them."""
    return filters // words * words + filters % words // width


def first_shared(filters: list[np.ndarray], own: int) -> np.ndarray:
    """For each row, as packed bits, which of the filters before `own` it has (numbered within these rows)."""
    before = [f[f < own] for f in filters]
    sizes = [len(f) for f in before]
    names, at = np.unique(np.concatenate(before), return_inverse=True)
    bits = np.zeros((len(filters), max(1, len(names))), bool)
    bits[np.repeat(np.arange(len(filters)), sizes), at] = True
    return np.packbits(bits, axis=1)


def compare(ids: list[int], copies: np.ndarray, filters: list[np.ndarray], vectors: list[bytes], side: np.ndarray, cell: int, words: int, width: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links that count under the filters of a cell: how many each row has (weighted by copies), and a spanning forest."""
    links, forest, edges = np.zeros(len(ids), np.int64), Forest(len(ids)), []
    dims = np.array([(len(v) - 1) // (4 if v[:1] == b"f" else 8) for v in vectors])
    flat = np.concatenate(filters).astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), [len(f) for f in filters])
    here = _cell(flat, words, width) == cell
    flat, owner = flat[here], owner[here]
    unit: dict[int, np.ndarray] = {}
    place = np.zeros(len(ids), np.int64)
    for dim in np.unique(dims).tolist():
        which = np.flatnonzero(dims == dim)
        unit[dim], place[which] = _unit([vectors[k] for k in which]), np.arange(len(which))
    order = np.lexsort((owner, dims[owner], flat))
    flat, owner = flat[order], owner[order]
    turn = np.concatenate(([True], (flat[1:] != flat[:-1]) | (dims[owner[1:]] != dims[owner[:-1]])))
    starts = np.flatnonzero(turn).tolist()
    for start, end in zip(starts, [*starts[1:], len(flat)], strict=True):
        which = owner[start:end]
        a, b = which[side[which] != 1], which[side[which] != 0]
        if not len(a) or not len(b) or end - start < 2:
            continue
        all_units = unit[int(dims[which[0]])]
        two = all_units[place[b]].T
        for at in range(0, len(a), 256):
            part = a[at : at + 256]
            i, j = np.nonzero(all_units[place[part]] @ two >= cosine)
            i, j = part[i], b[j]
            keep = (i < j) | (side[i] != 2)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            met = np.unique(np.concatenate((i, j)))
            bits = first_shared([filters[k] for k in met], int(flat[start]))
            new = ~(bits[np.searchsorted(met, i)] & bits[np.searchsorted(met, j)]).any(axis=1)
            i, j = i[new], j[new]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            edges += [(ids[x], ids[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True) if forest.join(x, y)]
    return links, edges


def _met(met: DataFrame, words: int, width: int, cosine: float) -> DataFrame:
    """(row_id, links, other): counts and forest edges from every cell's parts."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        task, side, ids, copies, filters, vectors = (list(x) for x in zip(*held, strict=True))
        cell = int(task[0].split(".")[0]) // 65_536
        links, edges = compare(ids, np.array(copies), [np.frombuffer(f, _kind(words)) for f in filters], vectors, np.array(side), cell, words, width, cosine)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([
            pa.array([ids[k] for k in some] + [e[0] for e in edges], pa.int64()),
            pa.array([int(links[k]) for k in some] + [0] * len(edges), pa.int64()),
            pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()),
        ], names=["row_id", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    part = F.pmod(F.xxhash64("row_id"), F.col("parts"))
    paired = met.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") == high, 1).otherwise(0)
    dealt = paired.select(F.concat_ws(".", "cell", low, high).alias("task"), side.alias("side"), "row_id", "copies", "listed", "v")
    n = shuffle_partitions(met.sparkSession)
    return dealt.repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, "row_id long, links long, other long")
