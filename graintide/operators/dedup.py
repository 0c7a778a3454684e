"""Exact and near deduplication and benchmark decontamination as relational plans."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graintide.functions import text as T
from graintide.operators import bloom
from graintide.session import shuffle_partitions, small_batches, staged

#: Shingle size, bands and rows of MinHash, gram size, run, and what makes a gram informative.
SHINGLE, BANDS, ROWS, GRAM, RUN, MIN_DISTINCT, MIN_ALPHA = 5, 3, 10, 13, 10, 6, 4
#: The modulus of the affine maps, the largest prime below 2**31.
PRIME = 2_147_483_647
#: Rows of grams up to which they are broadcast (about 120 bytes each).
BROADCAST_ROWS = 200_000
#: Edges that one task joins at the end, and cells of a component that one task settles.
ONE_TASK_EDGES, SMALL_COMPONENT = 2_000_000, 200_000


def row_id(number: Column, digest: Column) -> Column:
    """A number for a row by its whole-numbered id and the hex digest of its text, in the order of the ids."""
    return number.cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(19,0)")


def first_of_each(df: DataFrame, key: Column, order: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """(order, carried columns, exact_dup): every row but the first of its key. The key is grouped before anything wide moves.

    Null keys are one key, and rows of one id are told apart by nothing: of a key's smallest id all rows stay."""
    keyed = df.select(order, *(carry or []), F.coalesce(key, F.lit("")).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_first")
    return keyed.join(first, "_key", "left").select(order, *(carry or []), F.coalesce(F.col(order) > F.col("_first"), F.lit(False)).alias("exact_dup"))


def affine(p: int) -> tuple[int, int]:
    """Factor and shift of permutation p, by a fixed linear rule; with a 32-bit value they stay below 2**63."""
    return (p * 1_103_515_245 + 12_345) % PRIME or 1, (p * 69_069 + 362_437) % PRIME


def _least_values(texts: list[str], k: int, permutations: int) -> list[np.ndarray | None]:
    """Per text of words joined by spaces the smallest value of its k-grams under each permutation, null without words.

    A gram is hashed where it stands in the text, to the first 32 bits of its md5. Values are taken modulo 2**31 - 1 by
    shifts, since division takes most of the time otherwise."""
    factors, shifts = (np.array([[affine(p)[n]] for p in range(1, permutations + 1)], np.uint64) for n in (0, 1))
    prime, half = np.uint64(PRIME), np.uint64(31)
    out = []
    for text in texts:
        raw = text.encode()
        spaces = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(raw)]
        spans = zip(starts, ends[k - 1 :]) if len(starts) >= k else ((0, len(raw)),)
        heads = b"".join(md5(raw[a:b]).digest()[:4] for a, b in spans) if raw else b""
        if not heads:
            out.append(None)
            continue
        hashes = np.unique(np.frombuffer(heads, ">u4")).astype(np.uint64)
        least = np.full((permutations, 1), PRIME, np.uint64)
        for k0 in range(0, len(hashes), 4096):
            x = hashes[k0 : k0 + 4096] * factors + shifts
            x = (x & prime) + (x >> half)
            x = (x & prime) + (x >> half)
            least = np.minimum(least, np.where(x >= prime, x - prime, x).min(axis=1, keepdims=True))
        out.append(least[:, 0].astype(np.int64))
    return out


def minhash(words: Column, k: int, permutations: int) -> Column:
    """The smallest value of a text's k-grams under each permutation: one hash a gram, then an affine map of it for each
    permutation. Fewer words than k make one gram; null for none."""

    @F.pandas_udf("array<bigint>")
    def run(joined: pd.Series) -> pd.Series:
        return pd.Series(_least_values(joined.tolist(), k, permutations), dtype=object)

    return run(F.array_join(words, " "))


def lsh_cells(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, band, cell): the band cells of each document. Empty documents share one cell of each band: they have the same signature.

    Rows with a null id have no place in the order and take no part."""
    small_batches(df.sparkSession)
    signed = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), minhash(T.words(F.coalesce(F.col(text_col), F.lit(""))), SHINGLE, bands * rows).alias("sig"))
    cell = lambda b: F.concat_ws(",", F.slice("sig", b * rows + 1, rows).cast("array<string>"))
    return signed.select("id", F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.md5(cell(b)).alias("cell")) for b in range(bands)))))


def lsh_edges(cells: DataFrame) -> DataFrame:
    """(earlier, later): each cell's smallest id with every other one, a star in place of all pairs."""
    first = cells.groupBy("band", "cell").agg(F.min("id").alias("earlier"), F.count("*").alias("_n")).where("_n > 1").select("band", "cell", "earlier")
    return cells.join(first, ["band", "cell"]).where("earlier < id").select("earlier", F.col("id").alias("later")).distinct()


def _local_forest(edges: DataFrame) -> DataFrame:
    """(id, component) of each task's own edges (id, component), for ids that aren't the smallest of their tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one, two = root(one), root(two)
                if one != two:
                    up[max(one, two)] = min(one, two)
        trees = [(x, root(x)) for x in list(up) if up[x] != x]
        for k in range(0, len(trees), 100_000):
            part = trees[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([t[n] for t in part], kind) for n in (0, 1)], names=["id", "component"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(edges.schema["id"].dataType)
    return edges.select("id", "component").mapInArrow(run, edges.select("id", "component").schema)


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component) for each id of edges (earlier, later) that isn't the smallest of those it is connected with.

    Each task replaces its edges by its own trees, which are at most as many rows as it has ids; neighbouring ids are in one
    task. While the trees of all tasks are more than one can join, ids and their neighbours take the smallest one they
    see (large and small stars in turn)."""
    n = shuffle_partitions(edges.sparkSession)
    tidy = edges.select(F.greatest("earlier", "later").alias("id"), F.least("earlier", "later").alias("component")).where("id <> component")
    trees = staged(_local_forest(tidy.repartitionByRange(n, "component", "id")), "trees")
    before = None
    while trees.count() > one_task:
        ends = trees.union(trees.select("component", "id"))
        least = ends.groupBy(F.col("id").alias("_id")).agg(F.min("component").alias("_m")).select("_id", F.least("_id", "_m").alias("_m"))
        large = staged(ends.where("component > id").join(least, F.col("id") == F.col("_id")).select(F.col("component").alias("id"), F.col("_m").alias("component")).where("id <> component").distinct(), "large-star")
        least = large.groupBy(F.col("id").alias("_id")).agg(F.min("component").alias("_m"))
        small = large.join(least, F.col("id") == F.col("_id")).select(F.col("component").alias("id"), F.col("_m").alias("component")).where("id <> component")
        trees = staged(small.union(least).distinct(), "small-star")
        now = tuple(trees.agg(F.count("*"), F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first())
        if now == before:
            return trees
        before = now
    return _local_forest(trees.coalesce(1))


def _first_come(rows: DataFrame) -> DataFrame:
    """(id) dropped by the greedy pass, of rows (component, id, band, cell); a component's rows are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component = at = None
        owned: set = set()
        mine: list = []
        started = False

        def settle() -> list:
            if owned.isdisjoint(mine):
                owned.update(mine)
                return []
            return [at]

        for batch in batches:
            gone = []
            for c, i, band, cell in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if started and (c != component or i != at):
                    gone += settle()
                    mine = []
                if not started or c != component:
                    owned = set()
                started, component, at = True, c, i
                mine.append((band, cell))
            yield pa.RecordBatch.from_arrays([pa.array(gone, kind)], names=["id"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array(settle(), kind)], names=["id"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["id"].dataType)
    dealt = rows.select("component", "id", "band", "cell").repartition(shuffle_partitions(rows.sparkSession), "component").sortWithinPartitions("component", "id")
    return dealt.mapInArrow(run, rows.select("id").schema)


def keep_first(cells: DataFrame, small: int = SMALL_COMPONENT) -> DataFrame:
    """(id) dropped: a document goes exactly when an earlier one that stays shares a cell with it.

    What isn't connected can't decide about one another, so that components are found first. One of at most `small` cells is
    settled by one task, document by document; in a larger one, such as very many copies make, all that can be settled
    at once is, round by round."""
    cells = staged(cells.distinct(), "cells")
    first = cells.groupBy("band", "cell").agg(F.min("id").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    linked = staged(cells.join(first, ["band", "cell"]), "linked")
    found = components(linked.where("first < id").select(F.col("first").alias("earlier"), F.col("id").alias("later"))).withColumnRenamed("id", "_id")
    rows = staged(linked.join(found, F.col("id") == F.col("_id"), "left").select("id", "band", "cell", F.coalesce("component", "id").alias("component")), "components")
    # one row for each `small` cells at most
    large = F.broadcast(rows.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("component"))
    dropped = _first_come(rows.join(large, "component", "left_anti"))
    return dropped.union(_settled_by_rounds(rows.join(large, "component", "left_semi").select("id", "band", "cell"))).distinct()


def _settled_by_rounds(cells: DataFrame) -> DataFrame:
    """(id) dropped; cells are such that more than one document has.

    In each round the first of a cell that isn't dropped decides: it stays where it is first in all of its cells, and
    what shares a cell with one that stays goes. The smallest open id always settles, so that the rounds end."""
    open_cells = staged(cells, "open")
    dropped = open_cells.select("id").limit(0)
    while not open_cells.isEmpty():
        first = open_cells.groupBy("band", "cell").agg(F.min("id").alias("first"))
        met = staged(open_cells.join(first, ["band", "cell"]), "met")
        kept = met.groupBy("id").agg(F.min(F.col("id") == F.col("first")).alias("_all")).where("_all").select(F.col("id").alias("first"))
        gone = staged(met.join(kept, "first", "left_semi").where("id <> first").select("id").distinct(), "gone")
        dropped = dropped.union(gone)
        # cells whose first one stays are settled whole; of the others those that went leave
        left = met.join(kept, "first", "left_anti").join(gone, "id", "left_anti").select("id", "band", "cell")
        open_cells = staged(left, "open")
    return dropped


def informative(gram: Column) -> Column:
    tokens = F.split(gram, " ")
    return (F.size(F.array_distinct(tokens)) >= MIN_DISTINCT) & (F.size(F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$"))) >= MIN_ALPHA)


def benchmark_grams(bench: DataFrame, name: Column, order: Column, n: int = GRAM) -> DataFrame:
    """(gram, bench): informative n-grams, each owned by the first benchmark that has it."""
    grams = bench.select(name.alias("bench"), order.alias("_o"), F.explode(T.ngrams(T.words(F.col("text")), n)).alias("gram")).where(informative(F.col("gram")))
    return grams.groupBy("gram").agg(F.min_by("bench", "_o").alias("bench"))


def gram_hits(docs: DataFrame, grams: DataFrame, n: int = GRAM) -> DataFrame:
    """(doc_id, i, bench): every window of a document that is a benchmark gram.

    A filter of the grams' keys is asked for every window before any is cut out, so that few windows besides hits are
    made and sent; those are compared with the grams themselves."""
    spark = docs.sparkSession
    small_batches(spark)
    grams = staged(grams, "grams")
    known = grams.count()
    keys = grams.select(F.get(bloom.run_keys(bloom.word_hashes(F.split("gram", " ")), n), F.lit(0)).alias("key"))
    filtered = bloom.bloom_of(spark, keys, known)
    words = docs.select("doc_id", T.words(F.col("text")).alias("w"))
    spots = words.withColumn("at", filtered.places(bloom.word_hashes(F.col("w")), n)).where(F.size("at") > 0)
    windows = spots.select("doc_id", "w", F.explode("at").alias("i")).select("doc_id", "i", F.array_join(F.slice("w", F.col("i") + 1, n), " ").alias("gram"))
    side = F.broadcast(grams) if known <= BROADCAST_ROWS else grams.hint("shuffle_hash")
    return windows.join(side, "gram").select("doc_id", "i", "bench")


def contaminated(hits: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, bench): documents with `run` consecutive windows of one benchmark; the run that is complete first names it."""
    island = F.col("i") - F.row_number().over(W.partitionBy("doc_id", "bench").orderBy("i"))
    runs = hits.withColumn("island", island).groupBy("doc_id", "bench", "island").agg(F.count("*").alias("n"), F.min("i").alias("start")).where(F.col("n") >= run)
    return runs.groupBy("doc_id").agg(F.min_by("bench", "start").alias("bench"))
