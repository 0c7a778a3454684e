"""Deterministic sampling, caps, splits and packing of token streams. Ties are broken by id, chance is a hash of it."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graintide.functions import text as T
from graintide.session import shuffle_partitions, staged

#: Spans of ids for each shuffle partition, and ids that are looked at for each span to find where spans end.
SPANS, LOOKED_AT = 8, 16


def spans(df: DataFrame, order: str) -> Column:
    """The number of the span of ids that a row is in, ids being of any type that has an order; null for a null id.

    Spans end at quantiles of the ids whose hashes are smallest, so that ids far from the rest make no empty spans."""
    wanted = SPANS * shuffle_partitions(df.sparkSession)
    ids = df.select(order).where(F.col(order).isNotNull())
    drawn = sorted({r[0] for r in ids.orderBy(F.xxhash64(order)).limit(LOOKED_AT * wanted).collect()})
    ends = drawn[LOOKED_AT // 2 :: max(1, len(drawn) // wanted)]
    if not ends:
        return F.when(F.col(order).isNotNull(), F.lit(0))

    @F.pandas_udf("long")
    def number(column: pd.Series) -> pd.Series:
        filled = column.notna().to_numpy()
        values = column[filled].tolist()
        numeric = bool(values) and isinstance(values[0], (int, float))
        found = iter(np.searchsorted(ends, values, side="right").tolist() if numeric else [bisect_right(ends, v) for v in values])
        return pd.Series([next(found) if f else None for f in filled.tolist()], dtype="Int64")

    return number(F.col(order))


def positioned(df: DataFrame, size: Column, by: str, order: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `before`, the sum of size over the earlier rows of its group, and what that sum is where its span begins and ends (`_from`, `_until`).

    A group is summed span by span of its ids and then within spans, so that one that holds most rows is dealt over
    tasks. The sum before a span travels as the span's first row, so that rows are shuffled once and lie by group and span then."""
    rows = df.withColumn("_size", size).withColumn("_span", spans(df, order))
    earlier = W.partitionBy(by).orderBy(F.asc_nulls_last("_span")).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(by, "_span").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("_sum"))
    firsts = sums.withColumn("_from", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    firsts = firsts.select(by, "_span", F.col("_from").alias("_size"), "_from", (F.col("_from") + F.col("_sum")).alias("_until"))
    here = W.partitionBy(by, "_span").orderBy(F.asc_nulls_last("_until"), order, *ties).rowsBetween(W.unboundedPreceding, -1)
    both = rows.unionByName(firsts, allowMissingColumns=True)
    summed = both.select(*df.columns, "_span", F.col("_until").alias("_first"), F.sum("_size").over(here).alias("before"), F.max("_from").over(here).alias("_from"), F.max("_until").over(here).alias("_until"))
    return summed.where(F.col("_first").isNull()).drop("_first")


def running(df: DataFrame, size: Column, by: str, order: str = "doc_id") -> DataFrame:
    """df with `before`: the sum of size over the earlier rows of its group.

    Null is a group like any other; rows with a null id come last in their group."""
    return positioned(df, size, by, order).drop("_span", "_from", "_until")


def placed(rows: DataFrame, key: str) -> DataFrame:
    """(i, key) of rows that were sorted and written by range partitions (_p), i being the place from 0; no task sees more than its partition."""
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    bases = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = rows.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(key)) - 1)
    return local.join(F.broadcast(bases), "_p").select((F.col("_base") + F.col("_k")).cast("long").alias("i"), key)


def budget_prefix(df: DataFrame, size: Column, budget: int, by: str, order: str = "doc_id") -> DataFrame:
    """Rows of each group until the running size reaches the budget, the crossing row included."""
    return running(df, size, by, order).where(F.col("before") < budget).drop("before")


#: Levels of files are broadcast up to so many.
LEVELS_BROADCAST = 250_000


def file_quotas(df: DataFrame, size: Column, quotas: dict[str, int], by: str = "source", file: str = "file", order: str = "doc_id", max_docs: int = 0, pass_on: bool = False) -> DataFrame:
    """Rows of each source within its quota, which is divided over its files; then the first max_docs of a source, if given.

    Each file gives rows in their order until their running size reaches its level, the crossing row included. The level
    is an equal share of the quota and 1 at least; with pass_on, what files shorter than their share leave is shared by the
    others, so that levels rise until the quota is spent or all files are taken. max_docs counts in the order of (file, order).
    Sources without a quota and null sources give nothing; null is a file like any other, and the last one. Rows that share an
    id within a file are told apart by nothing.

    Only sums of files meet in one task, one for each source; rows are summed span by span."""
    if not quotas:
        return df.limit(0)
    names, quota = df.columns, F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("_place.s"))
    rows = df.where(F.col(by).isin(*quotas)).withColumn("_place", F.struct(F.col(by).alias("s"), F.col(file).alias("f"))).withColumn("_chars", size)
    files = rows.groupBy("_place").agg(F.sum("_chars").alias("_total")).withColumn("_quota", quota)
    of_source = W.partitionBy("_place.s")
    if pass_on:
        rising = of_source.orderBy("_total", F.asc_nulls_last("_place.f"))
        spent = F.coalesce(F.sum("_total").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        left = F.count("*").over(of_source) - F.row_number().over(rising) + 1
        shares = files.withColumn("_share", F.floor((F.col("_quota") - spent) / left))
        # a short file's share isn't used up; of the others the first in this order has the highest share
        level = F.max(F.when(F.col("_total") > F.col("_share"), F.greatest(F.col("_share"), F.lit(1)))).over(of_source)
        levels = shares.select(F.col("_place").alias("_p"), F.coalesce(level, F.lit((1 << 63) - 1)).alias("_level"))
    else:
        share = F.floor(F.col("_quota") / F.count("*").over(of_source))
        levels = files.select(F.col("_place").alias("_p"), F.greatest(share, F.lit(1)).alias("_level"))
    levels = staged(levels, "levels")
    side = F.broadcast(levels) if levels.count() <= LEVELS_BROADCAST else levels
    kept = running(rows, F.col("_chars"), "_place", order).join(side, F.col("_place").eqNullSafe(F.col("_p"))).where(F.col("before") < F.col("_level")).drop("before", "_p", "_level", "_chars")
    if max_docs:
        earlier = W.partitionBy("_place.s").orderBy(F.asc_nulls_last("_place.f")).rowsBetween(W.unboundedPreceding, -1)
        counts = kept.groupBy("_place").agg(F.count("*").alias("_n"))
        counts = staged(counts.select(F.col("_place").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")), "counts")
        side = F.broadcast(counts) if counts.count() <= LEVELS_BROADCAST else counts
        ranked = running(kept, F.lit(1), "_place", order).join(side, F.col("_place").eqNullSafe(F.col("_p")))
        kept = ranked.where(F.col("_base") + F.col("before") < max_docs)
    return kept.select(*names)


def stride_sample(df: DataFrame, offset: int, by: str, stride: int = 7, order: str = "doc_id") -> DataFrame:
    """Every stride-th row of each group, from an offset; two offsets give disjoint samples."""
    return running(df, F.lit(1), by, order).where(F.col("before") % stride == offset).drop("before")


def hash_split(df: DataFrame, key: Column, share: float, seed: str = "val") -> DataFrame:
    return df.withColumn("is_val", T.bucket_of(key, seed) < int(share * 10_000))


#: Bins of a hash; only the one in which a limit falls is put in order.
HASH_BINS = 1 << 16


def first_by_hash(df: DataFrame, key: str, limits: dict | int, seed: str, by: str | None = None) -> DataFrame:
    """The first rows by a hash of the key: so many of all (a number), or of each group of `by` named in limits; ties by key.

    The rows of each bin of hashes are counted, which gives each group the bin in which its limit falls. Rows of earlier
    bins are taken where they are; only that bin's are numbered, so that no task sorts or holds what is taken."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)))
    group = F.lit("") if by is None else F.col(by)
    rows = df.withColumn("_bin", F.coalesce(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(-1))).withColumn("_group", group)
    caps = {"": limits} if by is None else limits
    if not caps:
        return df.limit(0)
    listed = rows if by is None else rows.where(F.col("_group").isin(*caps))
    counts: dict = {}
    for r in listed.groupBy("_group", "_bin").agg(F.count("*").alias("n")).collect():  # at most HASH_BINS rows for each group that is named
        counts.setdefault(r["_group"], []).append((r["_bin"], r["n"]))
    whole, part = F.lit(False), F.lit(False)
    room = F.lit(None).cast("long")
    for name, cap in caps.items():
        before, cut = 0, HASH_BINS
        for bin_, n in sorted(counts.get(name, [])):
            if before + n > cap:
                cut = bin_
                break
            before += n
        mine = F.col("_group") == F.lit(name)
        whole |= mine & (F.col("_bin") < cut)
        part |= mine & (F.col("_bin") == cut)
        room = F.when(mine, F.lit(cap - before)).otherwise(room)
    order = [F.asc_nulls_first(digest), F.asc_nulls_first(key)]
    edge = listed.where(part).withColumn("_r", F.row_number().over(W.partitionBy("_group").orderBy(*order))).where(F.col("_r") <= room).drop("_r")
    return listed.where(whole).unionByName(edge).drop("_bin", "_group")


def cap_per_group(df: DataFrame, by: list[str], cap: Column | int, seed: str = "cap", key: str = "doc_id") -> DataFrame:
    """At most cap rows of each group, in the order of a hash of the key.

    Each of some parts of a group gives up what is beyond the cap, so that no task sorts a whole large group."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    order = [F.asc_nulls_last(F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)))), F.asc_nulls_last(key)]
    part = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(shuffle_partitions(df.sparkSession)))
    local = df.withColumn("_part", part).withColumn("_r", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))).where(F.col("_r") <= cap)
    return local.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= cap).drop("_r", "_part")


def sampled_with_weights(groups: DataFrame, weight: Column, draws: DataFrame, name: str, seed: int, step: str = "step") -> DataFrame:
    """draws with the group that each takes: a pure function of (seed, step, draw), with a chance by weight.

    groups are few (a mixture's sources); each has a range of the cumulated weights, in which a hash of the draw falls."""
    weighed = groups.select(F.col(name).alias("_g"), weight.cast("double").alias("_w"))
    upto = W.orderBy("_g").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranges = weighed.withColumn("_hi", F.sum("_w").over(upto)).withColumn("_all", F.sum("_w").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    ranges = ranges.select("_g", ((F.col("_hi") - F.col("_w")) / F.col("_all")).alias("_lo"), (F.col("_hi") / F.col("_all")).alias("_hi"))
    u = T.bucket_of(F.concat_ws(":", F.col(step), F.col("draw")), f"sample{seed}", 1_000_000) / 1_000_000.0
    hit = (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))
    return draws.withColumn("_u", u).join(F.broadcast(ranges), hit).withColumnRenamed("_g", name).drop("_u", "_lo", "_hi")


def pack_stream(df: DataFrame, width: int, end: Column, by: str = "source", order: str = "doc_id", ids: str = "ids", largest: int = 65_535, joint: str | None = None) -> DataFrame:
    """Fixed windows of each group's concatenated ids with an end id after every document; the tail is dropped.

    Each document's array is cut where windows begin, so that a row travels for each piece and not for each id. Documents
    are shuffled once, by group and span of their order: windows within a span are put together where it lies, and only
    pieces of windows that cross its ends travel again. Ids that are strings travel joined by `joint`, which none of them may
    hold; one that does fails the job, as do numbers above `largest`, which don't fit the packed files."""
    whole = F.concat(F.col(ids), F.array(end))
    if df.schema[ids].dataType.elementType.typeName() in ("integer", "long", "short", "byte"):
        whole = F.when(F.array_max(whole) > largest, F.raise_error(F.lit(f"a token id is above {largest}"))).otherwise(whole)
    rows = df.select(by, order, whole.alias("_ids")).withColumn("_n", F.when(F.col("_ids").isNotNull(), F.size("_ids")).cast("long"))
    if joint is not None:
        rows = rows.withColumn("_ids", F.array_join("_ids", joint))
    # rows of one id are put in order by what they hold, so that both readings below agree
    rows = positioned(rows, F.col("_n"), by, order, ("_n", "_ids"))

    def cut(some: DataFrame) -> DataFrame:
        """(group, span, window, where it begins, ids) of each piece."""
        if joint is not None:
            wrong = F.raise_error(F.lit(f"an id is null or holds {joint!r}"))
            some = some.withColumn("_ids", T.let(F.split("_ids", re.escape(joint)), lambda a: F.when(F.size(a) != F.col("_n"), wrong).otherwise(a)))
        first, last = F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("_n") - 1) / width)
        pieces = some.withColumn("window_id", F.explode(F.sequence(first, last)))
        start = F.greatest(F.col("window_id") * width - F.col("before"), F.lit(0))
        stop = F.least((F.col("window_id") + 1) * width - F.col("before"), F.col("_n"))
        piece = F.slice("_ids", (start + 1).cast("int"), (stop - start).cast("int"))
        return pieces.select(by, "_span", "window_id", "_from", "_until", (F.col("before") + start).alias("_pos"), (stop - start).alias("_n"), (piece if joint is None else F.array_join(piece, joint)).alias("_piece"))

    def together(pieces: DataFrame, *keys: str) -> DataFrame:
        made = pieces.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_pos", "_piece"))).alias("_pieces"))
        parts = F.transform("_pieces", lambda s: s["_piece"])
        return made.where(F.col("_n") == width).select(by, "window_id", (F.flatten(parts) if joint is None else F.split(F.array_join(parts, joint), re.escape(joint))).alias("ids"))

    inside = (F.col("window_id") * width >= F.col("_from")) & ((F.col("window_id") + 1) * width <= F.col("_until"))
    # the windows in which a span begins and ends, if they aren't wholly in it
    at_ends = (F.floor(F.col("before") / width) * width < F.col("_from")) | (F.floor((F.col("before") + F.col("_n") - 1) / width + 1) * width > F.col("_until"))
    return together(cut(rows).where(inside), by, "_span", "window_id").unionByName(together(cut(rows.where(at_ends)).where(~inside), by, "window_id"))


def route(windows: DataFrame, every: int = 100) -> DataFrame:
    """Window 0 and every so many after it go to validation."""
    return windows.withColumn("split", F.when(F.col("window_id") % every == 0, "val").otherwise("train"))
