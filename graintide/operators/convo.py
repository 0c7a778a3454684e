"""Conversation ETL: validity, neutralising, rendering with trained spans, masks. One row per conversation or message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graintide.functions import quality as Q
from graintide.functions import text as T
from graintide.operators import sample

#: The walk over the sizes is broadcast where max_tokens, which bounds its rows, is at most this.
WALK_BROADCAST = 1_000_000


def turns_of(messages: DataFrame) -> DataFrame:
    """(conv_id, turns): turns in order; trained defaults to true."""
    trained = F.coalesce("trained", F.lit(True)) if "trained" in messages.columns else F.lit(True)
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"), trained.alias("trained"))
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def drop_reason(turns: Column) -> Column:
    """Empty where the conversation has an optional system turn, then strict alternation that ends with the assistant."""
    roles = F.array_join(F.transform(turns, lambda t: t["role"]), ",")
    return (
        F.when(F.exists(turns, lambda t: F.trim(t["text"]) == ""), "empty_turn")
        .when(roles.rlike("user$"), "ends_with_user")
        .when(~roles.rlike("^(system,)?user,assistant(,user,assistant)*$"), "bad_order")
        .when(F.exists(turns, lambda t: ~Q.mostly_ascii(t["text"])), "not_ascii")
        .otherwise(""))


def render(turns: Column) -> Column:
    """(text, spans): turns one after another, and the character spans (start, end) of trained assistant texts."""
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        head = F.concat(acc["text"], F.lit("<|"), t["role"], F.lit("|>\n"))
        body = T.neutralise_specials(t["text"])
        span = F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end"))
        mine = t["trained"] & (t["role"] == "assistant")
        return F.struct(F.concat(head, body, F.lit("<|end|>\n")).alias("text"), F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, add)


def token_batches(df: DataFrame, size: str, key: str, max_tokens: int, by: str | None = None) -> DataFrame:
    """df with `batch_id`: rows in the order of (size, key) fill a batch while its longest size times its count fits max_tokens.

    The greedy cut follows from how many rows have each size: a batch open at a size takes rows of it up to
    max_tokens // size in all, and what is left fills whole batches. So the histogram is walked, which has at most
    max_tokens + 2 rows, and a row's batch is its rank among rows of its size put into that walk; no task sorts or holds
    the rows. With `by`, each of its groups (null is one) is batched on its own.

    Null sizes and such below 0 count as 0; rows of size 0 fit any batch. A row above max_tokens is a batch of its own, and
    these are numbered in the order of the key. Rows with a null key come last among their size. Equal rows are told apart
    by nothing, so that which of them is where isn't settled, but how many are. Columns of any name are carried through,
    but `batch_id` is replaced."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be 1 at least")
    names = [c for c in df.columns if c != "batch_id"]
    inner = {c: f"c{k}" for k, c in enumerate(names)}
    rows = df.select(*names).toDF(*inner.values())
    length = F.least(F.greatest(F.coalesce(F.col(inner[size]).cast("long"), F.lit(0)), F.lit(0)), F.lit(max_tokens + 1))
    group = F.lit("") if by is None else F.col(inner[by])
    rows = rows.withColumn("run", F.struct(group.alias("g"), length.alias("n")))
    histogram = rows.groupBy("run").agg(F.count("*").alias("k")).select(F.col("run.g").alias("g"), F.col("run.n").alias("n"), "k")

    def walk(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("n")
        batch, filled, starts = 0, 0, []
        for n, k in zip(sizes["n"].tolist(), sizes["k"].tolist(), strict=True):
            fits = max(1, max_tokens // n) if n else filled + k
            here = max(0, min(k, fits - filled))
            starts.append((batch, fits, here))
            if k > here:
                more, last = divmod(k - here - 1, fits)
                batch, filled = batch + 1 + more, last + 1
            else:
                filled += k
        return sizes.assign(open_=[s[0] for s in starts], fits=[s[1] for s in starts], here=[s[2] for s in starts]).drop(columns="k")

    kind = histogram.schema["g"].dataType.simpleString()
    walked = histogram.groupBy("g").applyInPandas(walk, f"g {kind}, n long, open_ long, fits long, here long")
    if by is None and max_tokens <= WALK_BROADCAST:
        walked = F.broadcast(walked)
    ranked = sample.running(rows, F.lit(1), "run", inner[key])
    joined = ranked.join(walked, F.col("run.g").eqNullSafe(F.col("g")) & (F.col("run.n") == F.col("n")))
    later = F.col("before") - F.col("here")
    batch_id = F.when(later < 0, F.col("open_")).otherwise(F.col("open_") + 1 + F.floor(later / F.col("fits")))
    return joined.select(*inner.values(), batch_id.cast("long").alias("batch_id")).toDF(*names, "batch_id")
