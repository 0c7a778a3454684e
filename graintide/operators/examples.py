"""Training examples from conversations: rendering, encoding with a loss mask, limits of length, padding and mixtures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graintide.functions import text as T
from graintide.operators import sample
from graintide.session import small_batches, staged

#: Marks of a rendered conversation and the label of what isn't trained.
BEGIN, END, ROLES = "<|bos|>", "<|eos|>", {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>", "tool": ""}
UNTRAINED = -100
#: An encoder gives the ids of a text and where in it each begins.
Encoder = Callable[[str], tuple[list[int], list[int]]]


def fault(turns: Column) -> Column:
    """Why a conversation can't be rendered; empty where it can."""
    last = F.get(turns, F.size(turns) - 1)
    return (
        F.when(~F.exists(turns, lambda t: t["role"] == "assistant"), "no assistant turn")
        .when((last["role"] != "assistant") | ~last["trained"], "doesn't end with a trained assistant turn")
        .when(F.exists(turns, lambda t: ~F.coalesce(t["role"].isin(*ROLES), F.lit(False))), "unknown role")
        .otherwise(""))


def render(turns: Column) -> Column:
    """struct(text, spans): the turns one after another between marks, and the spans (start, end) of trained assistant texts.

    A trained last turn's span holds the mark of the end; a conversation with a fault is null."""
    mark = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    start = F.struct(F.lit(BEGIN).alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(1).alias("k"))

    def add(acc: Column, t: Column) -> Column:
        assistant = t["role"] == "assistant"
        head = F.concat(acc["text"], F.element_at(mark, t["role"]))
        body = F.when(assistant & (acc["k"] == F.size(turns)), F.concat(t["text"], F.lit(END))).otherwise(t["text"])
        span = F.struct(F.length(head).alias("start"), (F.length(head) + F.length(body)).alias("end"))
        spans = F.when(assistant & t["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(F.concat(head, body).alias("text"), spans.alias("spans"), (acc["k"] + 1).alias("k"))

    done = lambda acc: F.struct(acc["text"].alias("text"), acc["spans"].alias("spans"))
    return F.when(fault(turns) == "", F.aggregate(turns, start, add, done))


def prompt(system: Column, user: Column) -> Column:
    """What a model is asked to continue."""
    return F.concat(F.lit(BEGIN), F.lit(ROLES["system"]), system, F.lit(ROLES["user"]), user, F.lit(ROLES["assistant"]))


def asked(schema: Column, question: Column) -> Column:
    return F.concat(F.lit("<|schema|>\n"), F.trim(schema), F.lit("\n<|/schema|>\n"), F.trim(question))


def file_encoder(path: str) -> Encoder:
    """The encoder of a tokenizers file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(text: str) -> tuple[list[int], list[int]]:
        made = tokenizer.encode(text, add_special_tokens=False)
        return made.ids, [a for a, _ in made.offsets]

    return encode


def encoded(text: Column, make: Callable[[], Encoder]) -> Column:
    """struct(ids, starts) of a text; the encoder is made once in each task."""

    @F.pandas_udf("ids array<int>, starts array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = make()
        for texts in batches:
            # numbers of four bytes as soon as a text is encoded: as Python's they take ten times as much
            rows = [tuple(np.asarray(part, dtype="int32") for part in encode(t or "")) for t in texts]
            yield pd.DataFrame({"ids": [r[0] for r in rows], "starts": [r[1] for r in rows]})

    return run(text)


def token_mask(starts: Column, spans: Column) -> Column:
    """1 for each token that begins within a trained span."""
    return F.transform(starts, lambda at: F.exists(spans, lambda s: (at >= s["start"]) & (at < s["end"])).cast("int"))


def encode_examples(conversations: DataFrame, make: Callable[[], Encoder], max_len: int, turns: str = "turns") -> DataFrame:
    """conversations with ids and mask; what has a fault, is longer than max_len or has nothing trained goes."""
    small_batches(conversations.sparkSession)
    made = conversations.withColumn("_r", render(F.col(turns))).where("_r is not null")
    made = made.withColumn("_e", encoded(F.col("_r.text"), make))
    made = made.withColumn("ids", F.col("_e.ids")).withColumn("mask", token_mask(F.col("_e.starts"), F.col("_r.spans"))).drop("_r", "_e")
    return made.where((F.size("ids") <= max_len) & F.array_contains("mask", 1))


def collated(examples: DataFrame, by: str, pad: int) -> DataFrame:
    """examples of each batch padded to its longest: ids, attention and labels, untrained and padded places masked."""
    width = examples.groupBy(F.col(by).alias("_b")).agg(F.max(F.size("ids")).alias("_w"))
    rows = examples.join(width, F.col(by).eqNullSafe(F.col("_b"))).drop("_b")
    fill = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), F.col("_w") - F.size(x)))
    labels = F.zip_with("ids", "mask", lambda i, m: F.when(m == 1, i).otherwise(UNTRAINED))
    attention = F.transform("ids", lambda _: F.lit(1))
    return rows.select(
        *(c for c in examples.columns if c not in ("ids", "mask")), fill(F.col("ids"), pad).alias("input_ids"), fill(attention, 0).alias("attention_mask"), fill(labels, UNTRAINED).alias("labels"))


def mixture(sources: dict[str, tuple[DataFrame, int]], key: str, seed: str = "mix") -> DataFrame:
    """Of each source its cap of rows, in the order of a hash, with the source's name."""
    parts = [sample.first_by_hash(df.withColumn("source", F.lit(name)), key, cap, seed) for name, (df, cap) in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Every row so many times, with `epoch` from 0; none for 0."""
    return df.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))


def cap_by_source(df: DataFrame, caps: dict[str, int], key: str, seed: str = "cap") -> DataFrame:
    """At most its cap of each source's rows by a hash; a source that isn't listed has none."""
    return sample.first_by_hash(df, key, caps, seed, "source")


def quota_cascade(df: DataFrame, key: str, steps: list[tuple[str, Column, int]], schema: str, seed: str = "cascade") -> DataFrame:
    """Rows with `kind`: in the order of a hash each takes the first step that it is able for and that has room left.

    Only the first row of a schema takes a step after the first. A step's rows are those able for it that no step
    before took, so that the cascade is one selection for each step; its choice of keys is written for the next one."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)))
    rows, done = df, None
    for n, (kind, able, quota) in enumerate(steps):
        if n == 1:
            firsts = rows.where(F.col(schema).isNotNull()).groupBy(F.col(schema).alias("_s")).agg(F.min(F.struct(digest.alias("h"), F.col(key).alias("k"))).alias("_first"))
            rows = rows.join(firsts, (F.col(schema) == F.col("_s")) & (F.col(key) == F.col("_first.k")), "left_semi")
        taken = sample.first_by_hash(rows.where(able), key, quota, seed).withColumn("kind", F.lit(kind))
        done = taken if done is None else done.unionByName(taken)
        if n + 1 < len(steps):
            chosen = staged(taken.select(F.col(key).alias("_k")), "chosen")
            rows = rows.join(chosen, F.col(key) == F.col("_k"), "left_anti")
    return done


def code_of(text: Column) -> Column:
    """struct(code, warning): the first closed block, else what stands before a closing mark, said to be found leniently."""
    lenient = F.trim(F.regexp_replace(F.substring_index(text, "<|/python|>", 1), r"<\|(?:think|python)\|>", ""))
    strict = F.regexp_extract(text, r"(?s)<\|python\|>(.*?)<\|/python\|>", 1)
    closed, marked = text.rlike(r"(?s)<\|python\|>.*?<\|/python\|>"), text.contains("<|/python|>")
    note = "model did not open the code block with <|python|>; code recovered leniently"
    return F.struct(F.when(closed, F.regexp_replace(strict, r"^\s+|\s+$", "")).when(marked, F.nullif(lenient, F.lit(""))).alias("code"), F.when(~closed & marked, note).alias("warning"))


def split_by(key: Column, share: float, seed: str = "val") -> Column:
    return T.bucket_of(key, seed) < int(share * 10_000)
