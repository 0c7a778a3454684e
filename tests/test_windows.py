"""Packed windows: put together from spans as from one stream, and shuffled once."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from graintide.operators import sample
from graintide.plans import catalog


def shuffled(spark, df):
    """Bytes that writing df shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def cut(docs, width, end):
    """{(group, window): ids} by a plain loop; null ids give nothing."""
    streams = {}
    for _, source, ids in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, len(d[2] or ()), " ".join(map(str, d[2] or ())))):
        streams.setdefault(source, []).extend([] if ids is None else [*ids, end])
    return {(s, k): x[width * k : width * k + width] for s, x in streams.items() for k in range(len(x) // width)}


def test_query_shuffles_texts_once(spark, tmp_path):
    rng = random.Random(2)
    docs = [(k, "b" if k % 7 == 0 else "a", [f"{rng.getrandbits(32):08x}" for _ in range(rng.randrange(400))]) for k in range(2000)]
    spark.createDataFrame([(k, s, " ".join(w)) for k, s, w in docs], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.QUERIES["pack_windows_words"](spark, str(tmp_path))
    assert shuffled(spark, made) < 1.5 * sum(9 * len(w) for _, _, w in docs)
    want = {(s, k, hashlib.md5(" ".join(ids).encode()).hexdigest()) for (s, k), ids in cut(docs, 256, "</s>").items()}
    assert {(r["source"], r["window_id"], r["ids_md5"]) for r in made.collect()} == want


def test_numbers_are_shuffled_once(spark):
    rng = random.Random(6)
    docs = [(k, "a", [rng.randrange(65_536) for _ in range(rng.randrange(400))]) for k in range(1500)]
    made = sample.pack_stream(spark.createDataFrame(docs, "doc_id long, source string, ids array<int>"), 64, F.lit(0))
    assert shuffled(spark, made) < 1.5 * sum(4 * len(ids) for _, _, ids in docs)
    assert {(r["source"], r["window_id"]): r["ids"] for r in made.collect()} == cut(docs, 64, 0)


@pytest.mark.parametrize("width,joint", [(1, " "), (7, None), (7, "."), (7, "\\E|"), (500, " ")])
def test_windows_within_and_across_spans(spark, joint, width):
    rng = random.Random(width)
    word = lambda: rng.choice(["x", "yy", "é", "", "zzz"])
    docs = [(rng.choice([k, k, 3, 90, None]), rng.choice(["a", "a", "a", "b", None]), rng.choice([None, [], [word()], [word() for _ in range(rng.randrange(60))]])) for k in range(300)]
    made = sample.pack_stream(spark.createDataFrame(docs, "doc_id long, source string, ids array<string>").repartition(3), width, F.lit("</s>"), joint=joint)
    got = {(r["source"], r["window_id"]): r["ids"] for r in made.collect()}
    want = cut(docs, width, "</s>")
    assert got.keys() == want.keys() and len(got) == made.count()
    # rows of one id may come in any order of theirs, so that only their windows as a whole are told
    for s in ("a", "b", None):
        assert sorted(i for k, ids in got.items() if k[0] == s for i in ids if width == 1) == sorted(i for k, ids in want.items() if k[0] == s for i in ids if width == 1)
    alone = [d for d in docs if d[0] not in (3, 90, None)]
    made = sample.pack_stream(spark.createDataFrame(alone, "doc_id long, source string, ids array<string>").repartition(3), width, F.lit("</s>"), joint=joint)
    assert {(r["source"], r["window_id"]): r["ids"] for r in made.collect()} == cut(alone, width, "</s>")


@pytest.mark.parametrize("ids", [["a", "b c"], ["a", None]])
def test_ids_that_hold_what_joins_them_fail(spark, ids):
    docs = spark.createDataFrame([(1, "a", ids)], "doc_id long, source string, ids array<string>")
    with pytest.raises(Exception, match="an id is null or holds"):
        sample.pack_stream(docs, 1, F.lit("</s>"), joint=" ").collect()
