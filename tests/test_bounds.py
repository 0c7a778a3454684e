"""What workers hold at once, and steps whose cost must not grow beyond their input."""

import time

from pyspark.sql import functions as F

from graintide.operators import measure, sqltext
from graintide.session import dealt


def test_fertility_tokenises_bounded_runs(spark):
    def counting():
        """A tokenizer of characters that refuses more than 300,000 characters at once, but for one text."""
        from types import SimpleNamespace

        def encode_batch(texts, add_special_tokens):
            if len(texts) > 1 and sum(map(len, texts)) > 300_000:
                raise ValueError("too much at once")
            return [SimpleNamespace(ids=list(map(ord, t))) for t in texts]

        return SimpleNamespace(encode_batch=encode_batch, decode_batch=lambda ids, skip_special_tokens: ["".join(map(chr, i)) for i in ids])

    rows = [("a", "x" * 1000) for _ in range(2000)] + [("b", "y" * 400_000), ("b", None), ("c", "")]
    docs = spark.createDataFrame(rows, "source string, text string").coalesce(1)
    got = {r["source"]: (r["tokens"], r["failures"]) for r in measure.fertility(docs, counting).collect()}
    assert got == {"a": (2_000_000, 0), "b": (400_000, 0), "c": (0, 0)}


def test_wide_tables_are_cut_in_little_time(spark):
    """2,000 columns with and without nested brackets; character by character this takes minutes, and long statements overflow the stack."""
    plain = ", ".join(f"c{k} DECIMAL(10, {k})" for k in range(2000))
    nested = plain + ", d INT CHECK (f(a, g(1, 2)) > 0), \x1f e INT"
    began = time.time()
    made = spark.createDataFrame([(f"CREATE TABLE p ({plain}); CREATE TABLE n ({nested}); CREATE TABLE u (a INT, b) INT, c INT)",)], "s string")
    got = {t["table"]: [tuple(c) for c in t["columns"]] for t in made.select(sqltext.tables_of(F.col("s"))).first()[0]}
    assert time.time() - began < 60
    assert got["p"] == [(f"c{k}", f"decimal(10, {k})") for k in range(2000)]
    assert got["n"][2000] == ("d", "int check (f(a, g(1, 2)) > 0)") and len(got["n"]) == 2002
    assert got["u"] == [("a", "int"), ("b)", "int, c int")]


def test_few_row_groups_are_dealt(spark, tmp_path):
    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "rows"))
    sizes = dealt(spark.read.parquet(str(tmp_path / "rows"))).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 20_000


def test_least_values_equal_a_plain_count():
    from hashlib import md5

    from graintide.operators import dedup

    texts = ["", "one", "a b c d", "a b c d e", " ".join(f"w{k % 5001}" for k in range(9_000))]
    got = dedup._least_values(texts, 5, 7)
    assert got[0] is None
    for text, values in zip(texts[1:], got[1:]):
        w = text.split()
        grams = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        hashes = [int(md5(g.encode()).hexdigest()[:8], 16) for g in grams]
        assert values.tolist() == [min((h * a + b) % dedup.PRIME for h in hashes) for a, b in map(dedup.affine, range(1, 8))]
