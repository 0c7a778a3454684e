"""Operators whose plans must hold where groups, chains and sets are large: each against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graintide.functions import quality
from graintide.operators import bloom, dedup, sample


def greedy(cells):
    """Ids dropped: each goes if one that stays came before it in one of its cells."""
    by_id, owned, gone = {}, set(), set()
    for i, band, cell in cells:
        by_id.setdefault(i, set()).add((band, cell))
    for i in sorted(by_id):
        if owned & by_id[i]:
            gone.add(i)
        else:
            owned |= by_id[i]
    return gone


@pytest.mark.parametrize("limits", [{}, {"small": 3}])
def test_near_duplicates_keep_the_first_like_one_pass(spark, limits):
    rng = random.Random(4)
    cells = [(i, band, f"c{rng.randrange(60)}") for i in range(150) for band in range(3)] + [(1000 + i, 0, "hot") for i in range(300)] + [(7, 0, "c1"), (7, 0, "c1")]
    got = {r["id"] for r in dedup.keep_first(spark.createDataFrame(cells, "id long, band int, cell string"), **limits).collect()}
    assert got == greedy(cells)


def test_a_chain_of_versions_settles_in_few_tables(spark, monkeypatch):
    n, staged, made = 10_000, dedup.staged, []
    monkeypatch.setattr(dedup, "staged", lambda df, label: made.append(label) or staged(df, label))
    cells = spark.range(n).select("id", F.explode(F.array(F.struct(F.lit(0).alias("band"), (F.col("id") / 2).cast("long").alias("cell")), F.struct(F.lit(1).alias("band"), ((F.col("id") + 1) / 2).cast("long").alias("cell")))).alias("c")).select("id", "c.band", F.col("c.cell").cast("string").alias("cell"))
    gone = sorted(r["id"] for r in dedup.keep_first(cells).collect())
    assert gone == list(range(1, n, 2)) and len(made) < 15


@pytest.mark.parametrize("one_task", [10**6, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_by_trees_and_by_stars(spark, one_task, kind):
    rng = random.Random(9)
    name = (lambda k: k) if kind == "long" else (lambda k: f"n{k:04}")
    edges = [(k, k + 1) for k in range(200)] + [(500 + rng.randrange(100), 500 + rng.randrange(100)) for _ in range(60)] + [(900, 900 + k) for k in range(50)]
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = dedup.components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"earlier {kind}, later {kind}"), one_task)
    assert {tuple(r) for r in got.collect()} == {(name(x), name(c)) for x, c in up.items() if x != c}


def test_benchmark_grams_are_found_without_sending_texts(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(k, text(40)) for k in range(30)]
    docs = [(k, text(rng.randint(0, 200)) + (" " + bench[k % 30][1] + " " + text(5) if k % 10 == 0 else "")) for k in range(400)] + [(900, None), (901, "")]
    grams = dedup.benchmark_grams(spark.createDataFrame(bench, "item_id long, text string"), F.lit("set"), F.col("item_id"))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    known = {r["gram"] for r in grams.collect()}
    expected = {(k, i) for k, t in docs for w in [(t or "").split()] for i in range(len(w) - 12) if " ".join(w[i : i + 13]) in known}
    for limit in (dedup.BROADCAST_ROWS, 0):
        monkeypatch.setattr(dedup, "BROADCAST_ROWS", limit)
        got = dedup.gram_hits(table, grams)
        assert {(r["doc_id"], r["i"]) for r in got.collect()} == expected and len(expected) >= 40 * 28
    windows = sum(max(0, len((t or "").split()) - 12) for _, t in docs)
    keys = grams.select(F.get(bloom.run_keys(bloom.word_hashes(F.split("gram", " ")), 13), F.lit(0)).alias("key"))
    passed = table.select(F.size(bloom.bloom_of(spark, keys, len(known)).places(bloom.word_hashes(F.split("text", " ")), 13)).alias("n")).agg(F.sum(F.greatest("n", F.lit(0)))).first()[0]
    assert len(expected) <= passed <= len(expected) + 0.01 * windows


@pytest.mark.parametrize("text,clean", [
    ("icon  a whole paragraph,\nand another line  end", "icon  a whole paragraph,\nand another line  end"),
    ("a 8.8.8.8 b", "a 192.0.2.1 b"), ("8.8.4.4, 10.1.2.3 and 172.20.0.1; 172.32.0.1", "192.0.2.1, 10.1.2.3 and 172.20.0.1; 192.0.2.1"),
    ("x@y.org 1.2.3.4.5 999.1.1.1", "user@example.com 192.0.2.1.5 999.1.1.1"), ("", ""),
])
def test_redaction_leaves_all_else(spark, text, clean):
    out = quality.redact(F.lit(text))
    assert tuple(spark.range(1).select(out.alias("a"), quality.redact(out).alias("b")).first()) == (clean, clean)


@pytest.mark.parametrize("bins", [1 << 16, 4])
def test_first_rows_by_hash_are_those_of_one_order(spark, monkeypatch, bins):
    import hashlib

    rows = [(k, "abc"[k % 3] if k % 50 else None) for k in range(3000)] + [(7, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "id long, g string").repartition(6)
    order = lambda r: (hashlib.md5(f"{r[0]}:s".encode()).hexdigest(), r[0])
    for limit in (0, 1, 777, 5000):
        got = sample.first_by_hash(df, "id", limit, "s")
        assert sorted(map(order, got.collect())) == sorted(map(order, rows))[:limit]
    got = sample.first_by_hash(df, "id", {"a": 5, "b": 900, "d": 3, "c": 0}, "s", "g").collect()
    for name, cap in (("a", 5), ("b", 900), ("c", 0), ("d", 0)):
        assert sorted(order(r) for r in got if r["g"] == name) == sorted(order(r) for r in rows if r[1] == name)[:cap]
    assert sample.first_by_hash(df.limit(0), "id", 5, "s").count() == 0


@pytest.mark.parametrize("name", ["long", "string", "date", "decimal(12,2)"])
def test_running_sums_over_ids_of_any_type(spark, name):
    rng = random.Random(3)
    numbers = rng.sample(range(20_000), 2000) + [10_000_000 if name == "date" else 10**9]
    base = spark.createDataFrame([(k, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 5)) for k in numbers], "k long, g string, n long")
    key = {"string": F.format_string("doc-%012d", "k"), "date": F.date_add(F.lit("2000-01-01").cast("date"), (F.col("k") % 20_001).cast("int"))}.get(name, F.col("k").cast(name))
    rows = base.withColumn("id", key).dropDuplicates(["id"]).repartition(5).cache()
    expected, sums = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        expected[r["id"]] = sums.get(r["g"], 0)
        sums[r["g"]] = expected[r["id"]] + r["n"]
    assert {r["id"]: r["before"] for r in sample.running(rows, F.col("n"), "g", "id").collect()} == expected
    sizes = [r["count"] for r in rows.groupBy(sample.spans(rows, "id")).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 0.1 * rows.count()  # one id far away doesn't put the others into one span


def test_staged_tables_are_deleted(spark, tmp_path):
    from graintide import session

    session.release(spark)
    made = session.staged(spark.range(5), "x")
    assert made.count() == 5
    folder = f"{session.shared_dir(spark)}/graintide/run-{session._RUN}"
    assert session.exists(spark, folder)
    session.release(spark)
    assert not session.exists(spark, folder)
