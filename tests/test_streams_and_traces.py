"""Streams with state against their batch form over restarts; traces against each statement run by itself."""

import random

import pytest
from pyspark.sql import functions as F

from graintide.operators import sqlcheck, traces
from graintide.streaming import stateful

SCHEMA = "doc_id long, source string, text string, ids array<int>"


def fed(spark, tmp_path, batches, make):
    """Results of a stream that is started anew for each batch, and once more without any."""
    spark.conf.set("spark.sql.shuffle.partitions", 2)  # a state store and a worker for each
    for k, batch in enumerate([*batches, []]):
        if batch:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(40)
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.fixture
def batches():
    rng = random.Random(7)
    rows = [(k, "hot" if k % 3 else "b", rng.choice(["same text"] * 3 + [f"t{rng.randrange(20)}"]), [rng.randrange(100) for _ in range(rng.randint(0, 9))]) for k in range(120)]
    return [sorted(rows[a:b], key=lambda r: rng.random()) for a, b in ((0, 50), (50, 51), (51, 120))]


def test_first_writers_hold_over_batches(spark, tmp_path, batches):
    got = fed(spark, tmp_path, [[*b, (None, "x", "no id", None)] for b in batches], lambda d: stateful.first_writers(d, F.md5("text"), salts=4))
    first = {}
    for batch in batches:
        for k, _, text, _ in sorted(batch):
            first.setdefault(text, k)
    assert sorted(r["doc_id"] for r in got) == sorted(first.values())


def test_packing_carries_what_is_left_over(spark, tmp_path, batches):
    got = fed(spark, tmp_path, batches, lambda d: stateful.packed_windows(d, 8, 999, shards=2))
    shard = {r["doc_id"]: r["s"] for r in spark.createDataFrame([r for b in batches for r in b], SCHEMA).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("s")).collect()}
    streams = {}
    for batch in batches:
        for k, source, _, ids in sorted(batch):
            streams.setdefault((source, shard[k]), []).extend([*ids, 999])
    expected = sorted((*key, n, x[8 * n : 8 * n + 8]) for key, x in streams.items() for n in range(len(x) // 8))
    assert sorted((r["source"], r["shard"], r["window_id"], r["ids"]) for r in got) == expected and len(streams) == 4


def test_repeats_are_counted_over_batches(spark, tmp_path, batches):
    got = fed(spark, tmp_path, batches, lambda d: stateful.capped_repeats(d, F.col("text"), 3, groups=4))
    seen, expected = {}, []
    for batch in batches:
        for k, _, text, _ in sorted(batch):
            if seen.get(text, 0) < 3:
                expected.append((text, k, seen.get(text, 0)))
                seen[text] = seen.get(text, 0) + 1
    assert sorted((r["value"], r["doc_id"], r["nth"]) for r in got) == sorted(expected)


@pytest.fixture
def shop(spark):
    rows = [(k, "abc"[k % 3], None if k % 11 == 0 else k * 1.25 + 0.005, 10 ** (k % 9)) for k in range(60)]
    spark.createDataFrame(rows, "id long, kind string, price double, size long").createOrReplaceTempView("shop")


CASES = [
    traces.Template("prices", "d", ("Prices of {kind}?", "{kind}: prices?"), "SELECT id, price FROM shop WHERE kind = '{kind}' AND id > {low}", ("price DESC", "id"), "n", {"kind": traces.Values(table="shop", column="kind"), "low": traces.Values(among=(-1, 40)), "n": traces.Values(among=(1, 4, 500))}),
    traces.Template("kinds", "d", ("Which kinds?",), "SELECT DISTINCT kind FROM shop", ("kind DESC",), None, {}),
    traces.Template("large", "d", ("How large?",), "SELECT kind, sum(size) / 7 AS mean FROM shop WHERE id < {n} GROUP BY kind", ("kind",), None, {"n": traces.Values(among=(1, 20, 60))}),
    traces.Template("nothing", "d", ("Nothing?",), "SELECT id FROM shop WHERE id < {n}", ("id",), None, {"n": traces.Values(among=(-5,))}),
    traces.Template("nulls", "d", ("Nulls?",), "SELECT max(price) AS p FROM shop WHERE price IS NULL AND id >= {n}", (), None, {"n": traces.Values(among=(0,))}),
]


def test_traces_equal_each_statement_run_alone(spark, shop):
    made = traces.template_traces(spark, CASES, spark.range(12).withColumnRenamed("id", "seed"), "CREATE TABLE shop (id INT);", "You answer.", repeats=5)
    rows = made.collect()
    counts = {}
    for r in rows:
        counts[r["question"], r["sql"]] = counts.get((r["question"], r["sql"]), 0) + 1
        alone = sqlcheck.run_query(spark, r["sql"])
        assert alone["ok"] and r["n"] == len(alone["rows"]) > 0
        plain = lambda v: "NULL" if v is None else str(v) if not isinstance(v, float) else f"{v:.6g}"
        head, *lines = r["shown"].split("\n")
        assert head == " | ".join(alone["columns"])
        for line, row in zip(lines, alone["rows"][:10], strict=False):
            for cell, v in zip(line.split(" | "), row, strict=True):
                assert cell == plain(v) or abs(float(cell) - v) <= 5.1e-6 * abs(v)
        assert (len(lines) == 11 and lines[-1] == f"({r['n'] - 10} more rows)") if r["n"] > 10 else len(lines) == r["n"]
        assert sqlcheck.insight(alone["columns"], alone["rows"][:10], len(alone["rows"])).split(" (")[0] == r["said"].split(" (")[0]
        assert [t["role"] for t in r["turns"]] == ["system", "user", "assistant", "tool", "assistant"] and r["sql"] in r["turns"][2]["text"]
    assert {r["template"] for r in rows} == {"prices", "kinds", "large", "nulls"} and max(counts.values()) == 5
    assert {("<|think|>" in r["turns"][2]["text"]) for r in rows} == {True, False}


def test_repairs_show_a_real_fault_first(spark, shop):
    made = traces.template_traces(spark, CASES[:3], spark.range(6).withColumnRenamed("id", "seed"), "CREATE TABLE shop (id INT);")
    rows = traces.repair_traces(spark, CASES[:3], made).collect()
    assert {r["kind"] for r in rows} == {"column", "table", "syntax"}
    for r in rows:
        assert not sqlcheck.run_query(spark, r["broken"])["ok"] and sqlcheck.run_query(spark, r["sql"])["ok"]
        assert [t["trained"] for t in r["turns"]] == [True, True, False, True, True, True, True] and r["fault"] in r["turns"][3]["text"] and r["broken"] in r["turns"][2]["text"]


def test_judgements_equal_those_of_single_results(spark):
    rng = random.Random(2)
    cases, gold, candidates, status = range(40), [], [], {}
    for case in cases:
        right = [(rng.choice(["a", "b", None]), rng.randrange(9000) * 0.01 + 0.003) for _ in range(rng.randint(0, 4))]
        gold += [(case, *r) for r in right]
        for name in ("same", "rounded", "less", "other", "none"):
            rows = {"same": right[::-1], "rounded": [(a, round(b, 1)) for a, b in right], "less": right[1:], "other": [(a, b + 1) for a, b in right], "none": []}[name]
            candidates += [(case, name, *r) for r in rows]
            if rows and right:
                status[case, name] = sqlcheck.judge({"ok": True, "rows": rows}, {"ok": True, "rows": right})
    got = traces.judged_candidates(spark.createDataFrame(gold, "case_id long, c0 string, c1 double"), spark.createDataFrame(candidates, "case_id long, candidate string, c0 string, c1 double"), spark.createDataFrame([(3, "bad")], "case_id long, candidate string"), ["case_id"])
    found = {(r["case_id"], r["candidate"]): r["status"] for r in got.collect()}
    assert found.pop((3, "bad")) == "error" and found == status and set(status.values()) == {"match", "match_rounding", "mismatch"}
