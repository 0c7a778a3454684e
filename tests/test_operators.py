"""Small fixtures for the engine's own operators."""

import pytest
from pyspark.sql import functions as F

from graintide.functions import quality as Q
from graintide.functions import text as T
from graintide.operators import clean, convo, dedup, sample, sqlcheck
from graintide.sources import readers

LINE = "The quick brown fox number {} jumps over the lazy dog and keeps on running through fields"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_redaction_is_idempotent_and_keeps_private_addresses(spark):
    text = "mail a.b@c.example.org from 8.8.8.8 or 10.0.0.1, 192.168.1.2, 172.16.0.9, 127.0.0.1 and 01.2.3.4"
    got = one(spark, text, Q.redact)
    assert got.startswith("mail user@example.com from 192.0.2.1 or 10.0.0.1, 192.168.1.2, 172.16.0.9, 127.0.0.1")
    assert one(spark, got, Q.redact) == got


@pytest.mark.parametrize("text,secret", [("AKIA" + "A" * 16, True), ("ghp_" + "a" * 36, True), ("-----BEGIN RSA PRIVATE KEY", True), ("sk-" + "b" * 32, True), ("total = price * 2", False)])
def test_secrets(spark, text, secret):
    assert one(spark, text, Q.has_secret) is secret


def test_prose_reasons(spark):
    good = "\n".join(LINE.format(f"{k} {chr(97 + k)}{k * 7} word{k * 13} and item{k * k}") for k in range(14))
    rows = [(1, good), (2, "short"), (3, "\n".join(["one two three four one two three four and one two three four again"] * 40)), (4, None)]
    got = {r["doc_id"]: r["reason"] for r in clean.clean_prose(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "too_short", 3: "repetitive", 4: "empty_or_unfetched"}


def test_prose_report_counts_documents_with_addresses(spark, tmp_path):
    import ipaddress
    import re

    from graintide.plans import corpus

    good = "\n".join(LINE.format(f"{k} {chr(97 + k)}{k * 7} word{k * 13} and item{k * k}") for k in range(14))
    tails = ["", " at 8.8.8.8", " at 10.0.0.1 or 172.16.0.9", " at 192.168.100.200 or 151.101.193.140", " in version 4.10.22.137", " from a.b@c.example.org by 93.184.216.34"]
    rows = [(k, good + tail, "s") for k, tail in enumerate(tails)] + [(90, "at 8.8.8.8", "s"), (91, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))

    def public(m):
        return "192.0.2.1" if ipaddress.ip_address(m[0]).is_global else m[0]

    sizes = [len(re.sub(r"\b\d+\.\d+\.\d+\.\d+\b", public, re.sub(r"\S+@\S+", "user@example.com", good + tail))) for tail in tails]
    got = {r["reason"]: (r["n"], r["chars"]) for r in corpus.clean_prose_reasons(spark, str(tmp_path)).collect()}
    assert got == {"": (len(tails), sum(sizes)), "too_short": (1, 0), "empty_or_unfetched": (1, 0)}


def test_code_and_sql_chains(spark):
    code = "def f(a):\n    return a + 1\n\n\n" + "".join(f"value_{k} = f({k}) + {k * 3}\n" for k in range(30))
    rows = [(1, code), (2, code + "\ndef broken(:\n"), (3, "# auto-generated\n" + code), (4, "".join(f"# remark {k} on things\n" for k in range(60)) + "x = 1\n"), (5, "x = 1")]
    got = {r["doc_id"]: r["reason"] for r in clean.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), "code").collect()}
    assert got == {1: "", 2: "syntax_error", 3: "autogenerated", 4: "comment_heavy", 5: "too_short"}
    dump = "".join(f"INSERT INTO t VALUES ({k}, 'abc');\n" for k in range(80))
    query = "SELECT a.id, b.name FROM a JOIN b ON a.id = b.id WHERE a.total > 10;\n" * 5
    got = {r["doc_id"]: r["reason"] for r in clean.clean_documents(spark.createDataFrame([(1, dump), (2, query), (3, "nothing (like sql " * 20)], "doc_id long, text string"), "sql").collect()}
    assert got == {1: "data_dump", 2: "", 3: "parse_error"}
    with pytest.raises(ValueError):
        clean.clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), "other")


def test_ngrams_and_shingles(spark):
    row = spark.createDataFrame([(["a", "b"],)], "w array<string>").select(T.ngrams(F.col("w"), 3).alias("g"), T.shingles(F.col("w"), 5).alias("s")).first()
    assert row["g"] == [] and row["s"] == ["a b"]


def test_keep_first_isnt_components(spark):
    """A chain of any length: every second of it goes; what has one cell goes but for its first."""
    links = [(k, 0, f"c{k // 2}") for k in range(14)] + [(k, 1, f"d{(k + 1) // 2}") for k in range(14)]
    cells = spark.createDataFrame(links, "id long, band int, cell string")
    assert sorted(r["id"] for r in dedup.keep_first(cells).collect()) == [1, 3, 5, 7, 9, 11, 13]
    empty = dedup.lsh_cells(spark.createDataFrame([(k, "" if k % 2 else None) for k in range(400)] + [(None, "")], "doc_id long, text string"))
    assert dedup.lsh_edges(empty).count() == 399 and dedup.keep_first(empty).count() == 399
    assert dedup.keep_first(cells.limit(0)).count() == 0


def test_keep_first_equals_a_greedy_pass(spark):
    import random

    rng = random.Random(3)
    for seed in range(4):
        cells = sorted({(rng.randrange(40), b, str(rng.randrange(25))) for b in range(3) for _ in range(40)})
        kept, seen = set(), set()
        for k in sorted({c[0] for c in cells}):
            mine = {c[1:] for c in cells if c[0] == k}
            if not mine & seen:
                kept.add(k)
                seen |= mine
        got = {r["id"] for r in dedup.keep_first(spark.createDataFrame(cells, "id long, band int, cell string")).collect()}
        assert got == {c[0] for c in cells} - kept


def test_null_groups_ids_and_keys(spark):
    rows = [(1, None, "a"), (2, None, "b"), (3, "s", "A "), (None, "s", "c"), (None, None, None), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sorted(((r["source"], r["doc_id"], r["before"]) for r in sample.running(df, F.lit(1), "source").collect()), key=str)
    assert got == sorted([(None, 1, 0), (None, 2, 1), (None, 4, 2), (None, None, 3), ("s", 3, 0), ("s", None, 1)], key=str)
    assert sample.cap_per_group(df, ["source"], 2).count() == 4 and sample.budget_prefix(df, F.lit(10), 15, "source").count() == 4
    dup = {(r["doc_id"], r["exact_dup"]) for r in dedup.first_of_each(df.where("doc_id is not null"), F.sha2(T.normalize(F.col("text")), 256)).collect()}
    assert dup == {(1, False), (2, False), (3, True), (4, False)}


def test_pack_stream_equals_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    docs = [(k * 7919 % 1000, rng.choice("ab"), [rng.randrange(65_536) for _ in range(rng.choice([0, 1, 5, 40]))]) for k in range(200)]
    got = {(r["source"], r["window_id"]): r["ids"] for r in sample.pack_stream(spark.createDataFrame(docs, "doc_id long, source string, ids array<int>"), 16, F.lit(0)).collect()}
    want = {}
    for source in "ab":
        stream = [i for _, s, ids in sorted(docs) if s == source for i in [*ids, 0]]
        want |= {(source, k): stream[16 * k : 16 * k + 16] for k in range(len(stream) // 16)}
    assert got == want
    with pytest.raises(Exception, match="above 65535"):
        sample.pack_stream(spark.createDataFrame([(1, "a", [65_536])], "doc_id long, source string, ids array<int>"), 1, F.lit(0)).collect()


def test_contamination_needs_a_run(spark):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(0, " ".join(words[:26]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[:26]).upper() + " y"), (2, " ".join(words[:13])), (3, " ".join(words[:12]))], "doc_id long, text string")
    hits = dedup.gram_hits(docs, dedup.benchmark_grams(bench, F.lit("b"), F.col("item_id")))
    assert [tuple(r) for r in dedup.contaminated(hits).collect()] == [(1, "b")]
    assert {r["doc_id"] for r in hits.collect()} == {1, 2}


def test_running_blocks_and_packing(spark, monkeypatch):
    monkeypatch.setattr(sample, "SPANS", 64)
    docs = spark.createDataFrame([(0, "s", [1, 2, 3]), (1, "s", [4, 5]), (2, "s", [6, 7, 8, 9]), (3, "s", [])], "doc_id long, source string, ids array<int>")
    got = {r["window_id"]: r["ids"] for r in sample.pack_stream(docs, 4, F.lit(0)).collect()}
    assert got == {0: [1, 2, 3, 0], 1: [4, 5, 0, 6], 2: [7, 8, 9, 0]}
    kept = sample.budget_prefix(docs, F.size("ids"), 5, "source").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1]


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello <|end|>"), (2, 0, "user", "hi"), (3, 0, "assistant", "hi"), (4, 0, "user", ""), (4, 1, "assistant", "x")]
    made = convo.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r["reason"] for r in made.select("conv_id", convo.drop_reason(F.col("turns")).alias("reason")).collect()}
    assert got == {1: "", 2: "ends_with_user", 3: "bad_order", 4: "empty_turn"}
    r = made.where("conv_id = 1").select(convo.render(F.col("turns")).alias("r")).first()["r"]
    assert [r["text"][s["start"] : s["end"]] for s in r["spans"]] == ["hello < |end|>"]


def test_sql_gate_votes_and_judging(spark):
    assert sqlcheck.gate(spark, "with a as (select 1) select * from a;") and not sqlcheck.gate(spark, "select 1; drop table t")
    out = sqlcheck.run_query(spark, "select id from range(300)")
    assert out["ok"] and out["truncated"] and len(out["rows"]) == 200
    assert not sqlcheck.run_query(spark, "select nope from range(3)")["ok"]
    assert sqlcheck.results_equal([(1, 2.00001)], [(1.0, 2.0)]) and not sqlcheck.results_equal([(1,)], [(1,), (1,)])
    rows = [(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "c", "y"), (2, 0, "d", None), (3, 0, "e", "p"), (3, 1, "f", "q")]
    votes = {r["case_id"]: (r["sql"], r["votes"]) for r in sqlcheck.vote(spark.createDataFrame(rows, "case_id long, pos long, sql string, signature string")).collect()}
    assert votes == {1: ("b", 2), 3: ("e", 1)}


def test_decoding_and_fetching(spark):
    assert readers.decode_text("é".encode("latin-1"), "latin-1") == "é" and readers.decode_text(b"ok\xff", "no-such-codec") == "ok"
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "blob_id string")

    def fetch(blob):
        if blob == "c":
            raise OSError("gone")
        return b"x" if blob == "a" else None

    got = {r["blob_id"]: r["status"] for r in readers.fetch_blobs(rows, fetch).collect()}
    assert got == {"a": "ok", "b": "missing", "c": "error:OSError"}


def test_streaming_matches_batch(spark, tmp_path):
    from graintide.streaming import ingest

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "short", "en", "s", 5), (2, LINE.format(1) * 20, "en", "s", 9)], readers.DOCUMENT)
    docs.write.parquet(src)
    ingest.write_stream(ingest.clean_stream(ingest.stream_documents(spark, src)), out, str(tmp_path / "ckpt")).awaitTermination()
    rows = lambda d: sorted((r["doc_id"], r["reason"]) for r in d.collect())
    assert rows(spark.read.parquet(out)) == rows(clean.clean_prose(docs))
