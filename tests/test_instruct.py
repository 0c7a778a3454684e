"""Fixtures for SQL text, execution, traces, the code gate, examples, measures, token files and sources."""

import time

import pytest
from pyspark.sql import functions as F

from graintide.functions import text as T
from graintide.operators import clean, codecheck, convo, examples, measure, sample, sqlcheck, sqltext, templates
from graintide.sources import readers, synthetic, tokenfiles
from graintide.streaming import ingest

SCHEMA = "CREATE TABLE sales (sale_id INT, region TEXT, amount REAL);\nCREATE TABLE staff (staff_id INT, region TEXT, salary DECIMAL(8, 2), bonus INT, CHECK (bonus in (1, 2)));"
ROWS = "INSERT INTO sales VALUES (1, 'north; east', 10.5), (2, 'south', 7), (3, 'south', NULL);\nINSERT INTO staff VALUES (1, 'south', 900.25, 2);"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("sql,ok", [
    ("select 1", True), ("select 1 ; ;", True), ("select `drop` from t", True), ("select '; delete' from t", True), ("-- hi\nwith a as (select 1) select * from a", True),
    ("select 1; select 2", False), ("", False), ("   ", False), ("delete from t", False), ("select * from t where drop = 1", False), ("pragma x", False), ("/* select */ vacuum", False), ("selection", False),
])
def test_read_only(spark, sql, ok):
    assert one(spark, sqltext.is_read_only(F.lit(sql))) is ok and sqlcheck.gate(spark, sql) is ok


def test_statements_schema_and_tables(spark):
    script = SCHEMA + "\n" + ROWS
    assert one(spark, F.size(sqltext.statements(F.lit(script)))) == 4 and one(spark, sqltext.statements(F.lit(" ; '' ;a;"))) == ["''", "a"]
    assert one(spark, sqltext.schema_of(F.lit(script))) == SCHEMA
    found = {t["table"]: [tuple(c) for c in t["columns"]] for t in one(spark, sqltext.tables_of(F.lit(SCHEMA)))}
    assert found["staff"][:4] == [("staff_id", "int"), ("region", "text"), ("salary", "decimal(8, 2)"), ("bonus", "int")] and len(found["sales"]) == 3
    assert one(spark, sqltext.forbidden_in_script(F.lit("attach 'x'; PRAGMA y; create table pragmatic (a int)"))) == ["attach", "pragma"]
    assert one(spark, sqltext.normalised_sql(F.lit("select  a ,b from t where x = 'p  q' ;"))) == "select a,b from t where x = 'p  q'"


def test_answers_from_schemas(spark):
    key = F.lit(5)
    assert "staff" in one(spark, sqltext.clarification(F.lit(SCHEMA), key))["answer"] and one(spark, sqltext.clarification(F.lit("create table t (a int)"), key)) is None
    missing = one(spark, sqltext.missing_data(F.lit(SCHEMA), key))
    assert "sales, staff" in missing["answer"] and one(spark, sqltext.missing_data(F.lit("no tables"), key)) is None
    assert "delete data from sales" in one(spark, sqltext.refusal(F.lit("delete from sales"), key)) and one(spark, sqltext.refusal(F.lit("select 1"), key)) is None


def test_running_and_comparing(spark):
    assert sqlcheck.build_views(spark, SCHEMA + ROWS) == ["sales", "staff"]
    out = sqlcheck.run_query(spark, "select region, sum(amount) as total from sales group by region order by region")
    assert out["ok"] and out["rows"] == [("north; east", 10.5), ("south", 7.0)] and not out["truncated"]
    assert sqlcheck.run_query(spark, "select id from range(500)")["truncated"] and not sqlcheck.run_query(spark, "select nope from sales")["ok"]
    with pytest.raises(ValueError):
        sqlcheck.build_views(spark, "attach 'other.db'")
    assert sqlcheck.results_equal_tolerant([("a", 1.2345)], [("a", 1.23)]) and not sqlcheck.results_equal_tolerant([("a", 1.2345)], [("a", 1.3)])
    assert sqlcheck.results_equal([], []) and not sqlcheck.results_equal([(1,)], []) and not sqlcheck.results_equal([(1,)], [(1, 2)])
    got = lambda rows, ok=True: {"ok": ok, "rows": rows}
    assert [sqlcheck.judge(p, got([(1.234,)])) for p in (got([(1.234,)]), got([(1.2,)]), got([(5,)]), got([], False), {"sql": ""})] == ["match", "match_rounding", "mismatch", "error", "no_sql"]
    assert sqlcheck.judge(got([(1,)]), got([], False)) == "mismatch"


ENDLESS = "select count(*) as n from range(100000000) a join range(1000000) b on (a.id * 7919) % 9973 < (b.id * 31) % 9973"


@pytest.mark.parametrize("timeout_s", [0.02, 1.0, 4.0])
@pytest.mark.parametrize("sql", [
    pytest.param(ENDLESS, id="main job"),
    pytest.param("select aggregate(sequence(1, 4000), 0L, (a, x) -> a + aggregate(sequence(1, 60000), 0L, (b, y) -> b + y % 7)) as n", id="planning"),
    pytest.param(f"select /*+ broadcast(b) */ count(*) from range(10) a join ({ENDLESS}) b on a.id = b.n", id="broadcast"),
])
def test_the_clock_ends_whatever_runs(spark, sql, timeout_s):
    assert sqlcheck.gate(spark, sql)  # a cold session spends seconds here, before the clock
    began = time.time()
    late = sqlcheck.run_query(spark, sql, timeout_s=timeout_s)
    assert not late["ok"] and late["error"].startswith("timeout") and time.time() - began < timeout_s + 2
    assert sqlcheck.run_query(spark, "select 1 as a")["rows"] == [(1,)]


def test_no_job_is_left_after_the_clock(spark):
    sqlcheck.run_query(spark, ENDLESS, timeout_s=0.02)
    for _ in range(50):
        time.sleep(0.2)
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
    time.sleep(1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_insights_hold_only_known_numbers():
    rows = [("a", 3, 1.5), ("b", None, 9.25), ("c", 8, 2.0)]
    text = sqlcheck.insight(["name", "n", "x"], rows, 40)
    assert "40 rows; only the first 3" in text and "x is highest for b (9.25) and lowest for a (1.5)" in text
    assert sqlcheck.numbers_supported(text, rows, 40) and not sqlcheck.numbers_supported("17 rows", rows, 40)
    assert sqlcheck.insight(["a"], []).startswith("The query returned no rows") and sqlcheck.insight(["a"], [(None,)]) == "The result is NULL."
    assert sqlcheck.insight(["a", "b"], [(1, "x")]) == "The result is: a = 1, b = x." and sqlcheck.insight(["a"], [("x",), ("y",)]).endswith("The first row is x.")
    assert sqlcheck.insight(["a"], [(2,), (7,), (7,)]).endswith("a is highest for row 2 (7) and lowest for row 1 (2).")
    assert sqlcheck.format_result(["a", "b"], [(1, None), (0.1, "x")], 1, 5) == "a | b\n1 | NULL\n(4 more rows)" and sqlcheck.format_result(["a"], []) == "(no rows)"


def test_traces_and_repairs(spark):
    sqlcheck.build_views(spark, SCHEMA + ROWS)
    sql = "SELECT region, sum(amount) AS total FROM sales GROUP BY region ORDER BY total DESC LIMIT 5;"
    turns = sqlcheck.sql_trace(spark, SCHEMA, "Totals?", sql)
    assert [t["role"] for t in turns] == ["system", "user", "assistant", "tool", "assistant"]
    assert "Plan: read from sales; aggregate with SUM; group the results; sort the results; limit to 5 rows." in turns[2]["text"] and not turns[2]["text"].rstrip().endswith(";")
    assert sqlcheck.sql_trace(spark, SCHEMA, "None?", "SELECT region FROM sales WHERE amount > 99") is None
    for kinds in (["column"], ["table"], ["syntax"], ["rewrite"]):
        made = sqlcheck.repair_trace(spark, SCHEMA, "Totals?", sql, lambda found, kinds=kinds: [k for k in found if k in kinds])
        assert [t["trained"] for t in made] == [True, True, False, True, True, True, True] and made[3]["text"].startswith("<|result|>\nError: ")
    assert sqlcheck.plan_sentence(spark, "select (") == "" and sqlcheck.names_used(spark, "SELECT s.amount FROM sales s JOIN staff t ON s.region = t.region") == (["amount", "region"], ["sales", "staff"])


@pytest.mark.parametrize("sql,columns,tables", [
    ("SELECT `Filter`, Sort FROM `Project` WHERE `Join` > 1 ORDER BY `Aggregate`", "Aggregate Filter Join Sort", "Project"),
    ("WITH c AS (SELECT a, sum(b) AS total FROM t GROUP BY a) SELECT c.a, total FROM c WHERE total > (SELECT avg(x) FROM u WHERE u.k = c.a) ORDER BY total", "a b k x", "t u"),
    ("SELECT d.total FROM (SELECT sum(v) AS total FROM t) d, r WHERE r.total IN (SELECT z FROM w) AND EXISTS (SELECT 1 FROM q WHERE q.i = r.i)", "i total v z", "q r t w"),
    ("SELECT year(d) AS y, count(*) AS n FROM t GROUP BY y HAVING n > 1 ORDER BY y", "d", "t"), ("SELECT t.s.f, db.t.g FROM db.t", "g s", "t"), ("SELECT e FROM t LATERAL VIEW explode(xs) AS e", "xs", "t"),
    ("SELECT a FROM t UNION ALL SELECT max(b) OVER (ORDER BY c) FROM u", "a b c", "t u"), ("SELECT 1", "", ""), ("SELECT upper(name) AS name, count(*) FROM t GROUP BY name", "name", "t"),
])
def test_names_are_read_off_the_tree(spark, sql, columns, tables):
    assert sqlcheck.names_used(spark, sql) == (columns.split(), tables.split())


def test_plan_sentence_sees_nodes_and_not_names(spark):
    assert sqlcheck.plan_sentence(spark, "SELECT `Filter ` FROM `Sort [` LIMIT 5") == "Plan: read from Sort [; limit to 5 rows."
    assert sqlcheck.plan_sentence(spark, "SELECT x FROM (SELECT x FROM t ORDER BY x LIMIT 9) LIMIT 5").endswith("sort the results; limit to 5 rows.")
    assert sqlcheck.plan_sentence(spark, "SELECT 1") == "Plan: compute the value."



def test_templates_fill_slots_and_run(spark):
    made = synthetic.supply_chain(spark, 3)
    synthetic.as_views(made)
    found = templates.SqlTemplate("supply", "orders", ("How many {c} orders?", "Count {c} orders."), "SELECT count(*) AS n FROM purchase_orders WHERE status = '{c}'", {"c": templates.pick("purchase_orders", "status")})
    kept = templates.SqlTemplate("supply", "held", ("Top {n}?",), "SELECT name FROM suppliers ORDER BY rating DESC, supplier_id LIMIT {n}", {"n": templates.choice(3, 5)}, holdout=True)
    got = templates.trace_set(spark, [found, kept], range(8), synthetic.schema_ddl(made), repeats=2)
    calls = [g["turns"][1]["text"] + g["turns"][2]["text"].split("<|sql|>")[1] for g in got]
    assert 2 <= len(got) <= 8 and max(map(calls.count, calls)) <= 2 and {g["domain"] for g in got} == {"supply"} and all("purchase_orders" in g["turns"][2]["text"] for g in got)
    assert templates.instantiate(kept, spark, 1) == templates.instantiate(kept, spark, 1)
    assert len(templates.trace_set(spark, [found, kept], range(2), "", holdout=True)) == 2


def test_synthetic_databases_are_the_same_again(spark):
    for make in (synthetic.supply_chain, synthetic.finance):
        first, again, other = make(spark, 1), make(spark, 1), make(spark, 2)
        for name in first:
            assert first[name].exceptAll(again[name]).isEmpty() and again[name].exceptAll(first[name]).isEmpty()
        assert any(not first[n].exceptAll(other[n]).isEmpty() for n in first)
    orders = first = synthetic.supply_chain(spark, 1)["purchase_orders"]
    assert orders.where("status <> 'received' and received_date is not null").isEmpty() and orders.where("promised_date < order_date").isEmpty()


@pytest.mark.parametrize("code,why", [
    ("import pandas as pd\nprint(pd)", ""), ("x = '1 + 1'\ny = 'a..b'", ""), ("import os", "line 1: package os is"), ("import json, os.path", "line 1: package os.path is"), ("from . import x", "line 1: package . is"),
    ("x = 1\nfrom socket import x", "line 2: package socket is"), ("eval('1')", "line 1: built-in eval"), ("x.__class__", "line 1: internal attribute __class__"), ("'http://x'", "line 1: text is an address"),
    ("' S3://x'", "line 1: text is an address"), ("'/etc'", "line 1: text is a path from a root"), ("'~'", "line 1: text is a path from a root"), ("'C:\\\\x'", "line 1: text is a path from a root"), ("'a/../b'", "line 1: text is a path that goes up"),
    ("'a\\\\..'", "line 1: text is a path that goes up"), ("def f(:", "line 1: cannot be parsed"), ("+".join("1" * 900), ""), ("", ""),
])
def test_code_gate(spark, code, why):
    assert codecheck.code_fault(code).startswith(why) and bool(codecheck.code_fault(code)) == bool(why)
    assert one(spark, codecheck.fault(F.lit(code))) == codecheck.code_fault(code)


def test_code_gate_names_every_fault_in_order():
    assert [f.split(":")[0] for f in codecheck.code_faults("import os\nx = eval\nopen('/etc')")] == ["line 1", "line 2", "line 3", "line 3"]
    assert codecheck.code_faults(None) == [] and codecheck.code_fault(None) == ""


def test_code_runs_in_its_own_folder():
    done = codecheck.run_python("print(sum(int(x) for x in '1 2 3'.split()))")
    assert done["ok"] and done["stdout"] == "6\n"
    assert codecheck.run_python("while True: pass", timeout_s=1)["timed_out"] and not codecheck.run_python("import os")["ok"]
    assert "ZeroDivisionError" in codecheck.run_python("1 / 0")["error"] and codecheck.run_python("print('x' * 9999)", max_output=10)["stdout"].endswith("truncated]")
    assert codecheck.run_python("import pandas as pd\nprint(len(pd.read_csv('a.csv')))", {"a.csv": "x\n1\n2\n"})["stdout"] == "2\n"


def test_rendering_masks_and_faults(spark):
    turn = "struct<role:string,text:string,trained:boolean>"
    rows = [
        (1, [("system", "S", True), ("user", "U", True), ("assistant", "bad", False), ("tool", "T", True), ("assistant", "good", True)]), (2, [("user", "U", True)]),
        (3, [("user", "U", True), ("assistant", "A", False)]), (4, [("narrator", "N", True), ("assistant", "A", True)]),
    ]
    df = spark.createDataFrame(rows, f"id long, turns array<{turn}>")
    got = {r["id"]: (r["f"], r["r"]) for r in df.select("id", examples.fault(F.col("turns")).alias("f"), examples.render(F.col("turns")).alias("r")).collect()}
    text = "<|bos|><|system|>S<|user|>U<|assistant|>badT<|assistant|>good<|eos|>"
    assert got[1][1]["text"] == text and [text[s["start"]:s["end"]] for s in got[1][1]["spans"]] == ["good<|eos|>"]
    assert [got[k][0] for k in (2, 3, 4)] == ["no assistant turn", "doesn't end with a trained assistant turn", "unknown role"] and all(got[k][1] is None for k in (2, 3, 4))
    by_char = lambda: lambda t: ([ord(c) for c in t], list(range(len(t))))
    made = examples.encode_examples(df, by_char, 100).first()
    assert sum(made["mask"]) == len("good<|eos|>") and examples.encode_examples(df, by_char, 10).count() == 0
    batch = spark.createDataFrame([(1, [5, 6, 7], [0, 1, 1]), (1, [8], [1])], "b long, ids array<int>, mask array<int>")
    got = sorted((r["input_ids"], r["attention_mask"], r["labels"]) for r in examples.collated(batch, "b", 9).collect())
    assert got == [([5, 6, 7], [1, 1, 1], [-100, 6, 7]), ([8, 9, 9], [1, 0, 0], [8, -100, -100])]


def test_encoding_with_a_public_file(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    made = spark.range(1).select(examples.encoded(F.lit("low lower"), lambda: examples.file_encoder(path)).alias("e")).first()["e"]
    assert len(made["ids"]) == len(made["starts"]) > 1 and made["starts"][0] == 0
    assert measure.special_ids({"<a>": 1}.get, ["<a>"]) == {"<a>": 1}
    with pytest.raises(ValueError):
        measure.special_ids({}.get, ["<a>"])
    from graintide.plans.instruct import byte_tokenizer

    docs = spark.createDataFrame([("a", "naïve 日本 🙂 text"), ("a", None), ("b", "")], "source string, text string")
    got = {r["source"]: (r["failures"], r["tokens"]) for r in measure.fertility(docs, byte_tokenizer).collect()}
    assert got["a"][0] == 0 and got["a"][1] > 4 and got["b"] == (0, 0)


def greedy_batches(sizes, budget):
    """Batches of sizes in their order, cut where the longest times the count would pass the budget."""
    batch, longest, count, out = 0, 0, 0, []
    for n in sizes:
        longest = max(longest, n)
        if count and longest * (count + 1) > budget:
            batch, longest, count = batch + 1, n, 0
        count += 1
        out.append(batch)
    return out


@pytest.mark.parametrize("budget", [1, 7, 90, 300, 5000])
def test_token_batches_equal_the_greedy_cut(spark, budget):
    sizes = {k * 1_000_003: (k * k * 37) % 90 if k % 3 else 12 for k in range(700)}
    df = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()], "k long, n long, batch_id string")
    got = {r["k"]: r["batch_id"] for r in convo.token_batches(df, "n", "k", budget).collect()}
    order = sorted(sizes, key=lambda k: (min(sizes[k], budget + 1), k))
    assert [got[k] for k in order] == greedy_batches([sizes[k] for k in order], budget)


def test_token_batches_of_groups_nulls_copies_and_nothing(spark):
    rows = [("a", k, k % 5) for k in range(40)] + [(None, k, 3) for k in range(10)] + [("b", None, None), ("b", 1, -4), ("b", 1, 2), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "g string, k long, n long")
    made = convo.token_batches(df, "n", "k", 10, by="g").collect()
    assert len(made) == len(rows)
    for group in ("a", "b", None):
        mine = sorted((max(n or 0, 0), k is None, k or 0) for g, k, n in rows if g == group)
        assert sorted(r["batch_id"] for r in made if r["g"] == group) == greedy_batches([n for n, _, _ in mine], 10)
    assert convo.token_batches(df.limit(0), "n", "k", 10).collect() == []
    text_keys = spark.createDataFrame([(f"id-{k}", 1 + k % 4) for k in range(50)], "k string, n int")
    assert convo.token_batches(text_keys, "n", "k", 8).agg({"batch_id": "max"}).first()[0] == max(greedy_batches(sorted(1 + k % 4 for k in range(50)), 8))
    with pytest.raises(ValueError):
        convo.token_batches(df, "n", "k", 0)


def test_measures_of_nothing_and_of_few(spark):
    empty = spark.createDataFrame([], "license_type string, length_bytes long, int_score int")
    assert measure.licence_summary(empty).first().asDict() == {"files": 0, "permissive_files": 0, "permissive_high_files": 0, "total_bytes": 0, "permissive_bytes": 0, "file_share": 0.0, "byte_share": 0.0}
    none = measure.fetch_summary(spark.createDataFrame([], "status string, raw binary"), 0.0).first()
    assert none["attempted"] == 0 and none["failure_rate"] == none["mean_bytes"] == none["files_per_second"] == 0.0
    assert measure.clean_tokens(10, 40.0, 4.0) == 100 and measure.fetch_seconds(100, 5.0, 4) == 5.0 and measure.quotas(10, {"a": 0.3, "b": 0.7}) == {"a": 3, "b": 7}
    for wrong in (lambda: measure.clean_tokens(1, 1, 0), lambda: measure.fetch_seconds(1, 0, 1), lambda: measure.quotas(1, {"a": 0.5}), lambda: measure.budget_of(F.lit(1), 0), lambda: measure.learning_rate(F.lit(1), 10, 9, 1.0, 0.1)):
        with pytest.raises(ValueError):
            wrong()
    assert measure.parameters(64, 32, 64, 2, 4, 4) == 64 * 32 + 2 * (4 * 32 * 32 + 3 * 32 * 64 + 64) + 32
    info = {"a": {"cardData": {"license": ["mit", "x"]}, "rows": 5}, "b": {"tags": ["license:cc"]}, "c": None}
    got = {r["id"]: (r["exists"], r["license"], r["rows"]) for r in measure.metadata(spark, list(info), info.get).collect()}
    assert got == {"a": (True, "mit,x", 5), "b": (True, "cc", None), "c": (False, None, None)}
    words = spark.createDataFrame([("known",)], "word string")
    docs = spark.createDataFrame([(1, "known " * 30 + "strange " * 30), (2, "odd text")], "doc_id long, text string")
    assert {r["doc_id"]: r["ratio"] for r in measure.unknown_ratios(docs, words).collect()} == {1: 0.5, 2: 0.0}
    assert {r["ratio"] for r in measure.unknown_ratios(docs, words.limit(0)).collect()} == {0.0}


def test_token_files(spark, tmp_path):
    windows = spark.createDataFrame([("a", "train", k, [k, k + 1, 65_535, 0]) for k in range(9)] + [("b", "val", 0, [0, 0, 0, 7])], "source string, split string, window_id long, ids array<int>")
    files = spark.createDataFrame(tokenfiles.write_windows(windows, f"file://{tmp_path}/tokens").collect())
    back = tokenfiles.read_windows(files, 4)
    assert sorted(r["ids"] for r in back.collect()) == sorted(r["ids"] for r in windows.collect())
    picked = files.where("source = 'a'").select("file", F.lit(3).alias("window"))
    assert [r["ids"] for r in tokenfiles.read_windows(files, 4, picked).collect()] == [[3, 4, 65_535, 0]]
    seen = {r["windows"]: (r["size_matches"], r["max_id"], r["first_ends"]) for r in tokenfiles.inspect(back, 4, 0).collect()}
    assert seen == {9: (True, 65_535, 2), 1: (True, 7, 3)}
    parts = spark.createDataFrame(tokenfiles.write_windows(windows, f"file://{tmp_path}/parts", per_file=4).collect())
    assert sorted((r["source"], r["windows"]) for r in parts.collect()) == [("a", 1), ("a", 4), ("a", 4), ("b", 1)]
    assert sorted(r["ids"] for r in tokenfiles.read_windows(parts, 4).collect()) == sorted(r["ids"] for r in windows.collect())
    with pytest.raises(Exception, match="16 bits"):
        tokenfiles.write_windows(spark.createDataFrame([("a", "train", 0, [70_000])], windows.schema), f"file://{tmp_path}/t").collect()
    order = tokenfiles.file_order(spark, ["x/b/2.jsonl", "x/a/9.jsonl", "x/b/1.jsonl", "x/z/1.jsonl"], ["b", "a"])
    assert [r["file"] for r in order.orderBy("place").collect()] == ["x/b/1.jsonl", "x/b/2.jsonl", "x/a/9.jsonl"]


def test_sources(spark, tmp_path):
    import sqlite3

    folder = tmp_path / "root" / "own" / "set" / "default" / "train"
    spark.range(10).repartition(3).write.parquet(str(folder))
    path = readers.dataset_path(str(tmp_path / "root"), "own/set")
    assert path == str(folder) and len(readers.shards(spark, path)) == 3 and readers.shards(spark, path) == sorted(readers.shards(spark, path))
    assert readers.row_count(spark, path) == 10 and readers.row_count(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "lines").mkdir()
    for name in ("a", "b"):
        (tmp_path / "lines" / f"{name}.jsonl").write_text("".join(f'{{"text": "{name}{k}"}}\n' for k in range(40)))
    got = readers.read_indexed_jsonl(spark, str(tmp_path / "lines"))
    assert {(r["file"][-7:-6], r["idx"], r["text"]) for r in got.collect()} == {(n, k, f"{n}{k}") for n in "ab" for k in range(40)}
    assert readers.fetch_plan(got, 1, 4).count() == 20 and readers.fetch_plan(got, 1, 4, 3).count() == 3
    with pytest.raises(ValueError):
        readers.fetch_plan(got, 4, 4)
    file = str(tmp_path / "x.db")
    db = sqlite3.connect(file)
    db.execute("create table zoo (id integer, name text, weight real)")
    db.execute("create table ark (a int)")
    db.executemany("insert into zoo values (?, ?, ?)", [(k, None if k == 3 else f"n{k}", k / 2) for k in range(250)])
    db.execute("insert into zoo values (999, cast(x'61ff62' as text), null)")
    db.commit()
    db.close()
    assert readers.sqlite_schema(file) == "CREATE TABLE ark (a int);\nCREATE TABLE zoo (id integer, name text, weight real);"
    zoo = readers.read_sqlite(spark, file, "zoo", rows_per_task=100)
    assert zoo.count() == 251 and zoo.where("id = 999").first()["name"] == "ab" and zoo.where("name is null").first()["id"] == 3 and readers.read_sqlite(spark, file, "ark").count() == 0


def test_texts_of_files_and_tables(spark):
    text = F.lit("intro\n--- a.csv\nx,y\n1,2\n--- b.csv \nz\n")
    files = one(spark, readers.csv_files(text))
    assert [f["name"] for f in files] == ["a.csv", "b.csv"] and one(spark, readers.headers_of(readers.csv_files(text))) == "a.csv: x, y\nb.csv: z"
    cells = one(spark, readers.typed_cells(readers.pipe_rows(F.lit("a | 1.5\nragged\nb | x"), 2)))
    assert [[c["number"] for c in r] for r in cells] == [[None, 1.5], [None, None]]
    assert one(spark, measure.record_text(F.lit("a"), F.array(F.lit("b"), F.lit("c")), F.lit(None).cast("string"))) == "a\nb\nc"
    assert one(spark, T.license_from_card(F.lit('{"license": ["a", "b"]}'), F.array(F.lit("license:z")))) == "a,b"
    assert one(spark, T.license_from_card(F.lit("{}"), F.array(F.lit("x"), F.lit("license:z")))) == "z"
    rows = spark.createDataFrame([("permissive", 3, 200), ("permissive", None, 300), ("other", 5, 300), ("permissive", 9, 100_000), ("permissive", 9, 199)], "license_type string, int_score int, length_bytes long")
    assert rows.where(readers.accept_code_row()).count() == 2
    got = spark.createDataFrame([(4, "x"), (3, "x"), (None, "x"), (5, None)], "int_score int, blob_id string")
    assert got.where(readers.accept_for_fetch()).count() == 1


def test_written_reports_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "source string, n long")
    readers.write_corpus(df, str(tmp_path / "c"))
    assert sorted(map(tuple, readers.read_parquet(spark, str(tmp_path / "c")).select("source", "n").collect()), key=str) == [("a", 1), ("b", None)]
    readers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    readers.write_report(df, str(tmp_path / "r"))
    readers.append_metrics(df, str(tmp_path / "m"))
    readers.append_metrics(df, str(tmp_path / "m"))
    assert readers.read_jsonl(spark, str(tmp_path / "r"), schema="source string, n long").count() == 2 and spark.read.json(str(tmp_path / "m")).count() == 4
    spark.createDataFrame([("t",), (None,)], "body string").write.parquet(str(tmp_path / "s"))
    both = readers.read_sources(spark, {"s": str(tmp_path / "s")}, {"s": "body"})
    assert sorted(r["text"] for r in both.collect()) == ["", "t"]


def test_stream_restarts_and_counts_events(spark, tmp_path):
    docs = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    put = lambda k: spark.createDataFrame([(k, f"text {k}", "en", "s", 6)], docs).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(1)
    run = lambda: ingest.write_stream(ingest.clean_stream(ingest.stream_documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    put(2)
    run()
    run()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = ingest.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["total"] for r in spark.table("counted").collect()) == [3.0, 3.0]


def test_sql_gate_of_dialects():
    good = ["SHOW TABLES", "VALUES (1)", "select 'it\\'s' from t", "SELECT `a` FROM `t` # remark", "select [a b] from [t]\nGO\n", "create table t (a int auto_increment) engine=InnoDB"]
    assert all(map(clean.sql_parses, good)) and not any(map(clean.sql_parses, ["SELECT FROM WHERE", "nothing (like sql", "", "select * from t where"]))


def test_weighted_sampler_is_a_function_of_seed_and_step(spark):
    groups = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "source string, w double")
    draws = spark.range(4000).select(F.col("id").alias("step"), F.lit(0).alias("draw"))
    got = sample.sampled_with_weights(groups, F.col("w"), draws, "source", 1)
    again = sample.sampled_with_weights(groups, F.col("w"), draws.where("step = 77"), "source", 1).first()["source"]
    assert got.count() == 4000 and 2800 < got.where("source = 'b'").count() < 3200 and got.where("step = 77").first()["source"] == again


def test_blobs_are_tried_again_and_decoded(spark):
    import gzip

    def fetch(blob):
        if blob == "none":
            return None
        if blob == "bad":
            raise OSError("no")
        fetch.calls = getattr(fetch, "calls", 0) + 1
        if fetch.calls == 1:
            raise TimeoutError
        return gzip.compress("é".encode("latin-1"))

    rows = spark.createDataFrame([("good",), ("none",), ("bad",)], "blob_id string").coalesce(1)
    got = {r["blob_id"]: (r["raw"], r["status"]) for r in readers.fetch_blobs(rows, fetch, threads=1, pause_s=0.0).collect()}
    assert got["none"] == (None, "missing") and got["bad"] == (None, "error:OSError") and got["good"][1] == "ok"
    assert readers.decode_text(bytes(got["good"][0]), "latin-1") == "é" and readers.decode_text(b"a\xffb", "no-such") == "ab" and readers.decode_text(None, None) == ""


def test_stream_budget_holds_over_batches(spark, tmp_path):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"

    def put(rows):
        spark.createDataFrame([(k, "x" * n, "en", s, n) for k, s, n in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        made = ingest.within_budget(ingest.stream_documents(spark, str(tmp_path / "in")), 10)
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(90)

    put([(1, "a", 4), (2, "a", 4), (3, "b", 50)])
    run()
    put([(4, "a", 4), (5, "a", 4), (6, "b", 1)])
    run()
    assert sorted((r["source"], r["doc_id"], r["before"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 1, 0), ("a", 2, 4), ("a", 4, 8), ("b", 3, 0)]
