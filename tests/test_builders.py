import pytest
from pyspark.sql import functions as F

from graintide.operators import builders

DDL = "CREATE TABLE t{} (a INT, b REAL, c INT);"
RECORD = "id long, domain string, task_type string, prompt string, context string, sql string, extra string"
READ, WRITE = "data retrieval", "data manipulation"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def records(spark, made):
    return spark.createDataFrame([(*r, "kept") for r in made], RECORD)


def test_reasons_of_records_come_in_order(spark):
    made = records(spark, [
        (1, "d", READ, " What? \n", DDL.format(1), "SELECT a FROM t1 ; ;"), (2, "d", WRITE, "", None, None), (3, "d", None, "x", "", "SELECT 1"), (4, "d", READ, " \t\n", DDL, "SELECT 1"), (5, None, READ, "x", DDL, None),
        (6, "d", READ, "x", "ATTACH 'y' AS z;" + DDL, "SELECT 1"), (7, "d", READ, "x", "SELECT 1;", "SELECT 1"), (8, "d", READ, "x", DDL.format(8), "SELECT 1"), (9, "d", READ, "x", DDL.format(9), "SELECT 1"), (10, "d", READ, "x", None, "with q as (select 1) select 'drop' from q"),
    ])
    results = spark.createDataFrame([(1, 2, "a\n1", "said", "Plan: read."), (9, 201, "s", "s", None)], "seed long, n long, shown string, said string, plan string")
    got = builders.sql_examples(made, results, "system", think=1.0)
    assert {r["id"]: r["reason"] for r in got.collect()} == {1: "", 2: "task_type", 3: "task_type", 4: "no_question", 5: "not_read_only", 6: "forbidden_script", 7: "no_schema", 8: "no_rows", 9: "truncated", 10: "no_schema"}
    first = got.where("id = 1").first()
    assert [t["role"] for t in first["turns"]] == ["system", "user", "assistant", "tool", "assistant"] and first["extra"] == "kept"
    assert first["turns"][1]["text"] == "<|schema|>\nCREATE TABLE t1 (a INT, b REAL, c INT);\n<|/schema|>\nWhat?"
    assert first["turns"][2]["text"] == "<|think|>\nPlan: read.\n<|/think|>\n<|sql|>\nSELECT a FROM t1\n<|/sql|>" and first["turns"][4]["text"] == "<|insight|>\nsaid\n<|/insight|>"
    assert got.where("reason <> '' and turns is not null").isEmpty()
    assert builders.sql_examples(made.limit(0), results).isEmpty()


def test_domains_are_capped_and_held_out(spark):
    made = spark.createDataFrame([(i, d) for k, (d, n) in enumerate({"poetry": 40, "banking": 40, None: 12, "sea": 15}.items()) for i in range(1000 * k, 1000 * k + n)], "id long, domain string")
    got = builders.split_domains(made, ["sea"], 10, 25, 0.3)
    assert {r["domain"]: r["count"] for r in got.groupBy("domain").count().collect()} == {"poetry": 10, "banking": 25, None: 10, "sea": 15}
    assert {r["split"] for r in got.where("domain = 'sea'").collect()} == {"test_unseen"} and {r["split"] for r in got.where("domain = 'banking'").collect()} == {"train", "val"}
    assert rows(got, "id", "split") == rows(builders.split_domains(made.repartition(5), ["sea"], 10, 25, 0.3), "id", "split")
    report = {r["split"]: (r["examples"], r["target_examples"]) for r in builders.split_report(got).collect()}
    assert report["test_unseen"] == (15, 0) and sum(n for n, _ in report.values()) == 60 and sum(t for _, t in report.values()) == 25


def test_no_group_is_on_both_sides(spark):
    made = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("db"), F.col("id") % 23)).alias("db"))
    got = builders.split_by_group(made, "db", 0.4)
    assert got.groupBy("db").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty() and got.count() == 300 and got.select("split").distinct().count() == 2


def test_refusal_set_fills_kinds_in_order(spark):
    made = records(spark, [(i, "sea" if i % 5 == 0 else "d", WRITE if i % 3 == 0 else READ, f"ask {i}", DDL.format(i % 11) if i % 7 else None, f"DELETE FROM t{i}" if i % 3 == 0 else "SELECT 1") for i in range(60)])
    got = builders.refusal_set(made, ["sea"], (4, 5, 3), 2, 0.5)
    kinds = {(r["split"] == "test_unseen", r["kind"]): r["count"] for r in got.groupBy("split", "kind").count().groupBy("split", "kind").agg(F.sum("count").alias("count")).collect() if r["split"] == "test_unseen"}
    assert kinds[True, "refusal"] == 2 and all(n <= 2 for n in kinds.values())
    train = got.where("split <> 'test_unseen'")
    assert {r["kind"]: r["count"] for r in train.groupBy("kind").count().collect()} == {"refusal": 4, "clarify": 5, "missing": 3}
    assert got.where("question is null or answer is null or question = ''").isEmpty() and got.count() == got.select("id").distinct().count()
    refused = got.where("kind = 'refusal'").collect()
    assert all(r["id"] % 3 == 0 and f"t{r['id']}" in r["answer"] and r["question"] == f"ask {r['id']}" for r in refused)
    asked = got.where("kind <> 'refusal' and split <> 'test_unseen'").collect()
    assert all(r["id"] % 3 for r in asked) and len({r["id"] % 11 for r in asked}) == len(asked)  # each schema once
    assert builders.refusal_set(made.limit(0), ["sea"]).isEmpty()


def test_general_set_keeps_what_fits(spark):
    turn = "array<struct<turn:long,role:string,text:string,trained:boolean>>"
    talk = lambda *said: [(k, role, text, True) for k, (role, text) in enumerate(said)]
    good, long_, bad = talk(("user", "hi"), ("assistant", "yes")), talk(("user", "hi"), ("assistant", "y" * 500)), talk(("assistant", "hi"))
    made = spark.createDataFrame([(i, "ab"[i % 2], good if i < 30 else long_ if i < 40 else bad) for i in range(50)] + [(90, None, good), (91, "c", good)], f"id long, source string, turns {turn}")
    encoder = lambda: lambda text: ([1] * len(text), list(range(len(text))))
    got = builders.general_set(made, {"a": 5, "b": 100}, encoder, 200, 0.5)
    assert {r["source"]: r["count"] for r in got.groupBy("source").count().collect()} == {"a": 5, "b": 15} and max(r["id"] for r in got.collect()) < 30


def test_repairs_of_training_examples(spark):
    turn = "array<struct<role:string,text:string>>"
    thought = lambda x: [("a", ""), ("b", ""), ("c", ""), ("d", ""), ("e", x)]
    made = spark.createDataFrame(
        [(1, "s", "x", thought("I will correct the column name and")), (1, "s", "y", thought("I will correct the table name")), (2, "s", "z", thought("so using only columns from the schema.")), (3, "s", "q", thought("?")), (4, "s", "w", thought("")), (5, "t", "v", None)], f"id long, source string, broken string, turns {turn}")
    train = spark.createDataFrame([(1,), (1,), (2,), (3,), (5,), (None,)], "id long")
    got = builders.repair_set(made, train, {"s": 10, "t": 10})
    kinds = {r["id"]: r["kind"] for r in got.collect()}
    assert got.count() == 4 and kinds[1] in ("column", "table") and kinds[2] == "rewrite" and kinds[3] == kinds[5] == "other"
    assert builders.repair_set(made, train, {"s": 2}).count() == 2
    drawn = builders.drawn_items(train.where("id is not null"), made, 2)
    assert drawn.select("id").distinct().count() == 2


def brute(gold, given):
    cells = lambda r: tuple(None if x is None else str(x) for x in r)
    keys = {r[0] for r in gold}
    ordered = lambda side, k: [cells(r[2:]) for r in sorted((r for r in side if r[0] == k), key=lambda r: r[1])]
    return {k: ordered(gold, k) == ordered(given, k) for k in keys}


@pytest.mark.parametrize("change", ["", "order", "cell", "null", "fewer", "more", "none", "doubled"])
def test_ordered_matches(spark, change):
    gold = [(k, p, 10 * p + k, None if p == 2 else f"v{p}") for k in range(4) for p in range(1, 5)]
    given = [list(r) for r in gold]
    mine = [r for r in given if r[0] == 2]
    if change == "order":
        mine[0][1], mine[1][1] = 2, 1
    elif change == "cell":
        mine[3][2] += 1
    elif change == "null":
        mine[1][3] = "None"
    elif change == "fewer":
        given = [r for r in given if r[0] != 2 or r[1] < 4]
    elif change == "more":
        given += [[2, 5, 1, "x"], [7, 1, 1, "unasked"]]
    elif change == "none":
        given = [r for r in given if r[0] != 2]
    elif change == "doubled":
        given += [[2, 1, 12, "v1"]]
    got = builders.ordered_matches(spark.createDataFrame(gold, "c long, pos long, a long, b string"), spark.createDataFrame([tuple(r) for r in given], "c long, pos long, other int, b string"), "c")
    assert {r["c"]: r["match"] for r in got.collect()} == brute(gold, [tuple(r) for r in given]) == {k: k != 2 or not change for k in range(4)}


def test_rates_of_ordered_matches_and_behaviour(spark):
    matches = spark.createDataFrame([(1, True), (2, False), (3, True)], "c long, match boolean")
    outputs = spark.createDataFrame([(1, "x", "ran", True), (2, "x", "ran", False), (3, "y", "error", True), (4, "y", "no_code", None)], "c long, template string, status string, strict boolean")
    got = {r["template"]: (r["n"], r["matching"], r["ran"], r["strict"]) for r in builders.ordered_rates(matches, outputs, "c").collect()}
    assert got == {"x": (2, 0.5, 1.0, 0.5), "y": (2, 0.0, 0.0, 0.5), None: (4, 0.25, 0.5, 0.5)}
    said = spark.createDataFrame([("refusal", "<|insight|> I CANNOT"), ("refusal", "<|sql|> <|insight|> cannot"), ("refusal", None), ("clarify", "<|insight|> cannot"), ("other", "x"), (None, "x")], "kind string, text string")
    assert rows(builders.behaviour(said), "kind", "n", "correct", "wrote_sql") == [("clarify", 1, 0.0, 0.0), ("refusal", 3, 0.333333, 0.333333)]
