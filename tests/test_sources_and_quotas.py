import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from graintide.operators import sample
from graintide.sources import datasources


def by_files(rows, quotas, max_docs=0, pass_on=False):
    """Ids that file_quotas keeps, one file after another in plain Python; rows are (source, file, id, size)."""
    kept = set()
    for source, quota in quotas.items():
        files = {}
        for s, f, k, n in sorted((r for r in rows if r[0] == source), key=lambda r: (r[1] is None, r[1] or "", r[2])):
            files.setdefault(f, []).append((k, n))
        totals = {f: sum(n for _, n in docs) for f, docs in files.items()}
        level = max(1, quota // max(1, len(files)))
        if pass_on:
            level = max([1, *(x for x in range(1, quota + 1) if sum(min(t, x) for t in totals.values()) <= quota)])
            if sum(totals.values()) <= quota:
                level = 1 << 60
        mine = []
        for docs in files.values():
            used = 0
            for k, n in docs:
                if used >= level:
                    break
                mine.append(k)
                used += n
        kept |= set(mine[: max_docs or None])
    return kept


@pytest.mark.parametrize("pass_on", [False, True])
@pytest.mark.parametrize("max_docs", [0, 7])
def test_file_quotas_equal_one_file_after_another(spark, pass_on, max_docs):
    rows = [("a", f"f{min(k % 9, 4)}", k, 5 + (k * 31) % 40) for k in range(120)] + [("b", None, 1000 + k, 10) for k in range(30)] + [("b", "x", 2000, 3), ("c", "x", 3000, 5), (None, "x", 4000, 5)]
    rows += [("d", f"g{k}", 5000 + k, 50) for k in range(20)]
    quotas = {"a": 900, "b": 120, "d": 8, "absent": 5}
    df = spark.createDataFrame([(*r, "mine") for r in rows], "source string, file string, doc_id long, n long, before string")
    got = sample.file_quotas(df.withColumnRenamed("before", "_mine"), F.col("n"), quotas, max_docs=max_docs, pass_on=pass_on).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(by_files(rows, quotas, max_docs, pass_on)) and all(r["_mine"] == "mine" for r in got)


def test_file_quotas_of_nothing(spark):
    df = spark.createDataFrame([], "source string, file string, doc_id long, n long")
    assert sample.file_quotas(df, F.col("n"), {"a": 3}, pass_on=True, max_docs=2).collect() == [] and sample.file_quotas(df, F.col("n"), {}).collect() == []


@pytest.fixture(scope="module")
def token_folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tokens")
    for name, windows in (("a", 50), ("b", 3), ("c", 0)):
        (folder / f"{name}.bin").write_bytes((np.arange(windows * 4, dtype="<u2") + ord(name)).tobytes())
    (folder / "index.json").write_text("{}")
    return folder


def test_token_windows_are_read_whole_and_by_filter(spark, token_folder):
    datasources.register(spark)
    every = spark.read.format("token_windows").option("width", 4).option("task_bytes", 64).load(str(token_folder))
    rows = every.collect()
    assert len(rows) == 53 and every.rdd.getNumPartitions() == 7
    assert all(r["ids"] == [ord(r["file"][-5]) + 4 * r["window"] + i for i in range(4)] for r in rows)
    picked = every.where(F.col("window").isin(2, 3, 40, 99) & (F.col("file") == f"{token_folder}/a.bin"))
    assert sorted(r["window"] for r in picked.collect()) == [2, 3, 40] and picked.rdd.getNumPartitions() == 1
    assert "Filter " not in picked._jdf.queryExecution().executedPlan().toString()
    addressed = spark.read.format("token_windows").option("width", 4).load(f"file://{token_folder}/")
    assert {r["file"] for r in addressed.select("file").distinct().collect()} == {f"file://{token_folder}/{n}.bin" for n in "ab"} and addressed.where(F.col("file").isin(f"file://{token_folder}/b.bin")).count() == 3
    assert every.where("window >= 48 and window < 1000").count() == 2 and every.where("window > 2 and window <= 3 and array_contains(ids, 109)").count() == 1
    assert every.where("window is null").count() == 0 and every.where("window = 1 and window = 2").count() == 0


def test_token_windows_open_no_file_without_ids(spark, token_folder, tmp_path):
    datasources.register(spark)
    bare = spark.read.format("token_windows").option("width", 4).schema("file string, window long").load(str(token_folder))
    assert bare.groupBy().agg(F.count("*"), F.max("window")).first()[:] == (53, 49)
    reader = datasources.WindowReader({"width": "4", "path": str(tmp_path)}, ["window"])
    assert [len(b) for b in reader.read(datasources.Spans([("file:///no/such/file.bin", 0, 9)]))] == [9]
    assert spark.read.format("token_windows").option("width", 4).load(str(tmp_path)).collect() == []


def test_token_windows_refuse_files_of_another_width(spark, token_folder):
    datasources.register(spark)
    with pytest.raises(Exception, match="isn't a number of windows"):
        spark.read.format("token_windows").option("width", 7).load(str(token_folder)).collect()
    with pytest.raises(Exception, match="width"):
        spark.read.format("token_windows").load(str(token_folder)).collect()


def test_sqlite_tables_prune_and_push(spark, tmp_path):
    datasources.register(spark)
    path = str(tmp_path / "zoo.db")
    with sqlite3.connect(path) as db:
        db.execute('create table zoo (id integer primary key, name text, "the weight" real, legs int)')
        db.executemany("insert into zoo values (?, ?, ?, ?)", [(k * 3, f"n{k}", k / 2, k % 5 if k % 7 else None) for k in range(1, 400)])
        db.execute("insert into zoo values (5000, cast(x'61ff62' as text), null, 1)")
        db.execute("create table void (a int)")
    zoo = spark.read.format("sqlite_table").option("path", path).option("table", "zoo").option("rows_per_task", 100).load()
    assert [(f.name, f.dataType.simpleString()) for f in zoo.schema] == [("id", "bigint"), ("name", "string"), ("the weight", "double"), ("legs", "bigint")]
    assert zoo.count() == 400 and zoo.where("id = 5000").first()[:] == (5000, "ab", None, 1)
    assert zoo.where("legs in (1, 2) and `the weight` > 100").count() == sum(1 for k in range(1, 400) if k % 7 and k % 5 in (1, 2) and k / 2 > 100)
    assert zoo.where("name = 'ab'").count() == 1 and zoo.where("legs is null").count() == 57
    few = spark.read.format("sqlite_table").option("path", path).option("table", "zoo").schema("legs bigint, name string").load()
    assert few.where("legs = 4").count() == sum(1 for k in range(1, 400) if k % 7 and k % 5 == 4)
    assert spark.read.format("sqlite_table").option("path", path).option("table", "void").load().collect() == []
    with pytest.raises(Exception, match="no table"):
        spark.read.format("sqlite_table").option("path", path).option("table", "nothing").load()
