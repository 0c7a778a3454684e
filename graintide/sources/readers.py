"""Sources and sinks: explicit schemas, partitioned output, blob decoding, pipe tables, reports."""

from __future__ import annotations

import codecs
import gzip
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The first bytes of a gzip file.
GZIP = b"\x1f\x8b"
DOCUMENT = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def read_parquet(spark: SparkSession, *paths: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def read_jsonl(spark: SparkSession, *paths: str, schema: str = "text STRING") -> DataFrame:
    return spark.read.schema(schema).json(list(paths))


def read_sources(spark: SparkSession, paths: dict[str, str], text_fields: dict[str, str]) -> DataFrame:
    """The text field of each source, null as empty, with the source's name."""
    frames = [spark.read.parquet(p).select(F.lit(name).alias("source"), F.coalesce(F.col(text_fields.get(name, "text")), F.lit("")).alias("text")) for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy("source").format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def accept_code_row(min_score: int = 3, license_type: str = "permissive", low: int = 200, high: int = 100_000) -> Column:
    """A predicate that reaches the parquet scan; both bounds are inclusive, a missing score is 0."""
    return (F.col("license_type") == license_type) & (F.coalesce("int_score", F.lit(0)) >= min_score) & F.col("length_bytes").between(low, high)


def decode_text(raw: bytes | None, encoding: str | None) -> str:
    """gunzip where needed, then the recorded encoding, or UTF-8 for none or one that isn't known; errors are ignored."""
    data = raw or b""
    if data.startswith(GZIP):
        data = gzip.decompress(data)
    try:
        codec = codecs.lookup(encoding or "utf-8")
    except LookupError:
        codec = codecs.lookup("utf-8")
    return data.decode(codec.name, "ignore")


def decoded(raw: Column, encoding: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def decode(raws: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([decode_text(r, e) for r, e in zip(raws, encodings, strict=True)])

    return decode(raw, encoding)


def fetch_blobs(rows: DataFrame, fetch: Callable[[str], bytes | None], threads: int = 64, tries: int = 3, pause_s: float = 0.2) -> DataFrame:
    """(blob_id, raw, status): a thread pool in each partition; a blob is tried some times, ever later, and a failure is a status, not an exception."""

    def one(blob: str) -> tuple[bytes | None, str]:
        status = "missing"
        for attempt in range(tries):
            try:
                raw = fetch(blob)
                return raw, "missing" if raw is None else "ok"
            except Exception as why:  # isolated per blob
                status = f"error:{type(why).__name__}"
                if attempt + 1 < tries:
                    time.sleep(pause_s * 2**attempt)
        return None, status

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(threads) as pool:
            for pdf in frames:
                got = list(pool.map(one, pdf["blob_id"]))
                yield pd.DataFrame({"blob_id": pdf["blob_id"], "raw": [g[0] for g in got], "status": [g[1] for g in got]})

    return rows.select("blob_id").mapInPandas(run, "blob_id string, raw binary, status string")


def fetch_summary(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("bytes"))


def pipe_rows(text: Column, columns: int) -> Column:
    """Rows of a pipe table as arrays of cells; ragged rows are dropped."""
    rows = F.transform(F.filter(F.split(text, "\n"), lambda r: F.trim(r) != ""), lambda r: F.transform(F.split(r, r"\|"), F.trim))
    return F.filter(rows, lambda r: F.size(r) == columns)


def csv_files(text: Column) -> Column:
    """Parts of a text that holds several CSV files under `--- name.csv` lines, as name and body."""
    parts = F.regexp_extract_all(text, F.lit(r"(?ms)^--- (\S+\.csv)[ \t]*\n(.*?)(?=^--- \S+\.csv|\z)"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^--- (\S+)", 1).alias("name"), F.regexp_replace(p, r"^--- \S+[ \t]*\n", "").alias("body")))


def shards(spark: SparkSession, folder: str, suffix: str = ".parquet") -> list[str]:
    """The files of a folder and its folders, in the order of their names, from whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found, listed = [], where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if name.endswith(suffix):
            found.append(name)
    return sorted(found)


def dataset_path(root: str, dataset: str, config: str = "default", split: str = "train") -> str:
    """Where a dataset's split lies: root/owner/name/config/split."""
    return "/".join([root.rstrip("/"), *dataset.split("/"), config, split])


def row_count(spark: SparkSession, path: str) -> int | None:
    """Rows of a table, from the footers of its files; None where there is no such table."""
    try:
        return spark.read.parquet(path).count()
    except Exception:  # an unknown count is a value
        return None


def read_indexed_jsonl(spark: SparkSession, path: str, schema: str = "text STRING") -> DataFrame:
    """Lines of JSON with `file` and `idx`, the place of a line in its file.

    A file's lines come in order in its splits, so that its rows are counted by split and then within each."""
    from pyspark.sql import Window as W

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_k"))
    sizes = lines.groupBy("file", "_start").agg(F.count("*").alias("_n"))
    bases = sizes.select("file", "_start", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    here = F.row_number().over(W.partitionBy("file", "_start").orderBy("_k")) - 1
    placed = lines.withColumn("_here", here).join(bases, ["file", "_start"])
    return placed.select("file", (F.col("_base") + F.col("_here")).alias("idx"), F.from_json("value", schema).alias("_r")).select("file", "idx", "_r.*")


#: Bins of an index; only the one in which a limit falls is put in order.
INDEX_BINS = 1 << 16


def fetch_plan(rows: DataFrame, worker: int, workers: int, limit: int | None = None, index: str = "idx") -> DataFrame:
    """What one of some workers owns of the rows, by their index, and no more than a limit of it."""
    if not 0 <= worker < workers:
        raise ValueError("worker must be one of the workers")
    mine = rows.where(F.pmod(F.col(index), F.lit(workers)) == worker)
    if limit is None:
        return mine
    low, high = mine.agg(F.min(index), F.max(index)).first()
    step = ((high or 0) - (low or 0)) // INDEX_BINS + 1
    bin_ = F.floor((F.col(index) - (low or 0)) / step)
    before, cut = 0, INDEX_BINS
    for n, rows_there in sorted(tuple(r) for r in mine.groupBy(bin_.alias("bin")).count().collect()):  # INDEX_BINS rows at most
        if before + rows_there > limit:
            cut = n
            break
        before += rows_there
    # only the bin in which the limit falls is put in order
    return mine.where(bin_ < cut).unionByName(mine.where(bin_ == cut).orderBy(index).limit(limit - before))


def accept_for_fetch(min_score: int = 4) -> Column:
    """Rows of a fetch trial: a high score, and a blob to fetch."""
    return (F.coalesce("int_score", F.lit(0)) >= min_score) & F.col("blob_id").isNotNull()


def sqlite_schema(path: str) -> str:
    """The CREATE TABLE statements of a SQLite file, in the order of the tables' names, each with its semicolon."""
    with open_sqlite(path) as db:
        made = db.execute("select name, sql from sqlite_master where type = 'table' and sql is not null order by name").fetchall()
    return "\n".join(sql.strip().rstrip(";") + ";" for name, sql in made if not name.startswith("sqlite_"))


def open_sqlite(path: str):
    import contextlib
    import sqlite3

    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.text_factory = lambda raw: raw.decode("utf-8", errors="ignore")
    return contextlib.closing(db)


def sqlite_columns(db, name: str) -> list[tuple[str, str]]:
    """(column, type) of a table by the affinity of what its columns were declared as."""
    kinds = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "NUME": "double", "DECI": "double"}
    columns = [(c[1], kinds.get((c[2] or "")[:4].upper(), "bigint" if "INT" in (c[2] or "").upper() else "string")) for c in db.execute(f'pragma table_info("{name}")')]
    if not columns:
        raise ValueError(f"no table {name}")
    return columns


def read_sqlite(spark: SparkSession, path: str, name: str, rows_per_task: int = 100_000) -> DataFrame:
    """A table of a SQLite file that all executors can open, read-only, in ranges of row numbers; bytes that aren't UTF-8 are left out."""
    with open_sqlite(path) as db:
        columns = sqlite_columns(db, name)
        low, high = db.execute(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{name}"').fetchone()
    casts = {"bigint": "Int64", "double": "Float64", "string": "string"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in pdf["id"]:
                with open_sqlite(path) as db:
                    found = db.execute(f'select * from "{name}" where rowid >= ? and rowid < ? order by rowid', (int(start), int(start) + rows_per_task)).fetchall()
                yield pd.DataFrame({c: pd.Series([r[k] for r in found], dtype=casts[kind]) for k, (c, kind) in enumerate(columns)})

    return spark.range(low, high + 1, rows_per_task).mapInPandas(run, ", ".join(f"`{c}` {kind}" for c, kind in columns))


def typed_cells(rows: Column) -> Column:
    """Cells of a pipe table with what they are as a number, null where they aren't one."""
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.struct(c.alias("text"), c.try_cast("double").alias("number"))))


def headers_of(files: Column) -> Column:
    """One line for each CSV of a text with several: its name and its columns."""
    return F.array_join(F.transform(files, lambda f: F.concat(f["name"], F.lit(": "), F.regexp_replace(F.regexp_extract(f["body"], r"^([^\n]*)", 1), ",", ", "))), "\n")
