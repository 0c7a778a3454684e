"""Packed windows of token ids as raw files of unsigned 16-bit numbers: a sink, a scan by window, and an inspector."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LIMIT = 1 << 16


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def write_windows(windows: DataFrame, folder: str, by: str = "source", split: str = "split", order: str = "window_id", per_file: int = 1 << 16) -> DataFrame:
    """(split, source, file, windows) of the files written: one for each source, split and per_file numbers of windows, in their order.

    A source that holds most windows is thus written by many tasks.
    Names are fresh in every attempt, and only files of successful tasks are reported, so that a lost executor leaves at
    most files that nothing reads. An id that 16 bits don't hold fails the job."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, n, uri = None, None, 0, ""
        done: list[tuple] = []
        for batch in batches:
            for group, part, place, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, group, place) != at:
                    if out is not None:
                        out.close()
                        done.append((*at[:2], uri, n))
                    at, n, uri = (part, group, place), 0, f"{folder}/{part}/{group}-{uuid.uuid4().hex}.bin"
                    out = _open(uri, "w")
                if max(ids, default=0) >= LIMIT:
                    raise ValueError(f"a token id doesn't fit 16 bits: {max(ids)}")
                out.write(np.asarray(ids, "<u2").tobytes())
                n += 1
        if out is not None:
            out.close()
            done.append((*at[:2], uri, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], names=["split", "source", "file", "windows"])

    rows = windows.select(F.col(by).cast("string").alias("source"), F.col(split).alias("split"), F.floor(F.col(order) / per_file).alias("_f"), F.col("ids").cast("array<int>").alias("ids"), F.col(order).alias("_o"))
    dealt = rows.repartition("source", "split", "_f").sortWithinPartitions("split", "source", "_f", "_o").drop("_o")
    return dealt.mapInArrow(write, "split string, source string, file string, windows long")


def read_windows(files: DataFrame, width: int, picks: DataFrame | None = None) -> DataFrame:
    """(file, window, ids) of whole files, or of the picked (file, window) alone, each read at its place."""
    every = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)).alias("window")) if picks is None else picks.select("file", F.col("window").cast("long").alias("window"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, name = None, ""
        for batch in batches:
            found = []
            for uri, window in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if uri != name:
                    opened, name = _open(uri, "r"), uri
                raw = opened.read_at(2 * width, 2 * width * window)
                if len(raw) != 2 * width:
                    raise ValueError(f"{uri} has no window {window}")
                found.append(np.frombuffer(raw, "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["file", "window", "ids"])

    return every.sortWithinPartitions("file", "window").mapInArrow(read, "file string, window long, ids array<int>")


def inspect(windows: DataFrame, width: int, end_id: int) -> DataFrame:
    """Per file: windows, whether all have their size, the largest id and how many end ids the first window has."""
    return windows.groupBy("file").agg(
        F.count("*").alias("windows"), F.bool_and(F.size("ids") == width).alias("size_matches"), F.max(F.array_max("ids")).cast("long").alias("max_id"),
        F.min_by(F.size(F.filter("ids", lambda i: i == end_id)), "window").cast("long").alias("first_ends"))


def first_windows(windows: DataFrame, per_source: int = 32, by: str = "source", order: str = "window_id") -> DataFrame:
    """The first windows of each source."""
    return windows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(order))).where(F.col("_r") <= per_source).drop("_r")


def file_order(spark: SparkSession, paths: list[str], sources: list[str]) -> DataFrame:
    """(source, file, place): files in the order of their sources and then of their names; the source is the folder's name."""
    rows = spark.createDataFrame([(p,) for p in paths], "file string").withColumn("source", F.element_at(F.split("file", "/"), -2))
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    return rows.where(rank > 0).withColumn("place", F.row_number().over(W.orderBy(rank, "file"))).select("source", "file", "place")
