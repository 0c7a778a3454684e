"""Data sources for spark.read.format: raw token files ("token_windows") and tables of a SQLite file ("sqlite_table").

Both plan their partitions from metadata alone, take filters into the reading and read only the columns of the schema
that was given to the reader. Call register(spark) once a session."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from graintide.sources.readers import open_sqlite, sqlite_columns

#: Bytes of token ids that a task reads, and that a batch holds.
TASK_BYTES, BATCH_BYTES = 128 << 20, 8 << 20
#: Files that one task reads at most, however small they are.
TASK_FILES = 1_000


def register(spark: SparkSession) -> None:
    """Make both formats known, and let Spark hand filters to them."""
    for source in (TokenWindows, SqliteTable):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class Bounds:
    """Whole numbers that a column may have: from low up to, not including, high, and of a set if there is one."""

    low: int = 0
    high: int = 1 << 62
    chosen: frozenset[int] | None = None

    def take(self, f: D.Filter) -> bool:
        """Whether the filter is one that bounds can hold; if so they hold it."""
        match f:
            case D.EqualTo(value=int(v)):
                self._choose({v})
            case D.In(value=vs) if all(isinstance(v, int) for v in vs):
                self._choose(set(vs))
            case D.GreaterThan(value=int(v)):
                self.low = max(self.low, v + 1)
            case D.GreaterThanOrEqual(value=int(v)):
                self.low = max(self.low, v)
            case D.LessThan(value=int(v)):
                self.high = min(self.high, v)
            case D.LessThanOrEqual(value=int(v)):
                self.high = min(self.high, v + 1)
            case D.IsNotNull():
                pass
            case _:
                return False
        return True

    def _choose(self, values: set[int]) -> None:
        self.chosen = frozenset(values if self.chosen is None else self.chosen & values)

    def runs(self, size: int) -> Iterator[tuple[int, int]]:
        """The runs (start, stop) of numbers below size that are within the bounds."""
        low, high = self.low, min(self.high, size)
        if self.chosen is None:
            if low < high:
                yield low, high
            return
        picked = np.array(sorted(v for v in self.chosen if low <= v < high), np.int64)
        for run in np.split(picked, np.flatnonzero(np.diff(picked) > 1) + 1):
            if len(run):
                yield int(run[0]), int(run[-1]) + 1


@dataclass
class Spans(D.InputPartition):
    """Runs of windows that a task reads: (file, start, stop)."""

    parts: list[tuple[str, int, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


class TokenWindows(D.DataSource):
    """file, window, ids of raw files of unsigned 16-bit numbers under a folder.

    Options: width (ids in a window, needed), suffix (.bin), task_bytes. A file whose size isn't a multiple of a window
    fails the plan. Filters on file (equality, IN) and window (comparisons, IN) decide what is read; without ids in the
    schema no file is opened at all."""

    @classmethod
    def name(cls) -> str:
        return "token_windows"

    def schema(self) -> str:
        return "file string, window long, ids array<int>"

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return WindowReader(self.options, schema.names)


class WindowReader(D.DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.width = int(options.get("width", 0))
        if self.width < 1:
            raise ValueError("option width must say how many ids a window has")
        if unknown := set(columns) - {"file", "window", "ids"}:
            raise ValueError(f"there is no column {sorted(unknown)[0]}")
        self.folders = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.suffix, self.columns = options.get("suffix", ".bin"), columns
        self.per_task = max(1, int(options.get("task_bytes", TASK_BYTES)) // (2 * self.width))
        self.windows, self.files = Bounds(), None

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("window",) and self.windows.take(f) or column == ("file",) and isinstance(f, D.IsNotNull):
                continue
            if column == ("file",) and isinstance(f, D.EqualTo | D.In):
                named = set(f.value) if isinstance(f, D.In) else {f.value}
                self.files = named if self.files is None else self.files & named
                continue
            yield f

    def partitions(self) -> list[Spans]:
        """Windows in the order of their files, so many a task; small files share one."""
        tasks: list[list[tuple[str, int, int]]] = [[]]
        room = self.per_task
        for uri, size in self._listed():
            if size % (2 * self.width):
                raise ValueError(f"{uri} has {size} bytes, which isn't a number of windows of {self.width} ids")
            for start, stop in self.windows.runs(size // (2 * self.width)):
                while start < stop:
                    if room == 0 or len(tasks[-1]) >= TASK_FILES:
                        tasks.append([])
                        room = self.per_task
                    n = min(room, stop - start)
                    tasks[-1].append((uri, start, start + n))
                    start, room = start + n, room - n
        return [Spans(t) for t in tasks]

    def _listed(self) -> Iterator[tuple[str, int]]:
        from pyarrow import fs

        for folder in self.folders:
            system, path = fs.FileSystem.from_uri(folder.rstrip("/"))
            prefix = folder.rstrip("/").removesuffix(path)  # names are written as the folder's is, with its store or without
            for info in sorted(system.get_file_info(fs.FileSelector(path, recursive=True)), key=lambda i: i.path):
                uri = prefix + info.path
                if info.is_file and info.path.endswith(self.suffix) and (self.files is None or uri in self.files):
                    yield uri, info.size

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        step = max(1, BATCH_BYTES // (2 * self.width))
        for uri, start, stop in partition.parts:
            source = None
            if "ids" in self.columns:
                system, path = fs.FileSystem.from_uri(uri)
                source = system.open_input_file(path)
            for at in range(start, stop, step):
                n = min(step, stop - at)
                made = {"file": pa.array([uri] * n), "window": pa.array(np.arange(at, at + n, dtype=np.int64))} if source is None or len(self.columns) > 1 else {}
                if source is not None:
                    raw = source.read_at(2 * self.width * n, 2 * self.width * at)
                    flat = pa.array(np.frombuffer(raw, "<u2").astype(np.int32))
                    made["ids"] = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * self.width, flat)
                yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], names=self.columns)
            if source is not None:
                source.close()


@dataclass
class RowRange(D.InputPartition):
    low: int
    high: int

    def __post_init__(self) -> None:
        super().__init__(None)


class SqliteTable(D.DataSource):
    """A table of a SQLite file that all executors can open, read-only, in ranges of row numbers.

    Options: path, table, rows_per_task. Comparisons of number columns become conditions of the statement; those of text
    stay with Spark, since bytes that aren't UTF-8 are left out of what it sees."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with open_sqlite(self.options["path"]) as db:
            return ", ".join(f"`{c}` {kind}" for c, kind in sqlite_columns(db, self.options["table"]))

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return SqliteReader(self.options, schema)


class SqliteReader(D.DataSourceReader):
    ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.table, self.step = options["path"], options["table"], int(options.get("rows_per_task", 100_000))
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        signs = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
        kinds = dict(self.columns)
        for f in filters:
            column = getattr(f, "attribute", ("", ""))
            values = list(f.value) if isinstance(f, D.In) else [getattr(f, "value", None)]
            number = len(column) == 1 and kinds.get(column[0]) in ("bigint", "double") and all(isinstance(v, int | float) and v == v for v in values)
            if number and isinstance(f, D.In):
                self.conditions.append((f"{quoted(column[0])} in ({', '.join('?' * len(values))})", values))
            elif number and type(f) in signs:
                self.conditions.append((f"{quoted(column[0])} {signs[type(f)]} ?", values))
            else:
                yield f

    def partitions(self) -> list[RowRange]:
        with open_sqlite(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        return [RowRange(at, min(at + self.step, high + 1)) for at in range(low, high + 1, self.step)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        where = " and ".join(["rowid >= ? and rowid < ?", *(sql for sql, _ in self.conditions)])
        values = [partition.low, partition.high, *(v for _, vs in self.conditions for v in vs)]
        schema = pa.schema([(name, self.ARROW[kind]) for name, kind in self.columns])
        listed = ", ".join(quoted(name) for name, _ in self.columns) or "1"
        with open_sqlite(self.path) as db:
            rows = db.execute(f"select {listed} from {quoted(self.table)} where {where} order by rowid", values)
            while batch := rows.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in batch], field.type) for k, field in enumerate(schema)], schema=schema)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
