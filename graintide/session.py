"""Session construction and the scratch folder shared by driver and executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH: list[str] = []
#: What is staged goes to a folder of this process, so that it can be deleted at once.
_RUN = uuid.uuid4().hex
#: Paths staged for the result that is being made, if any.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graintide")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="graintide-"))
    return _OWN_SCRATCH[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/graintide/run-{_RUN}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this process has staged; results that are still read need it, so call it once they are written."""
    discard(spark, f"{shared_dir(spark)}/graintide/run-{_RUN}")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that survive lost executors."""
    path = fresh_path(df.sparkSession, label)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What make() returns, staged; all that it staged on the way is deleted once the result is written."""
    passing: list[str] = []
    outer = _PASSING.set(passing)
    try:
        made = make()
        _PASSING.reset(outer)
        outer = None
        return staged(made, label)
    finally:
        if outer is not None:
            _PASSING.reset(outer)
        for path in passing:
            discard(spark, path)


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where, store = _store(spark, path)
    store.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _store(spark, path)
    return store.exists(where)


#: Bytes of such a batch.
BATCH_BYTES = "16m"


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the Arrow batches that Python workers hold, since one text can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")


#: Bytes of a small input, by Spark's estimate.
SMALL_INPUT = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores whatever their size: for short rows of which each takes long, and that a few row groups hold."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark)))


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt over all cores, since a file of one row group is read by one task; a large one as it is."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
