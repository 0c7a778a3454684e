"""Streaming ingest: the batch cleaning chain over files as they arrive, and windowed counts of late-bounded events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graintide.operators.clean import clean_prose
from graintide.sources.readers import DOCUMENT


def stream_documents(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(documents: DataFrame) -> DataFrame:
    """Stateless: the same expressions as in batch, so a restart repeats no decision."""
    return clean_prose(documents)


def write_stream(cleaned: DataFrame, path: str, checkpoint: str):
    """Exactly once to parquet, everything now available."""
    return cleaned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def within_budget(documents: DataFrame, budget: int) -> DataFrame:
    """(source, doc_id, before): documents of each source until its characters reach the budget, the crossing one included.

    The characters so far are kept as state for each source, so that the budget holds over batches and restarts; within
    a batch documents come in the order of their ids. Of a source's rows, which come in parts, only those are held that
    the budget still has room for, so that memory is bounded by what is returned and not by how many a batch brings."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows, before = None, None
        for part in frames:
            if used >= budget:
                continue
            rows = (part if rows is None else pd.concat([rows, part])).sort_values("doc_id", kind="stable")
            before = used + rows["chars"].cumsum() - rows["chars"]
            rows, before = rows[before < budget], before[before < budget]
        if rows is None:
            state.update((int(used),))
            return
        state.update((int(used + rows["chars"].sum()),))
        yield pd.DataFrame({"source": key[0], "doc_id": rows["doc_id"], "before": before})

    sized = documents.select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    # once a source is full its rows are only counted out, so that state stays one number
    return sized.groupBy("source").applyInPandasWithState(take, "source string, doc_id long, before long", "used long", "append", GroupStateTimeout.NoTimeout)
