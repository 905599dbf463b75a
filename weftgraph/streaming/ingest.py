"""Edges as streams: ingest into a stored graph, windowed counts, continuous recomputation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.sources.store import GraphStore


def edge_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream; the limit of files a trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, store: GraphStore, given: list[str], checkpoint: str, after: Callable[[GraphStore, int], None] | None = None, compact_share: float = 0.25) -> StreamingQuery:
    """Append each micro-batch to the store; its edges are visible once the batch is committed.

    A batch is known by its number and the checkpoint folder: one that is replayed after a
    failure is not added again. ``after`` runs behind each batch (continuous
    computation); deleted edges beyond ``compact_share`` trigger compaction. Ends once
    the source is drained.
    """
    source = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]

    def commit(batch: DataFrame, batch_id: int) -> None:
        store.add_edges(batch, given, batch=f"{source}-{batch_id}")
        if store.deleted_share() > compact_share:
            store.compact()
        if after is not None:
            after(store, batch_id)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """(start, keys, n): events by window of event time; later ones than ``late`` are dropped by the watermark."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into an in-memory table; for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
