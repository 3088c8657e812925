"""How long the batches of a stream take and how many rows they bring, as a table."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "batch long, rows_in long, rows_out long, latency_ms long, state_rows long"


class Progress(StreamingQueryListener):
    """Keeps a row a batch of one query, by its name."""

    def __init__(self, name: str):
        self.name, self.rows, self.run, self.ended = name, {}, None, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name:
            seen = (p.observedMetrics or {}).get(self.name)
            state = sum(s.numRowsTotal for s in p.stateOperators or [])
            self.rows[p.batchId] = (p.batchId, p.numInputRows, seen["rows_out"] if seen else 0, int(p.durationMs.get("triggerExecution", 0)), state)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.runId == self.run:
            self.ended.set()


def drain_measured(stream: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Run a stream over all that is there: what it wrote, and (batch, rows_in, rows_out, latency_ms, state_rows)."""
    spark: SparkSession = stream.sparkSession
    name, path = f"drain_{uuid.uuid4().hex}", f"{folder}/{uuid.uuid4().hex}"
    progress = Progress(name)
    spark.streams.addListener(progress)
    try:
        counted = stream.observe(name, F.count(F.lit(1)).alias("rows_out"))
        query = counted.writeStream.queryName(name).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start()
        query.awaitTermination()
        if not progress.ended.wait(60):
            raise TimeoutError("the stream's last progress did not come")
    finally:
        spark.streams.removeListener(progress)
    rows = [r for _, r in sorted(progress.rows.items()) if r[1] or r[2]]  # an idle last batch brings nothing
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), spark.createDataFrame(rows, SCHEMA)


def latency(batches: DataFrame) -> DataFrame:
    """One row: batches, rows in and out, latency of a batch at three percentiles, rows a second."""
    p50, p95, p99 = (F.percentile("latency_ms", F.lit(q)) for q in (0.5, 0.95, 0.99))  # a row a batch
    return batches.agg(
        F.count("*").alias("batches"), F.sum("rows_in").alias("rows_in"), F.sum("rows_out").alias("rows_out"), p50.alias("p50_ms"), p95.alias("p95_ms"), p99.alias("p99_ms"),
        F.try_divide(1000.0 * F.sum("rows_in"), F.sum("latency_ms")).alias("rows_per_s"),
    )
