"""Structured Streaming from landed scans to the server's table, each scan once."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

#: State by key on executors' disks, checkpointed by its changes: a batch's work goes by the batch, not by what came before.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def landed(spark: SparkSession, folder: str, schema: str | StructType, glob: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drained(stream: DataFrame, target: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Start writing unsynced rows (id, created_at, …) to target, each id once, however late it lands.

    The checkpoint replaces a synced flag. Ids that were written are keyed state, so a batch neither reads
    nor counts on the rows of earlier ones; which of several rows of an id goes first is the batch's
    choice. A batch that failed is written again under the same number, into the same folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings that it began with
        writer = stream.where("not synced").dropDuplicates(["id"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.queryName(name) if name else writer).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def upload_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events of each kind by window, as a stream with late rows up to the delay."""
    return stream.withWatermark("created_at", delay).groupBy(F.window("created_at", window), "kind").agg(F.count("*").alias("n"))


class Progress(StreamingQueryListener):
    """Rows on how a session's streams get on: a row for the start, each stage of each batch, and the end.

    spark.streams.addListener(p) begins it. The rows wait in the driver, a few a batch, until write()
    appends them to a table; it may be called at any time and writes each row once.
    """

    SCHEMA = "query string, name string, batch long, stage string, ms long, n_rows long, state_rows long, error string"

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.names: dict[str, str | None] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self.lock:
            self.names[str(event.id)] = event.name
            self.rows.append((str(event.id), event.name, None, "started", 0, 0, 0, None))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        kept = sum(s.numRowsTotal for s in p.stateOperators)
        with self.lock:
            self.rows += [(str(p.id), p.name, p.batchId, stage, ms, p.numInputRows, kept, None) for stage, ms in sorted(p.durationMs.items())]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.lock:
            self.rows.append((str(event.id), self.names.get(str(event.id)), None, "failed" if event.exception else "ended", 0, 0, 0, event.exception))

    def settled(self, query: StreamingQuery, seconds: float = 30.0) -> bool:
        """Wait, as events come a little after what they tell of, until the query's last batch and its end have been heard of."""
        last = query.lastProgress.batchId if query.lastProgress else None
        end = time.monotonic() + seconds
        while time.monotonic() < end:
            with self.lock:
                own = [r for r in self.rows if r[0] == str(query.id)]
            if any(r[3] in ("ended", "failed") for r in own) and (last is None or any(r[2] == last for r in own)):
                return True
            time.sleep(0.05)
        return False

    def write(self, spark: SparkSession, table: str) -> int:
        """How many rows were appended to the table (a path)."""
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(table)
        return len(rows)
