"""Running streaming queries and writing their results."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..session import fresh_path

log = logging.getLogger(__name__)
Handler = Callable[[DataFrame, int], None]


def start_append(stream: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to Parquet; with ``every`` on a timer, else over what is there now."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", out).option("checkpointLocation", checkpoint))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Drain a finite source and return what the sink holds."""
    spark = stream.sparkSession
    base = fresh_path(spark, label)
    start_append(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class Callbacks:
    """Handlers called with every micro-batch; one that fails does not stop the others."""

    def __init__(self):
        self.handlers: list[Handler] = []

    def add(self, handler: Handler) -> None:
        self.handlers.append(handler)

    def remove(self, handler: Handler) -> None:
        if handler in self.handlers:
            self.handlers.remove(handler)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        for handler in list(self.handlers):
            try:
                handler(batch, batch_id)
            except Exception:
                log.exception("handler failed on batch %s", batch_id)


def start_batches(stream: DataFrame, handler: Handler, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call ``handler`` with every micro-batch.

    Give a table sink directly: its failure must fail the batch, so that Spark repeats it. Wrap
    handlers whose failure may be ignored in ``Callbacks``.
    """
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class LatestTable:
    """A bounded table of the newest ``size`` rows, rewritten per micro-batch.

    Every batch writes its own version, so a replayed batch overwrites itself and nothing else.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = 10_000):
        self.spark, self.path, self.size = spark, path, size

    def versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("batch="))

    def read(self, version: int | None = None) -> DataFrame | None:
        found = self.versions()
        if not found:
            return None
        return self.spark.read.parquet(f"{self.path}/batch={found[-1] if version is None else version}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        earlier = [v for v in self.versions() if v < batch_id]
        rows = batch
        if earlier:
            rows = self.read(earlier[-1]).unionByName(batch)
        newest = rows.orderBy(F.desc("timestamp"), F.desc("transaction_id")).limit(self.size)
        newest.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.forget(earlier[:-1])

    def forget(self, versions: list[int]) -> None:
        """Remove versions that neither readers nor a replay of the newest batch need."""
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for v in versions:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={v}"), True)


class LateSplitter:
    """Sends rows older than the watermark of earlier batches to a side table.

    The newest event time of each batch is kept beside the tables, so a restart remembers it.
    """

    def __init__(self, spark: SparkSession, path: str, delay: str = "1 hour"):
        self.spark, self.path, self.delay = spark, path, delay
        self.progress = LatestTable(spark, f"{path}/progress")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        earlier = [v for v in self.progress.versions() if v < batch_id]
        seen = self.progress.read(earlier[-1]).first()["seen"] if earlier else None
        late = F.lit(False) if seen is None else (
            F.col("timestamp") < F.lit(str(seen)).cast("timestamp") - F.expr(f"INTERVAL {self.delay}"))
        batch = batch.persist()
        try:
            batch.filter(~late).write.mode("overwrite").parquet(f"{self.path}/on_time/batch={batch_id}")
            batch.filter(late).write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
            newest = batch.agg(F.greatest(F.max("timestamp"), F.lit(str(seen) if seen else None).cast("timestamp")).alias("seen"))
            newest.write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch_id}")
            self.progress.forget(earlier[:-1])
        finally:
            batch.unpersist()

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}").drop("batch")


class Counters(StreamingQueryListener):
    """Running sums over every progress report of every query: three numbers a query, however many batches it has.

    Register with ``spark.streams.addListener`` before the queries start. Reports of a query's own
    recent list are not enough, since Spark keeps only the newest of them.
    """

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.first: dict[str, datetime] = {}
        self.last: dict[str, datetime] = {}
        self.batch: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report, key = event.progress, str(event.progress.id)
        at = datetime.fromisoformat(report.timestamp.replace("Z", "+00:00"))
        self.rows[key] = self.rows.get(key, 0) + report.numInputRows
        self.first.setdefault(key, at)
        self.last[key], self.batch[key] = at, report.batchId

    def wait(self, query: StreamingQuery, seconds: float = 30.0) -> None:
        """Until the newest report of ``query`` has arrived; reports come on a thread of their own."""
        newest, until = query.lastProgress, time.monotonic() + seconds
        while newest and self.batch.get(str(query.id), -1) < newest["batchId"] and time.monotonic() < until:
            time.sleep(0.05)


def stream_stats(query: StreamingQuery, spark: SparkSession, counters: Counters, latest: DataFrame | None = None,
                 size: int = 10_000, history: DataFrame | None = None) -> DataFrame:
    """One row: running, buffered rows, total rows seen, rows per minute, rows of history."""
    counters.wait(query)
    key = str(query.id)
    span = (counters.last[key] - counters.first[key]).total_seconds() if key in counters.first else 0.0
    out, seconds = spark.range(1).select(F.lit(counters.rows.get(key, 0)).cast("bigint").alias("total")), F.lit(max(1.0, span))
    buffered = latest.agg(F.count(F.lit(1))).scalar() if latest is not None else F.lit(0)
    past = history.agg(F.count(F.lit(1))).scalar() if history is not None else F.lit(0)
    return out.select(F.lit(query.isActive).alias("running"), buffered.cast("bigint").alias("buffer_size"),
                      F.lit(size).alias("max_buffer_size"), "total",
                      (F.col("total") / seconds * 60.0).alias("transactions_per_minute"),
                      past.cast("bigint").alias("historical_records"),
                      (past + buffered).cast("bigint").alias("total_available"))


def start_refresh(stream: DataFrame, refresh: Handler, checkpoint: str, every: str = "120 seconds") -> StreamingQuery:
    """Recompute a result table on a timer while rows arrive, for example the insights."""
    return (stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).start())
