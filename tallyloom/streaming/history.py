"""The newest rows of a stream, kept in state: bounded in number and, if asked for, in age."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from . import folders
from .sinks import start_batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: JSON text of all columns; times keep their microseconds.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
ROW, COLUMNS = "at long, id string, payload string", ["at", "id", "payload"]


class Newest(StatefulProcessor):
    """For each key its ``size`` newest rows (at, id, payload), each id once. With ``age`` in microseconds, rows that the
    watermark has left so far behind are evicted, by a timer at the oldest row's end if nothing arrives.

    Each call gives the key's whole list, or one row of nulls for an empty one, so that a table can replace what it holds.
    """

    def __init__(self, size: int, age: int | None):
        self.size, self.age = size, age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getListState("kept", ROW)

    def _settle(self, key: tuple, rows: pd.DataFrame, watermark: int) -> pd.DataFrame:
        rows = rows.sort_values(["at", "id", "payload"], ascending=False).drop_duplicates("id").head(self.size)
        if self.age is not None:
            rows = rows[rows["at"] + self.age > watermark * 1000]
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if len(rows):
                self.handle.registerTimer(int(rows["at"].min() + self.age) // 1000 + 1)
        self.kept.put([(int(a), i, p) for a, i, p in rows[COLUMNS].itertuples(index=False)]) if len(rows) else self.kept.clear()
        out = rows[COLUMNS].astype({"at": "Int64"}) if len(rows) else pd.DataFrame({"at": pd.array([None], "Int64"), "id": [None], "payload": [None]})
        out.insert(0, "part", key[0])
        return out

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.kept.get()] if self.kept.exists() else [], columns=COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self._held()
        for some in rows:  # cut as they come, so no batch is held whole
            kept = pd.concat([kept, some[COLUMNS]]).sort_values(["at", "id", "payload"], ascending=False).drop_duplicates("id").head(self.size)
        yield self._settle(key, kept, timerValues.getCurrentWatermarkInMs() if self.age is not None else 0)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._settle(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class HistoryTable:
    """The ``size`` newest rows of a stream, with eviction in keyed state and one small table for each batch.

    Rows are dealt to ``parts`` keys by id, so no task holds more than its keys' lists; the newest rows overall are among the newest
    of the parts. A batch's table holds the lists it has changed and, of the table before, the others; a replay writes it again.
    """

    def __init__(self, spark: SparkSession, path: str, size: int = 1000, age: str | None = None, parts: int = 16, delay: str = "1 hour"):
        self.spark, self.path, self.size, self.parts, self.delay = spark, path, size, parts, delay
        self.age = None if age is None else int(pd.Timedelta(age).total_seconds() * 1e6)
        self.schema = None

    def start(self, stream: DataFrame, every: str | None = None) -> StreamingQuery:
        """``stream`` has timestamp and transaction_id; all its columns are kept."""
        self.schema = stream.schema
        rows = (stream.withWatermark("timestamp", self.delay)
                .select(F.pmod(F.xxhash64("transaction_id"), F.lit(self.parts)).cast("int").alias("part"), "timestamp", F.unix_micros("timestamp").alias("at"),
                        F.col("transaction_id").alias("id"), F.to_json(F.struct(*stream.columns), JSON).alias("payload")))
        lists = rows.groupBy("part").transformWithStateInPandas(Newest(self.size, self.age), f"part int, {ROW}", "Update", "None" if self.age is None else "EventTime")
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKS)  # several states and timers need it
        try:
            return start_batches(lists, self, f"{self.path}/checkpoint", every)
        finally:
            self.spark.conf.set(PROVIDER, before)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        earlier = [v for v in folders.numbers(self.spark, f"{self.path}/table") if v < batch_id]
        fresh = f"{self.path}/fresh/batch={batch_id}"
        batch.write.mode("overwrite").parquet(fresh)  # state is read once for each batch
        rows = self.spark.read.parquet(fresh)
        if earlier:
            old = self.spark.read.parquet(f"{self.path}/table/batch={earlier[-1]}")
            rows = old.join(F.broadcast(rows.select("part").distinct()), "part", "left_anti").select(*rows.columns).unionByName(rows)  # ``parts`` rows
        rows.where("id is not null").write.mode("overwrite").parquet(f"{self.path}/table/batch={batch_id}")
        folders.remove(self.spark, fresh)
        for v in earlier[:-1]:
            folders.remove(self.spark, f"{self.path}/table/batch={v}")

    def read(self, schema=None) -> DataFrame | None:
        """The newest rows with the stream's columns; None before the first batch. ``schema``: the stream's, after a restart."""
        found = folders.numbers(self.spark, f"{self.path}/table")
        if not found:
            return None
        rows = self.spark.read.schema(f"part int, {ROW}").parquet(f"{self.path}/table/batch={found[-1]}")
        newest = rows.orderBy(F.desc("at"), F.desc("id")).limit(self.size)
        return newest.select(F.from_json("payload", schema or self.schema, JSON).alias("r")).select("r.*")
