"""A table by key that micro-batches update in place of whole rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep_last
from . import folders


class UpsertTable:
    """One row for each ``key``: the highest in ``order``. Rows lie in hash buckets; a batch rewrites those it touches only.

    A batch writes its buckets to a folder of its own and then a manifest that names, for every bucket, the batch that
    wrote it last. Readers follow the newest complete manifest, so they see a batch whole or not at all. A replayed batch starts
    from the manifest before it and so changes nothing. Two manifests and what they name are kept.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path, key, order, buckets

    def manifests(self) -> list[int]:
        return folders.numbers(self.spark, f"{self.path}/manifest")

    def places(self, manifest: int) -> dict[int, int]:
        """{bucket: batch}; at most ``buckets`` rows."""
        return {r.bucket: r.batch for r in self.spark.read.parquet(f"{self.path}/manifest/batch={manifest}").collect()}

    def _rows(self, places: dict[int, int], schema=None) -> DataFrame | None:
        paths = [f"{self.path}/data/batch={v}/bucket={b}" for b, v in sorted(places.items())]
        if not paths:
            return None
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(*paths)

    def read(self) -> DataFrame | None:
        found = self.manifests()
        return self._rows(self.places(found[-1])) if found else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        earlier = [v for v in self.manifests() if v < batch_id]
        places = self.places(earlier[-1]) if earlier else {}
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")
        batch = batch.persist()
        try:
            touched = {r.bucket for r in batch.select(bucket).distinct().collect()}  # at most ``buckets``
            rows, old = batch, self._rows({b: v for b, v in places.items() if b in touched}, batch.schema)
            if old is not None:
                rows = old.unionByName(batch)
            merged = keep_last(rows, self.key, self.order).select("*", bucket)
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch_id}")
        finally:
            batch.unpersist()
        places |= {b: batch_id for b in touched}
        self.spark.createDataFrame(sorted(places.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        self._forget(earlier)

    def _forget(self, earlier: list[int]) -> None:
        if not earlier:
            return
        kept = set(self.places(earlier[-1]).items()) | set(self.places(self.manifests()[-1]).items())
        for manifest in earlier[:-1]:
            for b, v in self.places(manifest).items():
                if (b, v) not in kept:
                    folders.remove(self.spark, f"{self.path}/data/batch={v}/bucket={b}")
            folders.remove(self.spark, f"{self.path}/manifest/batch={manifest}")
