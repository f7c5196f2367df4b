"""Incremental loads: files as a stream, applied to a Type-2 dimension batch by batch, each at most once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import scd2
from tessera.sources.store import Manifest, Store


def arrivals(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def unique_events(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Events once each, though they may be delivered again within a delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows of event time (an extra; no source query has one)."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


PART = "bucket-"


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The dimension as of the last load, or of an earlier version that is kept; None before the first."""
    store = Store(spark, path)
    manifest = store.head() if version is None else store.manifest(version)
    return _frame(store, manifest, sorted(manifest.tables))


def _frame(store: Store, manifest: Manifest, names: list[str]) -> DataFrame | None:
    parts = [manifest.tables[n] for n in names if n in manifest.tables]
    return store.frame(parts[-1] | {"paths": [p for t in parts for p in t["paths"]]}) if parts else None


def load_dimension(stream: DataFrame, path: str, checkpoint: str, key: str, empty: DataFrame, prepare, now: Column | None = None, buckets: int = 64, keep: int = 3):
    """Apply each batch of a stream to the dimension under path. prepare(batch) gives staged rows, the latest of each key; now stands in for times that these lack (the clock if None).

    Keys are dealt into buckets by hash, their number fixed for a path. A batch reads and writes only the buckets of its keys; the folders that it wrote and its number
    are committed together, so a batch that comes again changes nothing,
    and readers see all of a batch or none. Batches are numbered by checkpoint: a stream that starts anew is applied anew, which leaves history that it repeats as it is.
    An empty batch does nothing. The newest `keep` versions stay."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    mark = f"batch of {checkpoint}"

    def run(batch: DataFrame, number: int) -> None:
        store = Store(batch.sparkSession, path)
        head = store.head()
        if int(head.marks.get(mark, "-1")) >= number:
            return
        staged = prepare(batch).persist()
        try:
            touched = sorted(r.b for r in staged.select(bucket.alias("b")).distinct().collect())  # at most `buckets` rows
            if touched:
                before = _frame(store, head, [f"{PART}{b}" for b in touched])
                after = scd2.apply(empty if before is None else before, staged, key, F.current_timestamp() if now is None else now)
                name = store.begin()
                target = f"{store.root}/data/dimension/{name}"
                after.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
                written = [int(n.partition("=")[2]) for n in store.files.names(target) if n.startswith("bucket=")]
                schema = json.dumps(after.schema.jsonValue())
                store.commit(name, {f"{PART}{b}": {"schema": schema, "paths": [f"{target}/bucket={b}"]} for b in written}, {mark: str(number)}, head)
                store.vacuum(keep)
        finally:
            staged.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
