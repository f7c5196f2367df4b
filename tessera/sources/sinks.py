"""Writing: full refresh, daily partitions, registered appends and the run log. High-water marks are committed with what was read up to them (store)."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.store import Store

MOST_ROWS = 500
#: Appends by name, with the columns that each takes.
REGISTRY = {
    "ai_insight": ["insight_id", "customer", "kind", "text", "confidence", "created_at"],
    "ai_audit": ["request_id", "customer", "kind", "tokens", "cost", "status", "created_at"],
    "ai_evaluation": ["insight_id", "metric", "score", "threshold", "passed", "created_at"],
}


def refresh(df: DataFrame, store: Store, name: str) -> None:
    """A full refresh; readers have the old rows until all new ones are there."""
    store.replace(name, df)


def replace_days(df: DataFrame, path: str, day: str) -> None:
    """Replace the partitions of the days that df has, and leave others alone: running twice gives the same."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append(df: DataFrame, name: str, path: str) -> int:
    """Append at most MOST_ROWS rows under a registered name."""
    if name not in REGISTRY:
        raise ValueError(f"not a registered write: {name}")
    if set(df.columns) != set(REGISTRY[name]):
        raise ValueError(f"{name} takes {REGISTRY[name]}")
    n = df.limit(MOST_ROWS + 1).count()
    if n > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows in a write")
    df.select(*REGISTRY[name]).write.mode("append").parquet(path)
    return n


def logged(spark: SparkSession, path: str, name: str, run: Callable[[], int]) -> int:
    """Run a step and log it, whether it ends well or not."""
    began, status, rows, error = time.time(), "SUCCESS", 0, None
    try:
        rows = run()
        return rows
    except Exception as e:
        status, error = "FAILED", str(e)[:500]
        raise
    finally:
        row = (name, status, rows, error, dt.datetime.fromtimestamp(began, dt.UTC).replace(tzinfo=None), time.time() - began)
        spark.createDataFrame([row], "step string, status string, rows long, error string, started_at timestamp_ntz, seconds double").write.mode("append").parquet(path)


def upsert(target: DataFrame, changes: DataFrame, key: str, hash_column: str) -> DataFrame:
    """The target with changed rows replaced and new ones added; rows with the same hash stay untouched."""
    t = target.select(F.col(key), F.struct(*target.columns).alias("t"))
    c = changes.select(F.col(key), F.struct(*target.columns).alias("c"))
    row = F.when(F.col("t").isNull(), F.col("c")).when(F.col("c").isNull() | (F.col(f"c.{hash_column}") == F.col(f"t.{hash_column}")), F.col("t")).otherwise(F.col("c"))
    return t.join(c, key, "full").select(row.alias("r")).select("r.*")
