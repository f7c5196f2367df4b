"""Type-2 dimensions: history from a change log, application of a staged snapshot, invariants, and joins as of a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = "9999-12-31 00:00:00"


def history(changes: DataFrame, key: str, at: str, tracked: list[str], tie: str) -> DataFrame:
    """Versions of each key: a row of the log begins one where the tracked columns differ from the row before."""
    w = Window.partitionBy(key).orderBy(at, tie)
    row = changes.withColumn("row_hash", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tracked])))
    new = row.withColumn("_before", F.lag("row_hash").over(w)).where("_before IS NULL OR _before <> row_hash")
    return new.select(
        key, *tracked, "row_hash", F.col(at).alias("valid_from"), F.coalesce(F.lead(at).over(w), F.lit(OPEN).cast("timestamp")).alias("valid_to"),
        F.lead(at).over(w).isNull().alias("is_current"), F.row_number().over(w).alias("version"), F.when(F.col("_before").isNull(), "INSERT").otherwise("UPDATE").alias("change_type"),
    )


def apply(current: DataFrame, staged: DataFrame, key: str, now: Column) -> DataFrame:
    """The dimension after a snapshot of staged rows (key, row_hash, updated_at, created_at, dq_status and attributes).

    Open versions whose hash differs are closed at the staged update time (now if it is null, never before they began), and new versions are added for staged
    rows that pass and have no open version with their hash. A staged row older than its key's open version came too late: it changes nothing. Keys that are not staged
    stay as they are. One shuffle on the key."""
    attributes = [c for c in staged.columns if c not in (key, "row_hash", "updated_at", "created_at", "dq_status")]
    ok = staged.where("dq_status <> 'FAIL'")
    s = ok.select(key, F.col("row_hash").alias("_hash"), F.coalesce("updated_at", now).alias("_at"))
    closing = current.join(s, key, "left")
    changed = F.col("is_current") & F.col("_hash").isNotNull() & (F.col("_hash") != F.col("row_hash")) & (F.col("_at") >= F.col("valid_from"))
    closed = closing.withColumns({"valid_to": F.when(changed, F.greatest("_at", "valid_from")).otherwise(F.col("valid_to")),
        "change_type": F.when(changed, "UPDATE").otherwise(F.col("change_type")), "is_current": F.col("is_current") & ~changed}).select(*current.columns)
    known = current.groupBy(key).agg(F.max("version").alias("_version"), F.max(F.when(F.col("is_current"), F.col("row_hash"))).alias("_open"),
        F.max(F.when(F.col("is_current"), F.col("valid_from"))).alias("_since"))
    new = ok.join(known, key, "left").where((F.col("_open").isNull() | (F.col("_open") != F.col("row_hash"))) & (F.col("_since").isNull() | (F.coalesce("updated_at", now) >= F.col("_since")))).select(
        key, *attributes, "row_hash", F.coalesce("updated_at", "created_at", now).alias("valid_from"), F.lit(OPEN).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"),
        (F.coalesce("_version", F.lit(0)) + 1).alias("version"), F.when(F.col("_version").isNull(), "INSERT").otherwise("UPDATE").alias("change_type"),
    )
    return closed.unionByName(new.select(*current.columns))


def overlapping(dim: DataFrame, key: str) -> DataFrame:
    """Keys with versions that overlap: in order of time one begins before the latest end so far. One shuffle and a sort, no join."""
    before = Window.partitionBy(key).orderBy("valid_from", "valid_to").rowsBetween(Window.unboundedPreceding, -1)
    return dim.select(key, "valid_from", F.max("valid_to").over(before).alias("_until")).where("valid_from < _until").select(key).distinct()


def overlaps(dim: DataFrame, key: str) -> DataFrame:
    """Ordered pairs of versions of a key that overlap (each pair twice). Only keys that have any are joined with themselves."""
    dim = dim.join(overlapping(dim, key), key, "left_semi")
    a, b = dim.select(key, F.col("version").alias("a"), F.col("valid_from").alias("af"), F.col("valid_to").alias("at")), dim.select(key, F.col("version").alias("b"),
        F.col("valid_from").alias("bf"), F.col("valid_to").alias("bt"))
    return a.join(b, key).where("a <> b AND af < bt AND bf < at").select(key, "a", "b")


def check(dim: DataFrame, key: str) -> None:
    """Raise if a key has several open versions or overlapping ones."""
    if dim.where("is_current").groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("several current versions of a key")
    if overlapping(dim, key).limit(1).count():
        raise ValueError("versions of a key overlap")


def as_of_join(facts: DataFrame, dim: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Facts with the columns of the version that was valid at a time, NULL where none was.

    Versions and facts of a key are merged in order of time and the last version is carried forward: one shuffle and a sort, however many versions a key has."""
    version = F.struct("valid_to", *columns)
    both = facts.select(key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*facts.columns).alias("_fact"),
        F.lit(None).cast(dim.select(version.alias("v")).schema["v"].dataType).alias("_v"))
    both = both.unionByName(dim.select(key, F.col("valid_from").alias("_at"), F.lit(0).alias("_side"),
        F.lit(None).cast(facts.select(F.struct(*facts.columns).alias("f")).schema["f"].dataType).alias("_fact"), version.alias("_v")))
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    valid = F.col("_at") < F.col("_last.valid_to")
    return out.select("_fact.*", *(F.when(valid, F.col(f"_last.{c}")).alias(c) for c in columns))
