"""Alerts on a change of state: a row where a rule turns to FAIL, once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import Store

def turned(results: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """rule_id, at and before (the status before, NULL if there was none) where a rule's results (rule_id, at, status) turn to FAIL; state has the last status of each rule so far. Results no newer than a rule's state are left out."""
    rows = results.select("rule_id", "at", "status", F.lit(False).alias("_old"))
    if state is not None:
        rows = rows.join(state.select("rule_id", F.col("at").alias("_at")), "rule_id", "left").where("_at IS NULL OR at > _at").drop("_at")
        rows = rows.unionByName(state.select("rule_id", "at", "status", F.lit(True).alias("_old")))
    changed = rows.withColumn("before", F.lag("status").over(Window.partitionBy("rule_id").orderBy("at", "status")))
    return changed.where("status = 'FAIL' AND (before IS NULL OR before <> 'FAIL') AND NOT _old").select("rule_id", "at", "before")


def newest(results: DataFrame, state: DataFrame | None) -> DataFrame:
    """The last status of each rule after some results."""
    rows = results.select("rule_id", "at", "status")
    rows = rows if state is None else rows.unionByName(state.select("rule_id", "at", "status"))
    return rows.groupBy("rule_id").agg(F.max(F.struct("at", "status")).alias("r")).select("rule_id", "r.*")


def alert(store: Store, batch: DataFrame, number: int, source: str = "alerts") -> int:
    """Add a batch's alerts to the store's table "alerts" and keep the rules' last states in "states", both in one commit with the batch's number of its source: a batch that comes again changes nothing. The number of alerts added."""
    head = store.head()
    if int(head.marks.get(source, "-1")) >= number:
        return 0
    run = store.begin()
    state = store.frame(head.tables["states"]) if "states" in head.tables else None
    rows = batch.persist()  # read twice
    try:
        added = store.write(turned(rows, state), "alerts", run)
        states = store.write(newest(rows, state), "states", run)
    finally:
        rows.unpersist()
    old = head.tables.get("alerts", {"paths": []})["paths"]
    store.commit(run, {"alerts": added | {"paths": [*old, *added["paths"]]}, "states": states}, {source: str(number)}, head)
    return store.frame(added).count()


def watch(stream: DataFrame, store: Store, checkpoint: str):
    """Alerts of a stream of results. Batches are numbered by checkpoint: results that a stream gives again after its checkpoint is lost are older than the states, and raise nothing."""
    return stream.writeStream.foreachBatch(lambda batch, number: alert(store, batch, number, f"batch of {checkpoint}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
