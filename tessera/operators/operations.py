"""How the platform does: queues, runs, batches, calls of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def review_queue(items: DataFrame, until: Column) -> DataFrame:
    """queue, day, opened, closed, depth and oldest (when the oldest item that is still open was opened, NULL if none is) at the end of each day, from a queue's first
    opening to `until`; items have queue, opened_at and closed_at (NULL while open).

    A sweep instead of a join of days with the items open on them. Items are first counted by the days on which they open and close, with their earliest opening: at most
    a row for each two days goes on. In order of opening, an item is the
    oldest open one from when all that opened before it have closed until it closes itself; these stretches are disjoint, so the last one that began by a day, if it
    isn't over, has that day's oldest item. Depth is a running sum of +1 and -1.

    An item that closes on the day it opens is never open at a day's end; one that closes before it opens, or was never opened, is left out."""
    c = F.col
    never = F.lit("9999-12-31").cast("date")
    spans = items.where("opened_at IS NOT NULL AND (closed_at IS NULL OR closed_at >= opened_at)").groupBy("queue", F.to_date("opened_at").alias("a"),
        F.coalesce(F.to_date("closed_at"), never).alias("b")).agg(F.count("*").alias("n"), F.min("opened_at").alias("first"))
    order = Window.partitionBy("queue").orderBy("first", "a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    stretch = spans.withColumn("from", F.greatest("a", F.coalesce(before, c("a"))))
    change = F.array(
        F.struct(c("a").alias("day"), c("n").alias("opened"), F.lit(0).cast("long").alias("closed"), F.lit(None).cast("date").alias("over"), F.lit(None).cast("timestamp").alias("first")),
        F.struct(c("b").alias("day"), F.lit(0).cast("long").alias("opened"), c("n").alias("closed"), F.lit(None).cast("date").alias("over"), F.lit(None).cast("timestamp").alias("first")),
        F.struct(c("from").alias("day"), F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("closed"), F.when(c("from") < c("b"), c("b")).alias("over"),
            F.when(c("from") < c("b"), c("first")).alias("first")),
    )
    days = stretch.select("queue", F.explode(change).alias("e")).groupBy("queue", "e.day").agg(F.sum("e.opened").alias("opened"), F.sum("e.closed").alias("closed"),
        F.max(F.when(c("e.over").isNotNull(), F.struct("e.over", "e.first"))).alias("top"))
    by_day = Window.partitionBy("queue").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    next_ = F.lead("day").over(Window.partitionBy("queue").orderBy("day"))
    state = days.withColumns({"depth": F.sum(c("opened") - c("closed")).over(by_day), "top": F.last("top", True).over(by_day), "upto": F.least(F.coalesce(F.date_sub(next_, 1), until), until)})
    each = state.where(c("day") <= until).withColumn("on", F.explode(F.sequence("day", "upto")))
    that_day = c("on") == c("day")
    return each.select(
        "queue", c("on").alias("day"), F.when(that_day, c("opened")).otherwise(0).alias("opened"), F.when(that_day, c("closed")).otherwise(0).alias("closed"), "depth",
            F.when(c("top.over") > c("on"), c("top.first")).alias("oldest")
    )


def slow_runs(runs: DataFrame, days: int = 7, times: float = 2.0) -> DataFrame:
    """Each run (step, day, seconds) with the mean of its step's runs before it and whether it took more than so many times that."""
    w = Window.partitionBy("step").orderBy("day").rowsBetween(-days, -1)
    return runs.withColumn("mean_before", F.round(F.avg("seconds").over(w), 6)).withColumn("slow", F.coalesce(F.col("seconds") > times * F.col("mean_before"), F.lit(False)))


def quarantine_share(staged: DataFrame, batch: str, most: float = 0.005) -> DataFrame:
    """Of each batch of staged rows (dq_status) the rows, those quarantined, their share, and whether it is more than may be."""
    bad = F.count(F.when(F.col("dq_status") == "FAIL", 1))
    return staged.groupBy(batch).agg(F.count("*").alias("n_rows"), bad.alias("quarantined"), F.round(bad / F.count("*"), 6).alias("share"), (bad > most * F.count("*")).alias("too_many"))


def calls(audit: DataFrame) -> DataFrame:
    """Calls of models by day (of `at`), from an audit of at, client, cost, blocked, groundedness and action: calls, clients, cost, share of blocked ones, mean groundedness."""
    blocked = F.count(F.when(F.col("blocked"), 1))
    return audit.groupBy(F.to_date("at").alias("day")).agg(
        F.count("*").alias("calls"), F.countDistinct("client").alias("clients"), F.sum(F.col("cost").cast("decimal(18,4)")).cast("double").alias("cost"),
            F.round(blocked * F.lit(1.0) / F.count("*"), 6).alias("block_rate"),
        F.round(F.sum(F.col("groundedness").cast("decimal(10,4)")) / F.count("groundedness"), 4).cast("double").alias("groundedness"),
    )


def actions(audit: DataFrame) -> DataFrame:
    """How often each action was recommended, and its share."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over one row for each action
    return audit.where("action IS NOT NULL").groupBy("action").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / total, 6))
