"""Data quality: rules as data, a runner, quarantine, views of results, drift, lineage, retention."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """table: whose rows are the denominator; failed: SQL that gives one number, or where: a condition on a row of the table that fails."""

    rule_id: str
    severity: str
    threshold: float
    table: str
    failed: str = ""
    where: str = ""
    name: str = ""
    dimension: str = ""
    column: str = ""
    owner: str = ""


def verdict(failed: Column, evaluated: Column, threshold: Column, severity: Column) -> tuple[Column, Column]:
    """Percentage that failed and the status; the comparison takes the percentage before rounding."""
    pct = F.when(evaluated > 0, failed * 100.0 / evaluated).when(failed > 0, 100.0).otherwise(0.0).cast("double")
    status = F.when(failed < 0, "FAIL").when((failed == 0) | (pct <= threshold), "PASS").when(severity == "BLOCKING", "FAIL").when(severity == "WARNING", "WARN").otherwise("PASS")
    return F.when(failed < 0, 0.0).otherwise(F.round(pct, 4)), status


def run(spark: SparkSession, rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """Results of all rules over named tables, as one job: conditions on rows and row counts are one aggregate for each table, other rules one subquery each. A rule that can't be analysed counts
    as -1 failed rows and FAIL, and leaves the others alone. Tables that several rules read are planned for each, so give tables that are written (operators.build), not long plans.

    Rules see the tables under their names; the caller's views keep theirs, as the tables are registered under names of this call alone."""
    own_name = f"rules_{uuid.uuid4().hex[:12]}_{{}}".format
    for name, df in tables.items():
        df.createOrReplaceTempView(own_name(name))
    named = lambda sql: ", ".join(f"`{n}` AS (SELECT * FROM {own_name(n)})" for n in tables if re.search(rf"\b{re.escape(n)}\b", sql))
    error = spark.range(1).select(F.lit(-1).cast("long").alias("failed"))
    parts = []
    try:
        for table in dict.fromkeys(r.table for r in rules):
            counts = {}
            for r in rules:
                if r.table == table and r.where:
                    try:
                        tables[table].where(r.where)
                        counts[r.rule_id] = F.count(F.when(F.expr(r.where), 1))
                    except Exception:  # noqa: BLE001  any error of the rule's own SQL
                        counts[r.rule_id] = F.lit(-1).cast("long")
            aggregate = tables[table].agg(F.count("*").alias("evaluated"), F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*counts.values())).alias("counts")
                if counts else F.lit(None).alias("counts"))
            own = [r for r in rules if r.table == table]
            meta = F.explode(F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.threshold).cast("double").alias("threshold")) for r in own)))
            base = aggregate.select("evaluated", "counts", meta.alias("r")).select("r.*", "evaluated", (F.col("counts")[F.col("r.rule_id")] if counts else F.lit(None).cast("long")).alias("failed"))
            others = None
            for r in (x for x in own if not x.where):
                try:
                    failed = spark.sql(f"{f'WITH {those} ' if (those := named(r.failed)) else ''}SELECT CAST(({r.failed}) AS BIGINT) AS failed")
                except Exception:  # noqa: BLE001
                    failed = error
                one = failed.select(F.lit(r.rule_id).alias("rule_id"), F.col("failed").alias("sql_failed"))
                others = one if others is None else others.union(one)
            if others is not None:  # a row for each rule
                base = base.join(F.broadcast(others), "rule_id", "left").withColumn("failed", F.coalesce("failed", "sql_failed")).drop("sql_failed")
            parts.append(base.select("rule_id", "severity", "threshold", "failed", "evaluated"))
    finally:
        for name in tables:
            spark.catalog.dropTempView(own_name(name))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    pct, status = verdict(F.col("failed"), F.col("evaluated"), F.col("threshold"), F.col("severity"))
    return out.select("rule_id", "severity", F.col("failed").alias("rows_failed"), F.col("evaluated").alias("rows_evaluated"), pct.alias("fail_pct"), status.alias("status"))


def execute(spark: SparkSession, rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """run(), done: a row for each rule. If the job fails, each rule runs alone, and those that fail count as -1 failed rows."""
    schema = "rule_id string, severity string, rows_failed long, rows_evaluated long, fail_pct double, status string"
    try:
        rows = [tuple(r) for r in run(spark, rules, tables).collect()]
    except Exception:  # noqa: BLE001  an error of some rule while it ran
        rows = []
        for r in rules:
            try:
                rows.append(tuple(run(spark, [r], tables).first()))
            except Exception:  # noqa: BLE001
                rows.append((r.rule_id, r.severity, -1, tables[r.table].count(), 0.0, "FAIL"))
    return spark.createDataFrame(rows, schema)


def scorecard(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Active rules with their latest results, failures first."""
    rank = F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "WARN", 1).otherwise(2)
    return rules.where("is_active").select("rule_id", "rule_name", "dimension", "target_table").join(results, "rule_id", "left").orderBy(rank, "rule_id")


def catalogue(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as rows."""
    rows = [(r.rule_id, r.name, r.dimension, r.table, r.column, r.severity, float(r.threshold), r.where or r.failed, r.owner, True) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, dimension string, target_table string, target_column string, severity string, threshold_pct "
        "double, rule_sql string, owner string, is_active boolean")


def quarantine(parts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows that break a blocking rule, as JSON with the rule's id."""
    rows = [df.where(bad).select(F.lit(rule).alias("rule_id"), F.to_json(F.struct(*sorted(df.columns))).alias("payload")) for rule, (df, bad) in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def survivors(df: DataFrame, match: Column, order: Column) -> DataFrame:
    """The first row of each match key."""
    w = Window.partitionBy("_match").orderBy(order)
    return df.withColumn("_match", match).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_match")


def rejected(raw: DataFrame, staged: DataFrame, kept: DataFrame, as_of) -> DataFrame:
    """The dead letter: raw customers (customer_id, email, row_id) without a key, staged orders with amounts or dates that can't be trusted, and raw customers that are suppressed as duplicates of
    those kept, with the rule, its severity, the row's key and the reason."""

    def rows(df: DataFrame, rule: str, severity: str, own: Column, key: Column, reason: Column) -> DataFrame:
        return df.select(F.md5(F.concat(F.lit(rule), own)).alias("reject_id"), F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), key.alias("record_key"), reason.alias("reason"))

    c, text = F.col, lambda n: F.coalesce(F.col(n).cast("string"), F.lit("NULL"))
    out = rows(raw.where("customer_id IS NULL OR trim(customer_id) = ''"), "DQ-C-001", "BLOCKING", F.coalesce("email", "row_id"),
        F.coalesce(c("email"), F.lit("(no key)")), F.lit("Customer record has no business key and cannot be identified or deduplicated."))
    out = out.union(rows(staged.where("amount IS NULL OR amount < 0"), "DQ-O-002", "BLOCKING", c("order_id"), c("order_id"), F.concat(F.lit("Order amount is null or negative: "), text("amount"))))
    out = out.union(rows(staged.where(c("order_date").isNull() | (c("order_date") > F.lit(as_of))), "DQ-O-003", "BLOCKING", c("order_id"), c("order_id"),
        F.concat(F.lit("Order date is in the future: "), text("order_date"))))
    again = raw.where("customer_id IS NOT NULL").join(kept.select("customer_id"), "customer_id", "left_anti")
    return out.union(rows(again, "DQ-C-005", "WARNING", c("customer_id"), c("customer_id"), F.lit("Suppressed as a duplicate of an existing customer with the same e-mail.")))


def newest(results: DataFrame, key: str, at: str) -> DataFrame:
    """The rows with the latest time of each key; ties stay."""
    return results.join(results.groupBy(key).agg(F.max(at).alias(at)), [key, at])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift(daily: DataFrame, name: str, day: str, value: str, days: int = 7, most: float = 0.2) -> DataFrame:
    """Each day's value against the mean of the days before it, and whether it drifts by more than a share."""
    w = Window.partitionBy(name).orderBy(day).rowsBetween(-days, -1)
    out = daily.withColumn("mean_before", F.round(F.avg(value).over(w), 6))
    return out.withColumn("drifted", F.coalesce(F.abs(F.col(value) - F.col("mean_before")) > most * F.col("mean_before"), F.lit(False)))


def reconcile(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges (source, target) as HEALTHY, UNDOCUMENTED (seen, not declared) or DEAD (declared, not seen)."""
    both = observed.distinct().withColumn("_o", F.lit(1)).join(declared.distinct().withColumn("_d", F.lit(1)), ["source", "target"], "full")
    return both.select("source", "target", F.when(F.col("_d").isNull(), "UNDOCUMENTED").when(F.col("_o").isNull(), "DEAD").otherwise("HEALTHY").alias("state"))


def retained(df: DataFrame, at: str, as_of, months: int) -> DataFrame:
    """Rows within the retention of their entity."""
    return df.where(F.col(at) >= F.add_months(F.lit(as_of), -months))


def crossings(scores: DataFrame, key: str, day: str, band: str) -> DataFrame:
    """Rows whose band differs from the key's day before, with both."""
    w = Window.partitionBy(key).orderBy(day)
    return scores.withColumn("band_before", F.lag(band).over(w)).where(F.col("band_before") != F.col(band))
