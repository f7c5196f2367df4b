"""Queries of merges, predicates and orders that the other modules don't show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import EMAIL_VALID, latest
from tessera.plans.mapping import load
from tessera.plans.registry import query
from tessera.sources.sinks import upsert

_KEYED = "SELECT c_custkey, {0} AS c_name, md5({0}) AS h FROM customer WHERE {1}"


@query(f"""WITH t AS ({_KEYED.format('c_name', 'c_custkey % 3 <> 0')}), c AS ({_KEYED.format("CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || ' new' END", 'c_custkey % 5 = 0')})
SELECT c_custkey, CASE WHEN t.h IS NULL OR c.h <> t.h THEN c.c_name ELSE t.c_name END AS c_name, CASE WHEN t.h IS NULL OR c.h <> t.h THEN c.h ELSE t.h END AS h FROM t FULL JOIN c USING (c_custkey)""")
def merge_upsert(s: SparkSession, d: str) -> DataFrame:
    """Changed rows replaced, new ones added, others untouched."""
    k, name = F.col("c_custkey"), F.col("c_name")
    base = load(s, d, "customer").select(k, name)
    hashed = lambda df: df.withColumn("h", F.md5("c_name"))
    changes = base.where(k % 5 == 0).withColumn("c_name", F.when(k % 2 == 0, name).otherwise(F.concat(name, F.lit(" new"))))
    return upsert(hashed(base.where(k % 3 != 0)), hashed(changes), "c_custkey", "h")


@query(f"SELECT c_custkey, regexp_full_match(email, '{EMAIL_VALID}') AS valid FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(replace(c_name, '#', '.')) || "
    f"'@example.com' WHEN 1 THEN c_name WHEN 2 THEN 'a@b' END AS email FROM customer)")
def email_valid(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    email = F.when(k == 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))).when(k == 1, F.col("c_name")).when(k == 2, "a@b")
    return load(s, d, "customer").select("c_custkey", email.rlike(EMAIL_VALID).alias("valid"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' "
    "THEN 1 ELSE 2 END, o_orderpriority, o_orderkey) = 1")
def first_by_case_order(s: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return latest(load(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"), ["o_custkey"], rank, F.col("o_orderpriority"), F.col("o_orderkey")).drop("o_orderstatus")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, "
    "round(stddev_samp(value), 4) AS spread, max(props) AS any_props FROM events GROUP BY event_type")
def event_profile(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.to_date(F.min("ts")).alias("first_day"),
        F.to_date(F.max("ts")).alias("last_day"), F.round(F.stddev_samp("value"), 4).alias("spread"), F.max("props").alias("any_props"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(s: SparkSession, d: str) -> DataFrame:
    """An extra: counts in windows of a day."""
    return load(s, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "event_type", "n")
