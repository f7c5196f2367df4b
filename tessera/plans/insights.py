"""Queries of insight text and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import insight
from tessera.plans import customer as C
from tessera.plans.mapping import load
from tessera.plans.registry import query

@query(C.ALL + C.WHOLE + """SELECT customer, 'The customer is in the ' || segment || ' segment. ' || CASE WHEN total_orders > 0 THEN 'They have placed ' || total_orders || ' orders.' ELSE 'They have no recorded purchase history.' END || CASE WHEN open_cases > 0 THEN ' ' || open_cases || ' support cases are open.' ELSE '' END || CASE WHEN band IS NOT NULL THEN ' Churn risk is ' || band || '.' ELSE '' END AS summary FROM c360""")
def insight_summary(s: SparkSession, d: str) -> DataFrame:
    return insight.summary(C._whole(s, d))


@query(C.WITH + C.SUPPORT + "SELECT customer, round((avg_csat - 3) / 2.0::DOUBLE, 4) AS score, CASE WHEN round((avg_csat - 3) / 2.0::DOUBLE, 4) > 0.2 THEN 'POSITIVE' "
    "WHEN round((avg_csat - 3) / 2.0::DOUBLE, 4) < -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label FROM ssum")
def sentiment_score(s: SparkSession, d: str) -> DataFrame:
    score, label = insight.sentiment(F.col("avg_csat"))
    return C._support(s, d).select("customer", score.alias("score"), label.alias("label"))


@query("SELECT a.event_id AS request, b.event_id AS produced FROM (SELECT * FROM events WHERE user_id = 7 AND event_type = 'view') a LEFT JOIN (SELECT * FROM events "
    "WHERE event_type = 'purchase') b ON a.user_id = b.user_id")
def trace_lookup(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "events").withColumn("correlation_id", F.col("user_id").cast("string"))
    out = insight.trace(e.where("event_type = 'view'").select("correlation_id", F.col("event_id").alias("request")),
        e.where("event_type = 'purchase'").select("correlation_id", F.col("event_id").alias("produced")), "7")
    return out.select("request", "produced")


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_type LIKE '%M%' AND p_size >= 10 AND p_size < 20 AND p_brand ILIKE 'brand#1%'")
def like_range_filter(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "part").where(F.col("p_type").like("%M%") & (F.col("p_size") >= 10) & (F.col("p_size") < 20) & F.col("p_brand").ilike("brand#1%")).select("p_partkey", "p_type", "p_size")


@query("(SELECT 'top' AS part, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'low', o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)")
def union_samples(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    end = lambda name, *order: o.orderBy(*order, "o_orderkey").limit(10).select(F.lit(name).alias("part"), "o_orderkey")
    return end("top", F.desc("o_totalprice")).unionByName(end("low", F.asc("o_totalprice")))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def recent_context(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(s, d, "events").select("user_id", "event_id", "ts").withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n")


@query("SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY c_mktsegment HAVING count(DISTINCT c_nationkey) > 1")
def having_distinct(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations")).where("nations > 1")
