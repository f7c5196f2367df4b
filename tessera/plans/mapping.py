"""The driver's tables in the shape of the engine's entities, and the same as SQL for the oracle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
AS_OF = dt.date(2001, 8, 1)
EVENT_AS_OF = dt.date(2024, 1, 31)


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))


def sales(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "SHIPPED").otherwise("PENDING")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("order_date"),
        status.alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("net"), F.col("o_orderpriority").alias("channel"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("product"),
        F.col("l_quantity").cast("decimal(12,0)").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.col("l_returnflag").alias("return_flag"))


def products(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_partkey").alias("product"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("unit_price"))


def touches(spark: SparkSession, d: str) -> DataFrame:
    """Interactions; errors are negative signals."""
    return load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("customer"), F.col("event_type").alias("channel"), F.col("ts"),
        (F.col("event_type") == "error").alias("negative"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where("event_type = 'error'")
    i = F.col("event_id")
    return e.select(
        i.alias("case_id"), F.col("user_id").alias("customer"), F.col("ts").alias("opened_at"), F.when(i % 5 == 0, "OPEN").otherwise("CLOSED").alias("status"), (i % 5 + 1).cast("int").alias("csat"),
        F.when(i % 5 != 0, F.round(F.col("value").cast("decimal(18,4)"), 2)).alias("hours"), (i % 3).cast("int").alias("reopens"),
            F.element_at(F.array(*map(F.lit, ("BILLING", "DELIVERY", "PRODUCT", "RETURN"))), (i % 4 + 1).cast("int")).alias("case_type"),
        F.element_at(F.array(*map(F.lit, (2, 8, 24, 72))), (i % 4 + 1).cast("int")).alias("sla_hours"),
    )


def loyalty(spark: SparkSession, d: str) -> DataFrame:
    """One account for each customer with a balance above 0; the tier follows the segment."""
    tier = F.when(F.col("segment") == "AUTOMOBILE", 4).when(F.col("segment") == "BUILDING", 3).when(F.col("segment") == "FURNITURE", 2).when(F.col("segment") == "HOUSEHOLD", 1).otherwise(0)
    return customers(spark, d).where("balance > 0").select("customer", tier.alias("tier_rank"), (F.col("customer") % 400).cast("int").alias("inactive_days"))


#: The same entities for DuckDB.
ENTITIES = """
customers AS (SELECT c_custkey AS customer, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, CAST(c_acctbal AS DECIMAL(18,2)) AS balance FROM customer),
sales AS (SELECT o_orderkey AS order_id, o_custkey AS customer, CAST(o_orderdate AS DATE) AS order_date,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'SHIPPED' ELSE 'PENDING' END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS net, o_orderpriority AS channel FROM orders),
items AS (SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product, CAST(l_quantity AS DECIMAL(12,0)) AS quantity, CAST(l_extendedprice AS
DECIMAL(18,2)) AS amount, l_returnflag AS return_flag FROM lineitem),
products AS (SELECT p_partkey AS product, p_type AS category, p_brand AS brand, CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price FROM part),
touches AS (SELECT event_id AS id, user_id AS customer, event_type AS channel, ts, event_type = 'error' AS negative FROM events),
cases AS (SELECT event_id AS case_id, user_id AS customer, ts AS opened_at, CASE WHEN event_id % 5 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS status, CAST(event_id % 5 + 1 AS INT) AS csat,
  CASE WHEN event_id % 5 <> 0 THEN ROUND(CAST(value AS DECIMAL(18,4)), 2) END AS hours, CAST(event_id % 3 AS INT) AS reopens,
  ['BILLING','DELIVERY','PRODUCT','RETURN'][event_id % 4 + 1] AS case_type, [2,8,24,72][event_id % 4 + 1] AS sla_hours FROM events WHERE event_type = 'error'),
loyalty AS (SELECT customer, CASE segment WHEN 'AUTOMOBILE' THEN 4 WHEN 'BUILDING' THEN 3 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END AS tier_rank,
CAST(customer % 400 AS INT) AS inactive_days FROM customers WHERE balance > 0)
"""
