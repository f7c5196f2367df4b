"""Queries of what leaves the warehouse: rendered rows, canonical orders, the context that models may see, and the health of loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import canonical, core, serving
from tessera.plans import mapping as M
from tessera.plans import warehouse as W
from tessera.plans.registry import query

@query(f"{W.WAREHOUSE} SELECT {', '.join(serving.MODEL_CONTEXT)} FROM full360")
def ai_context(s: SparkSession, d: str) -> DataFrame:
    return serving.model_view(core.full_view(W._all(s, d), W._addresses(s, d), M.AS_OF, W.AT))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS at,
CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'true' ELSE 'false' END AS flag, CASE WHEN event_id % 7 <> 0 THEN '[' || event_id || ',null,2]' END AS ids FROM events""")
def rendered_rows(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = M.load(s, d, "events").select(
        "event_id", F.col("value").cast("decimal(18,2)").alias("value"), F.to_date("ts").alias("day"), F.col("ts").alias("at"),
            F.when(k % 3 == 0, F.lit(None).cast("boolean")).otherwise(k % 3 == 1).alias("flag"),
        F.when(k % 7 != 0, F.array(k, F.lit(None).cast("long"), F.lit(2).cast("long"))).alias("ids"),
    )
    return serving.rendered(e)


@query("""SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus AS status, o_orderpriority AS channel, CAST(amount AS DOUBLE) AS
gross_amount, CAST(discount AS DOUBLE) AS discount_amount, CAST(amount - discount AS DOUBLE) AS net_amount
FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 900 / 100.0 ELSE 0 END AS DECIMAL(18,2)) AS discount FROM orders)""")
def canonical_oms_map(s: SparkSession, d: str) -> DataFrame:
    """Orders of the order system under canonical names; a missing discount is 0, the net amount is the rest."""
    k = F.col("o_orderkey")
    return canonical.orders(M.load(s, d, "orders").select(k.alias("order_id"), F.col("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").alias("amount"), F.when(k % 4 == 0, (k % 900) / 100).alias("discount")))


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_load, date_diff('minute', max(ts), TIMESTAMP '2024-02-01 00:00:30') AS minutes_since FROM events GROUP BY event_type")
def pipe_health(s: SparkSession, d: str) -> DataFrame:
    """When each kind of events last came, and how many minutes ago."""
    last = M.load(s, d, "events").groupBy("event_type").agg(F.max("ts").alias("at"))
    return last.select("event_type", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("last_load"),
        X.minutes_between(F.col("at"), F.lit("2024-02-01 00:00:30").cast("timestamp")).alias("minutes_since"))


@query("SELECT p_partkey, split_part(p_type, ' ', -1) AS material, 'PART-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS code, strftime(DATE '2020-01-01' + "
    "CAST(p_partkey % 700 AS INT), '%Y%m%d') AS launched FROM part")
def part_codes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return M.load(s, d, "part").select("p_partkey", X.last_part(F.col("p_type"), " ").alias("material"), X.numbered(F.lit("PART"), k % 1000).alias("code"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int")), "yyyyMMdd").alias("launched"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 1 THEN round(v, 4) END AS number, CASE WHEN event_id % 4 > 1 THEN v = floor(v) END AS is_whole FROM (SELECT event_id, "
    "CASE WHEN event_id % 8 = 2 THEN floor(value) ELSE value END AS v FROM events)")
def finite_numbers(s: SparkSession, d: str) -> DataFrame:
    """Values of which some are NaN, infinite or whole."""
    k = F.col("event_id")
    v = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(float("-inf"))).when(k % 8 == 2, F.floor("value").cast("double")).otherwise(F.col("value"))
    number, whole = X.finite(v)
    return M.load(s, d, "events").select("event_id", number.alias("number"), whole.alias("is_whole"))


@query("SELECT event_id, c AS column_name, CASE c WHEN 'k' THEN json_extract_string(props, '$.k') END AS value FROM events, (VALUES ('k'), ('user')) t(c) WHERE event_id % 5 <> 0")
def flattened_columns(s: SparkSession, d: str) -> DataFrame:
    """Columns named in a JSON array of each row; every fifth row has none that can be read."""
    k, v = F.col("event_id"), F.get_json_object("props", "$.k")
    named = F.concat(F.lit('[{"columnName": "k", "value": "'), v, F.lit('"}, {"columnName": "user"}]'))
    rows = M.load(s, d, "events").select("event_id", F.when(k % 5 != 0, named).otherwise("[]").alias("j"))
    return rows.select("event_id", X.flattened(F.col("j"), {"columnName": "column_name", "value": "value"}).alias("c")).select("event_id", "c.*")
