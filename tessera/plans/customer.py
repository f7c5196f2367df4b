"""Queries of customer summaries, features, scores and the unified view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import most_common
from tessera.operators import analytics as A
from tessera.operators import serving as V
from tessera.plans import mapping as M
from tessera.plans.registry import query

WITH = "WITH " + M.ENTITIES.strip()
DAY, NOW = f"DATE '{M.AS_OF}'", f"DATE '{M.EVENT_AS_OF}'"
REV = "status IN ('COMPLETED','SHIPPED')"

ORDERS = f"""
, cats AS (SELECT customer, count(DISTINCT category) AS n FROM sales JOIN items USING (order_id) JOIN products USING (product) GROUP BY customer),
chan AS (SELECT customer, channel FROM (SELECT customer, channel, row_number() OVER (PARTITION BY customer ORDER BY count(*) DESC, channel) AS r FROM sales GROUP BY customer, channel) WHERE r = 1),
osum0 AS (SELECT customer, min(order_date) AS first_order_date, max(order_date) AS last_order_date, count(*) AS total_orders, count(*) FILTER (status = 'COMPLETED') AS completed_orders,
  count(*) FILTER (status = 'CANCELLED') AS cancelled_orders, count(*) FILTER (status = 'RETURNED') AS returned_orders, coalesce(sum(CASE WHEN {REV} THEN net END), 0) AS
rev, count(*) FILTER ({REV}) AS nrev,
  coalesce(max(CASE WHEN {REV} THEN net END), 0) AS top, count(*) FILTER (order_date >= {DAY} - 90) AS orders_last_90d, count(*) FILTER (order_date >= {DAY} - 365) AS orders_last_365d,
  coalesce(sum(CASE WHEN order_date >= {DAY} - 90 AND {REV} THEN net END), 0) AS rev90, coalesce(sum(CASE WHEN order_date >= {DAY} - 365 AND {REV} THEN net END), 0) AS rev365,
  count(*) FILTER (order_date >= {DAY} - 365 AND order_date < {DAY} - 90) AS orders_prior FROM sales GROUP BY customer),
osum AS (SELECT customer, first_order_date, last_order_date, total_orders, completed_orders, cancelled_orders, returned_orders, CAST(rev AS DOUBLE) AS total_net_revenue,
CAST(top AS DOUBLE) AS max_order_value, orders_last_90d, orders_last_365d,
  CAST(rev90 AS DOUBLE) AS revenue_last_90d, CAST(rev365 AS DOUBLE) AS revenue_last_365d, orders_prior, CAST(date_diff('day', last_order_date, {DAY}) AS INT) AS days_since_last_order,
  CASE WHEN nrev = 0 THEN 0.0 ELSE CAST((2 * CAST(rev * 100 AS BIGINT) + nrev) // (2 * nrev) AS DOUBLE) / 100 END AS avg_order_value,
  round(CAST(total_orders * 365 AS DOUBLE) / greatest(date_diff('day', first_order_date, {DAY}), 30), 4) AS order_frequency_per_year, round(CAST(returned_orders AS
DOUBLE) / nullif(total_orders, 0), 4) AS return_rate, {DAY} AS as_of_date,
  coalesce(cats.n, 0) AS distinct_categories, chan.channel AS primary_channel FROM osum0 LEFT JOIN cats USING (customer) LEFT JOIN chan USING (customer))
"""
SUPPORT = f"""
, ctype AS (SELECT customer, case_type FROM (SELECT customer, case_type, row_number() OVER (PARTITION BY customer ORDER BY count(*) DESC, case_type) AS r FROM cases
GROUP BY customer, case_type) WHERE r = 1),
ssum AS (SELECT customer, count(*) AS total_cases, count(*) FILTER (status = 'OPEN') AS open_cases, count(*) FILTER (opened_at >= CAST({NOW} - 90 AS TIMESTAMP)) AS
cases_last_90d, count(*) FILTER (opened_at >= CAST({NOW} - 365 AS TIMESTAMP)) AS cases_last_365d,
  CAST((2 * CAST(sum(csat) * 100 AS BIGINT) + count(csat)) // (2 * count(csat)) AS DOUBLE) / 100 AS avg_csat, min(csat) AS min_csat,
  CASE WHEN count(hours) > 0 THEN CAST((2 * CAST(sum(hours) * 100 AS BIGINT) + count(hours)) // (2 * count(hours)) AS DOUBLE) / 100 END AS avg_resolution_hours,
CAST(sum(reopens) AS BIGINT) AS total_reopens, count(*) FILTER (coalesce(hours, 999) > sla_hours) AS sla_breaches,
  max(CAST(opened_at AS DATE)) AS last_case_date, any_value(ctype.case_type) AS top_case_type, CAST(date_diff('day', max(CAST(opened_at AS DATE)), {NOW}) AS INT) AS
days_since_last_case FROM cases LEFT JOIN ctype USING (customer) GROUP BY customer)
"""
ENGAGEMENT = f"""
, seen AS (SELECT customer, count(*) FILTER (ts >= CAST({NOW} - 90 AS TIMESTAMP)) AS ix90, count(*) FILTER (ts >= CAST({NOW} - 365 AS TIMESTAMP)) AS ix365, count(*)
FILTER (ts >= CAST({NOW} - 90 AS TIMESTAMP) AND negative) AS neg90, max(CAST(ts AS DATE)) AS last_date, count(DISTINCT channel) AS chans FROM touches GROUP BY customer),
esum AS (SELECT c.customer, coalesce(ix90, 0) AS interactions_last_90d, coalesce(ix365, 0) AS interactions_last_365d, coalesce(neg90, 0) AS negative_signals_90d,
coalesce(chans, 0) AS distinct_channels, last_date AS last_interaction_date,
  CAST(date_diff('day', last_date, {NOW}) AS INT) AS days_since_interaction, round(greatest(0.0, least(100.0, 30 * greatest(CAST(0 AS DOUBLE), 1 -
CAST(coalesce(days_since_last_order, 999) AS DOUBLE) / 365) + 25 * least(CAST(1 AS DOUBLE), coalesce(order_frequency_per_year, 0) / 12)
  + 15 * least(CAST(1 AS DOUBLE), CAST(coalesce(ix90, 0) AS DOUBLE) / 10) + 15 * CAST(coalesce(tier_rank, 0) AS DOUBLE) / 4 + 15 * (CAST(coalesce(avg_csat, 3.5) AS
DOUBLE) - 1) / 4 - 10 * least(CAST(1 AS DOUBLE), CAST(coalesce(neg90, 0) AS DOUBLE) / 3))), 6) AS engagement_score
  FROM customers c LEFT JOIN seen USING (customer) LEFT JOIN osum USING (customer) LEFT JOIN ssum USING (customer) LEFT JOIN loyalty USING (customer))
"""
FEATURES = """
, feat AS (SELECT customer, coalesce(days_since_last_order, 9999) AS recency_days, coalesce(orders_last_365d, 0) AS frequency_365d, coalesce(revenue_last_365d, 0.0) AS
monetary_365d, coalesce(avg_order_value, 0.0) AS avg_order_value,
  coalesce(round((CAST(orders_last_90d AS DOUBLE) / 90) / nullif(CAST(orders_prior AS DOUBLE) / 275, 0), 4), 0.0) AS order_trend_ratio, coalesce(cases_last_90d, 0) AS
cases_90d, coalesce(open_cases, 0) AS open_cases, coalesce(avg_csat, 3.5) AS avg_csat,
  coalesce(total_reopens, 0) AS reopen_count, coalesce(sla_breaches, 0) AS sla_breaches, coalesce(tier_rank, 0) AS loyalty_tier_rank, coalesce(inactive_days, 9999) AS
loyalty_inactive_days, coalesce(engagement_score, 0.0) AS engagement_score,
  coalesce(negative_signals_90d, 0) AS negative_signals_90d, coalesce(return_rate, 0.0) AS return_rate FROM customers LEFT JOIN osum USING (customer) LEFT JOIN ssum
USING (customer) LEFT JOIN esum USING (customer) LEFT JOIN loyalty USING (customer))
"""
PARTS = """
, parts AS (SELECT customer, round(0.30 * least(1.0, CAST(recency_days AS DOUBLE) / 240), 6) AS "PURCHASE_RECENCY", round(0.20 * greatest(0.0, 1 - least(1.0,
order_trend_ratio)), 6) AS "DECLINING_ORDER_TREND", round(0.15 * least(1.0, CAST(cases_90d AS DOUBLE) / 3), 6) AS "SUPPORT_CASE_VOLUME",
  round(0.10 * greatest(0.0, (4 - least(5.0, avg_csat)) / 3), 6) AS "LOW_SATISFACTION", round(0.10 * greatest(0.0, 1 - engagement_score / 100), 6) AS "LOW_ENGAGEMENT",
round(0.08 * least(1.0, CAST(loyalty_inactive_days AS DOUBLE) / 365), 6) AS "LOYALTY_INACTIVITY",
  round(0.07 * least(1.0, CAST(negative_signals_90d AS DOUBLE) / 2), 6) AS "NEGATIVE_SIGNALS" FROM feat),
long AS (UNPIVOT parts ON COLUMNS(* EXCLUDE customer) INTO NAME driver VALUE contribution),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY contribution DESC, driver) AS rank FROM long),
score AS (SELECT p.customer, greatest(0.01, least(0.99, round(t, 4))) AS probability, CASE WHEN round(t, 4) >= 0.7 THEN 'CRITICAL' WHEN round(t, 4) >= 0.5 THEN 'HIGH'
WHEN round(t, 4) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS band, driver AS top_driver
  FROM (SELECT customer, "PURCHASE_RECENCY" + "DECLINING_ORDER_TREND" + "SUPPORT_CASE_VOLUME" + "LOW_SATISFACTION" + "LOW_ENGAGEMENT" + "LOYALTY_INACTIVITY" +
"NEGATIVE_SIGNALS" AS t FROM parts) p JOIN ranked r ON p.customer = r.customer AND r.rank = 1)
"""
ALL = WITH + ORDERS + SUPPORT + ENGAGEMENT + FEATURES + PARTS
WHOLE = """
, c360 AS (SELECT c.customer, c.segment, coalesce(total_orders, 0) AS total_orders, coalesce(total_net_revenue, 0.0) AS clv_realised,
CAST(round(CAST(coalesce(avg_order_value, 0.0) AS DECIMAL(18,2)) * CAST(coalesce(order_frequency_per_year, 0.0) AS DECIMAL(10,4)) * CAST(1 - coalesce(probability, 0.25)
AS DECIMAL(6,4)), 2) AS DOUBLE) AS clv_predicted,
  CASE WHEN coalesce(total_net_revenue, 0) >= 2000 THEN 'HIGH' WHEN coalesce(total_net_revenue, 0) >= 500 THEN 'MEDIUM' ELSE 'LOW' END AS value_tier,
coalesce(open_cases, 0) AS open_cases, engagement_score, coalesce(tier_rank, 0) AS tier_rank, band,
  round(CAST(100 * (CAST(name IS NOT NULL AS INT) + CAST(segment IS NOT NULL AS INT) + CAST(total_orders IS NOT NULL AS INT) + CAST(total_cases IS NOT NULL AS INT) +
CAST(tier_rank IS NOT NULL AS INT)) AS DOUBLE) / 5, 2) AS completeness,
  'CRM' || CASE WHEN total_orders IS NOT NULL THEN ',OMS' ELSE '' END || CASE WHEN total_cases IS NOT NULL THEN ',SUPPORT' ELSE '' END || CASE WHEN tier_rank IS NOT NULL
THEN ',LOYALTY' ELSE '' END || CASE WHEN last_interaction_date IS NOT NULL THEN ',ENGAGEMENT' ELSE '' END AS contributing_sources
  FROM customers c LEFT JOIN osum USING (customer) LEFT JOIN ssum USING (customer) LEFT JOIN esum USING (customer) LEFT JOIN loyalty USING (customer) LEFT JOIN score USING (customer))
"""


def _orders(s: SparkSession, d: str) -> DataFrame:
    return A.order_summary(M.sales(s, d), M.items(s, d), M.products(s, d), M.AS_OF)


def _support(s: SparkSession, d: str) -> DataFrame:
    return A.support_summary(M.cases(s, d), M.EVENT_AS_OF)


def _combined(s: SparkSession, d: str) -> DataFrame:
    return A.combined(M.customers(s, d), _orders(s, d), _support(s, d), M.touches(s, d), M.loyalty(s, d), M.EVENT_AS_OF)


@query(WITH + ORDERS + "SELECT * FROM osum")
def order_summary(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).drop("revenue_prior")


@query(WITH + SUPPORT + "SELECT * FROM ssum")
def support_summary(s: SparkSession, d: str) -> DataFrame:
    return _support(s, d)


@query(WITH + ORDERS + SUPPORT + ENGAGEMENT + "SELECT * FROM esum")
def engagement_score(s: SparkSession, d: str) -> DataFrame:
    return A.engagement_summary(_combined(s, d))


@query(WITH + ORDERS + SUPPORT + ENGAGEMENT + FEATURES + "SELECT * FROM feat")
def features_trend(s: SparkSession, d: str) -> DataFrame:
    return A.features(_combined(s, d))


@query(ALL + "SELECT * FROM parts")
def churn_contributions(s: SparkSession, d: str) -> DataFrame:
    return _combined(s, d).select("customer", "parts.*")


@query(ALL + "SELECT customer, CAST(rank AS INT) AS rank, driver, contribution FROM ranked WHERE rank <= 3")
def churn_drivers_unpivot(s: SparkSession, d: str) -> DataFrame:
    return A.drivers(_combined(s, d).select("customer", "parts.*"))


@query(ALL + "SELECT * FROM score")
def churn_score(s: SparkSession, d: str) -> DataFrame:
    return _combined(s, d).select("customer", "churn.*")


def _whole(s: SparkSession, d: str) -> DataFrame:
    return A.customer_360(_combined(s, d))


@query(ALL + WHOLE + "SELECT * FROM c360")
def customer_360(s: SparkSession, d: str) -> DataFrame:
    return _whole(s, d)


@query(ALL + WHOLE + "SELECT customer, band, clv_realised FROM c360 WHERE band IN ('HIGH', 'CRITICAL') ORDER BY clv_realised DESC, customer LIMIT 50")
def high_risk_cohort(s: SparkSession, d: str) -> DataFrame:
    return V.high_risk_cohort(_whole(s, d), 50)


@query(ALL + WHOLE + """, st AS (SELECT avg(clv_realised) AS m, stddev_samp(clv_realised) AS sd FROM c360) SELECT customer, clv_realised FROM c360, st WHERE clv_realised > m + 3 * sd""")
def revenue_outliers(s: SparkSession, d: str) -> DataFrame:
    whole = _whole(s, d).select("customer", "clv_realised")
    limit = whole.agg((F.avg("clv_realised") + 3 * F.stddev_samp("clv_realised")).alias("limit"))  # one row
    return whole.join(F.broadcast(limit), F.col("clv_realised") > F.col("limit")).drop("limit")


@query(ALL + WHOLE + """SELECT customer, CASE WHEN open_cases > 0 THEN 'RESOLVE_OPEN_CASE' WHEN band IN ('HIGH','CRITICAL') AND coalesce(days_since_last_order, 9999) >=
120 THEN 'RETENTION_OFFER_15_PCT' WHEN band IN ('HIGH','CRITICAL') THEN 'PROACTIVE_SERVICE_CALL' WHEN tier_rank = 0 THEN 'DOUBLE_POINTS_MONTH' ELSE 'NO_ACTION' END AS
action,
  CASE WHEN open_cases > 0 THEN 'HIGH' WHEN band IN ('HIGH','CRITICAL') AND coalesce(days_since_last_order, 9999) >= 120 THEN 'HIGH' WHEN band IN ('HIGH','CRITICAL')
THEN 'MEDIUM' ELSE 'LOW' END AS priority, segment = 'BUILDING' OR value_tier = 'HIGH' AS vip FROM c360 LEFT JOIN osum USING (customer)""")
def next_best_action(s: SparkSession, d: str) -> DataFrame:
    return V.next_best_action(A.customer_360(_combined(s, d), "days_since_last_order"), premium="BUILDING")


@query(WITH + "SELECT customer, count(DISTINCT category) AS distinct_categories FROM sales JOIN items USING (order_id) JOIN products USING (product) GROUP BY customer")
def star_join_categories(s: SparkSession, d: str) -> DataFrame:
    return A.categories(M.sales(s, d), M.items(s, d), M.products(s, d))


@query(WITH + "SELECT customer, channel AS primary_channel FROM (SELECT customer, channel, row_number() OVER (PARTITION BY customer ORDER BY count(*) DESC, channel) AS r "
    "FROM sales GROUP BY customer, channel) WHERE r = 1")
def primary_channel_mode(s: SparkSession, d: str) -> DataFrame:
    return most_common(M.sales(s, d), "customer", "channel", "primary_channel")
