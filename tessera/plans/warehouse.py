"""Queries of the core layer, the full customer view, dated features and the whole catalogue of rules, over the driver's tables with defects planted by key."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import EMAIL_VALID, clean
from tessera.operators import analytics as A
from tessera.operators import build, core, serving
from tessera.operators import policies as P
from tessera.operators import quality as Q
from tessera.operators.rules import rules
from tessera.plans import governance as G
from tessera.plans import mapping as M
from tessera.plans.customer import ALL, DAY, _combined, _orders, _support
from tessera.plans.registry import query
from tessera.sources.store import Store, scratch

AT = dt.datetime(2001, 8, 1)
RULES = rules(DAY, "TIMESTAMP '2001-08-02 06:00:00'")

_RAW = """raw_customer AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS customer_id,
  CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'bad#address' WHEN c_custkey % 53 = 0 THEN 'CUSTOMER' || (c_custkey - 1) || '@EXAMPLE.COM ' ELSE
'customer' || c_custkey || '@example.com' END AS email,
  CASE WHEN c_custkey % 211 = 0 THEN DATE '1899-12-31' WHEN c_custkey % 17 <> 0 THEN DATE '1950-01-01' + CAST(c_custkey % 15000 AS INT) END AS birth_date,
  CASE WHEN c_custkey % 61 = 0 THEN 'LOST' WHEN c_custkey % 9 <> 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END END AS status, DATE '1994-01-01' +
CAST(c_custkey % 900 AS INT) AS created_at FROM customer),
stg_customer AS (SELECT customer_id AS customer, lower(trim(email)) AS email, lower(trim(email)) LIKE '%@%.%' AS email_is_valid, birth_date, status FROM raw_customer WHERE customer_id IS NOT NULL)"""
_VERSIONS = """core_customer AS (SELECT CAST(c_custkey AS VARCHAR) AS customer, md5(CAST(c_custkey AS VARCHAR) || '|' || CAST(f AS VARCHAR)) AS customer_sk, f AS
valid_from, t AS valid_to, t > TIMESTAMP '9000-01-01 00:00:00' AS is_current
  FROM customer, (VALUES (TIMESTAMP '1990-01-01 00:00:00', TIMESTAMP '1998-01-01 00:00:00', 0), (TIMESTAMP '1998-01-01 00:00:00', TIMESTAMP '9999-12-31 00:00:00', 0),
(TIMESTAMP '1990-01-01 00:00:00', TIMESTAMP '9999-12-31 00:00:00', 1)) v(f, t, one)
  WHERE c_custkey % 13 <> 0 AND one = CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 1 END)"""
_PROFILE = """profiles AS (SELECT c_custkey AS customer, md5(CAST(c_custkey AS VARCHAR) || '|' || '1998-01-01 00:00:00') AS customer_sk, md5(coalesce(email, c_name)) AS
master_customer_id, c_name AS full_name, email, CASE WHEN k % 41 = 0 THEN '' WHEN k % 43 <> 0 THEN '+1402' || k END AS phone, birth_date,
  c_mktsegment AS segment, CASE k % 3 WHEN 0 THEN 'WEB' WHEN 1 THEN 'STORE' END AS preferred_channel, k % 3 = 0 AS marketing_opt_in, status, created_at FROM customer
JOIN raw_customer ON k = c_custkey),
addresses AS (SELECT c_custkey AS customer, type AS address_type, type = 'WORK' AND c_custkey % 2 = 0 AS is_primary, 'City' || (c_custkey % 100) || type AS city, 'S' ||
(c_custkey % 7) AS state, 'US' AS country FROM customer, (VALUES ('HOME'), ('WORK')) t(type) WHERE c_custkey % 5 <> 0),
address AS (SELECT customer, city, state, country FROM addresses QUALIFY row_number() OVER (PARTITION BY customer ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END, address_type, city) = 1),
account AS (SELECT customer, 'L' || customer AS loyalty_account, CASE tier_rank WHEN 4 THEN 'PLATINUM' WHEN 3 THEN 'GOLD' WHEN 2 THEN 'SILVER' WHEN 1 THEN 'BRONZE' ELSE
'NONE' END AS tier, CASE WHEN customer % 6 = 0 THEN 'LAPSED' ELSE 'ACTIVE' END AS loyalty_status, CAST(customer * 10 AS BIGINT) AS points_balance,
  DATE '1995-01-01' + CAST(customer % 700 AS INT) AS loyalty_enrolled_at, DATE '2001-01-01' + CAST(customer % 200 AS INT) AS last_activity_at FROM loyalty)"""
_SINCE = "least(p.created_at, coalesce(o.first_order_date, p.created_at))"
FULL_COLUMNS = f"""SELECT p.customer, p.customer_sk, p.master_customer_id, p.full_name, p.email, p.phone, p.birth_date, p.segment, p.preferred_channel,
p.marketing_opt_in, p.status AS customer_status, {_SINCE} AS customer_since, CAST(date_diff('day', {_SINCE}, {DAY}) AS INT) AS tenure_days, a.city, a.state, a.country,
  coalesce(o.total_orders, 0) AS total_orders, coalesce(o.total_net_revenue, 0.0) AS total_net_revenue, coalesce(o.avg_order_value, 0.0) AS avg_order_value,
coalesce(o.order_frequency_per_year, 0.0) AS order_frequency_per_year, o.last_order_date, o.days_since_last_order, coalesce(o.revenue_last_365d, 0.0) AS
revenue_last_365d, coalesce(o.return_rate, 0.0) AS return_rate, o.primary_channel AS primary_order_channel,
  coalesce(s.total_cases, 0) AS total_cases, coalesce(s.open_cases, 0) AS open_cases, coalesce(s.cases_last_90d, 0) AS cases_last_90d, s.avg_csat,
s.avg_resolution_hours, s.top_case_type, l.loyalty_account, coalesce(l.tier, 'NONE') AS loyalty_tier, coalesce(l.loyalty_status, 'NOT_ENROLLED') AS loyalty_status,
coalesce(l.points_balance, 0) AS loyalty_points_balance, l.loyalty_enrolled_at,
  CAST(date_diff('day', l.last_activity_at, {DAY}) AS INT) AS days_since_loyalty_activity, coalesce(e.interactions_last_90d, 0) AS interactions_last_90d,
coalesce(e.negative_signals_90d, 0) AS negative_signals_90d, coalesce(e.engagement_score, 0.0) AS engagement_score, round(coalesce(o.total_net_revenue, 0.0), 2) AS
customer_lifetime_value,
  CAST(round(CAST(coalesce(o.avg_order_value, 0.0) AS DECIMAL(18,2)) * CAST(coalesce(o.order_frequency_per_year, 0.0) AS DECIMAL(10,4)) * CAST(1 -
coalesce(c.probability, 0.25) AS DECIMAL(6,4)), 2) AS DOUBLE) AS predicted_clv_12m, CASE WHEN coalesce(o.total_net_revenue, 0) >= 2000 THEN 'HIGH' WHEN
coalesce(o.total_net_revenue, 0) >= 500 THEN 'MEDIUM' ELSE 'LOW' END AS value_tier, c.band,
  round(CAST(100 * (CAST(p.email IS NOT NULL AS INT) + CAST(coalesce(p.phone <> '', false) AS INT) + CAST(p.birth_date IS NOT NULL AS INT) + CAST(a.city IS NOT NULL AS
INT) + CAST(p.segment IS NOT NULL AS INT) + CAST(o.customer IS NOT NULL AS INT) + CAST(l.customer IS NOT NULL AS INT) + CAST(s.customer IS NOT NULL AS INT)) AS DOUBLE) /
8, 2) AS data_completeness_score,
  'CRM' || CASE WHEN o.customer IS NOT NULL THEN ',OMS' ELSE '' END || CASE WHEN s.customer IS NOT NULL THEN ',SUPPORT' ELSE '' END || CASE WHEN l.customer IS NOT NULL
THEN ',LOYALTY' ELSE '' END || CASE WHEN e.customer IS NOT NULL THEN ',ENGAGEMENT' ELSE '' END AS contributing_sources, TIMESTAMP '2001-08-01 00:00:00' AS as_of_timestamp
  FROM profiles p LEFT JOIN osum o USING (customer) LEFT JOIN ssum s USING (customer) LEFT JOIN esum e USING (customer) LEFT JOIN account l USING (customer) LEFT JOIN
address a USING (customer) LEFT JOIN score c USING (customer)"""
_FULL = f"full360 AS ({FULL_COLUMNS})"
_DATED = f"""dated AS (SELECT f.customer, {DAY} AS feature_date, f.* EXCLUDE customer, CAST(date_diff('day', p.created_at, {DAY}) AS INT) AS tenure_days,
coalesce(round((near / 90) / nullif(prior / 275, 0), 4), 0.0) AS revenue_trend_ratio, '{core.FEATURE_SET}' AS feature_set_version FROM feat f JOIN profiles p USING
(customer)
  LEFT JOIN (SELECT customer, CAST(coalesce(sum(net) FILTER (order_date >= {DAY} - 90 AND status IN ('COMPLETED','SHIPPED')), 0) AS DOUBLE) AS near,
CAST(coalesce(sum(net) FILTER (order_date < {DAY} - 90 AND order_date >= {DAY} - 365 AND status IN ('COMPLETED','SHIPPED')), 0) AS DOUBLE) AS prior FROM sales GROUP BY
customer) USING (customer))"""
WAREHOUSE = f"{ALL}, {_RAW}, {_VERSIONS}, {_PROFILE}, {_FULL}, {_DATED}"


def _raw_customers(s: SparkSession, d: str) -> DataFrame:
    k, text = F.col("c_custkey"), lambda x: x.cast("string")
    email = F.when(k % 31 == 0, None).when(k % 37 == 0, "bad#address").when(k % 53 == 0,
        F.concat(F.lit("CUSTOMER"), text(k - 1), F.lit("@EXAMPLE.COM "))).otherwise(F.concat(F.lit("customer"), text(k), F.lit("@example.com")))
    born = F.when(k % 211 == 0, F.lit(dt.date(1899, 12, 31))).when(k % 17 != 0, F.date_add(F.lit(dt.date(1950, 1, 1)), (k % 15000).cast("int")))
    status = F.when(k % 61 == 0, "LOST").when(k % 9 != 0, F.when(k % 4 == 0, "INACTIVE").otherwise("ACTIVE"))
    return M.load(s, d, "customer").select(k.alias("k"), F.when(k % 97 != 0, text(k)).alias("customer_id"), email.alias("email"), born.alias("birth_date"),
        status.alias("status"), F.date_add(F.lit(dt.date(1994, 1, 1)), (k % 900).cast("int")).alias("created_at"), "c_name", "c_mktsegment")


def _profiles(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    phone = F.when(k % 41 == 0, "").when(k % 43 != 0, F.concat(F.lit("+1402"), k.cast("string")))
    sk = core.surrogate(k, F.lit("1998-01-01 00:00:00"))
    return _raw_customers(s, d).select(k.alias("customer"), sk.alias("customer_sk"), F.md5(F.coalesce("email", "c_name")).alias("master_customer_id"),
        F.col("c_name").alias("full_name"), "email", phone.alias("phone"), "birth_date", F.col("c_mktsegment").alias("segment"),
        F.when(k % 3 == 0, "WEB").when(k % 3 == 1, "STORE").alias("preferred_channel"), (k % 3 == 0).alias("marketing_opt_in"), "status", "created_at")


def _versions(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("c_custkey"), lambda x: F.lit(x).cast("timestamp")
    span = lambda a, b: F.struct(t(a).alias("valid_from"), t(b).alias("valid_to"))
    old, mid, end = "1990-01-01", "1998-01-01", "9999-12-31"
    both = F.explode(F.when(k % 10 == 0, F.array(span(old, mid), span(mid, end))).otherwise(F.array(span(old, end))))
    v = M.load(s, d, "customer").where("c_custkey % 13 <> 0").select(k.cast("string").alias("customer"), both.alias("v")).select("customer", "v.*")
    return v.select("customer", core.surrogate(F.col("customer"), F.col("valid_from")).alias("customer_sk"), "valid_from", "valid_to", (F.col("valid_to") > t("9000-01-01")).alias("is_current"))


def _accounts(s: SparkSession, d: str) -> DataFrame:
    k, rank = F.col("customer"), F.col("tier_rank")
    tier = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for name, n in core.TIER_RANK.items() for x in (n, name))), rank), F.lit("NONE"))
    return M.loyalty(s, d).select("*", F.concat(F.lit("L"), k.cast("string")).alias("loyalty_account"), tier.alias("tier"),
        F.when(k % 6 == 0, "LAPSED").otherwise("ACTIVE").alias("loyalty_status"), (k * 10).alias("points_balance"),
        F.date_add(F.lit(dt.date(1995, 1, 1)), (k % 700).cast("int")).alias("loyalty_enrolled_at"),
        F.date_add(F.lit(dt.date(2001, 1, 1)), (k % 200).cast("int")).alias("last_activity_at"))


def _addresses(s: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("c_custkey"), F.col("address_type")
    a = M.load(s, d, "customer").where("c_custkey % 5 <> 0").withColumn("address_type", F.explode(F.array(F.lit("HOME"), F.lit("WORK"))))
    return a.select(k.alias("customer"), "address_type", ((kind == "WORK") & (k % 2 == 0)).alias("is_primary"),
        F.concat(F.lit("City"), (k % 100).cast("string"), kind).alias("city"), F.concat(F.lit("S"), (k % 7).cast("string")).alias("state"), F.lit("US").alias("country"))


def _all(s: SparkSession, d: str) -> DataFrame:
    return A.combined(_profiles(s, d), _orders(s, d), _support(s, d), M.touches(s, d), _accounts(s, d), M.EVENT_AS_OF)


def _scores(all_of: DataFrame) -> DataFrame:
    """Scores, of which every second is of the day before."""
    return all_of.select("customer", "churn.*", F.date_sub(F.lit(M.AS_OF), (F.col("customer") % 2).cast("int")).alias("score_date"))


@query(f"{WAREHOUSE} SELECT * EXCLUDE as_of_timestamp FROM full360")
def customer_360_full(s: SparkSession, d: str) -> DataFrame:
    return core.full_view(_all(s, d), _addresses(s, d), M.AS_OF, AT).drop("as_of_timestamp")


@query(f"{WAREHOUSE} SELECT * FROM dated")
def features_dated(s: SparkSession, d: str) -> DataFrame:
    return core.dated_features(_all(s, d), M.AS_OF)


@query(f"{WAREHOUSE} SELECT customer, feature_date, tenure_days, recency_days, probability, band FROM dated JOIN (SELECT customer, {DAY} - CAST(customer % 2 AS INT) AS "
    f"feature_date, probability, band FROM score) USING (customer, feature_date)")
def feature_score_join(s: SparkSession, d: str) -> DataFrame:
    rows = _all(s, d)
    return core.scored_features(core.dated_features(rows, M.AS_OF), _scores(rows)).select("customer", "feature_date", "tenure_days", "recency_days", "probability", "band")


@query(f"WITH {G.STAGED}, {_VERSIONS} SELECT md5(order_id) AS sk, order_id, s.customer, customer_sk, order_date, status, amount, status IN ('COMPLETED','SHIPPED') AS "
    f"is_revenue_recognised FROM staged s LEFT JOIN core_customer c ON c.customer = s.customer AND CAST(order_date AS TIMESTAMP) >= valid_from AND CAST(order_date AS "
    f"TIMESTAMP) < valid_to WHERE dq_status <> 'FAIL'")
def core_orders(s: SparkSession, d: str) -> DataFrame:
    out = core.orders(G._staged(s, d), _versions(s, d))
    return out.select("sk", "order_id", "customer", "customer_sk", "order_date", "status", F.col("amount").cast("double").alias("amount"), "is_revenue_recognised")


_TABLES = f"""raw_order AS (SELECT CASE WHEN o_orderkey % 333 = 0 THEN NULL ELSE o_orderkey END AS order_id FROM orders), stg_order AS (SELECT * FROM staged), core_order
AS (SELECT * FROM staged WHERE dq_status <> 'FAIL'),
stg_order_item AS (SELECT CASE WHEN l_orderkey % 400 = 1 THEN -l_partkey ELSE l_partkey END AS product, CASE WHEN l_orderkey % 150 = 0 THEN 2 ELSE 1 END AS quantity,
CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_amount FROM lineitem), stg_product AS (SELECT p_partkey AS product
FROM part),
stg_case AS (SELECT ts AS opened_at, CASE WHEN event_id % 90 = 0 THEN ts - INTERVAL 1 HOUR WHEN event_id % 2 = 0 THEN ts + INTERVAL 1 HOUR END AS resolved_at, event_id %
7 AS csat FROM events WHERE event_type = 'error'),
stg_loyalty AS (SELECT c_custkey % 100 * 10 AS earned, CASE WHEN c_custkey % 45 = 0 THEN c_custkey % 100 * 10 + 5 ELSE 0 END AS redeemed FROM customer),
customer_360 AS (SELECT CAST(customer AS VARCHAR) AS customer, total_net_revenue, as_of_timestamp FROM full360), features AS (SELECT customer, feature_date FROM dated),
churn_score AS (SELECT customer, probability, {DAY} - CAST(customer % 2 AS INT) AS score_date FROM score)"""
_RESULTS = (
    f"{WAREHOUSE}, {G.STAGED}, {_TABLES}, found AS ("
    + " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, CAST({r.threshold} AS DOUBLE) "
        f"AS thr, ({r.failed or f'SELECT count(*) FROM {r.table} WHERE {r.where}'}) AS n, (SELECT count(*) FROM {r.table}) AS m" for r in RULES)
    + "), results AS (SELECT rule_id, severity, CAST(n AS BIGINT) AS rows_failed, m AS rows_evaluated, round(CAST(n AS DOUBLE) * 100 / m, 4) AS fail_pct, CASE WHEN n = 0 "
        "OR CAST(n AS DOUBLE) * 100 / m <= thr THEN 'PASS' WHEN severity = 'BLOCKING' THEN 'FAIL' WHEN severity = 'WARNING' THEN 'WARN' ELSE 'PASS' END "
        "AS status FROM found)"
)


def rule_steps(s: SparkSession, d: str) -> list[build.Step]:
    """The tables that rules read, each computed once."""
    email = F.lower(clean(F.col("email")))
    k, i, price = F.col("c_custkey"), F.col("event_id"), F.col("l_extendedprice").cast("decimal(18,2)")
    hour = F.expr("INTERVAL 1 HOUR")
    step = build.Step
    return [
        step("raw_customer", lambda: _raw_customers(s, d)),
        step("stg_customer", lambda raw: raw.where("customer_id IS NOT NULL").select(F.col("customer_id").alias("customer"), email.alias("email"),
            email.rlike(EMAIL_VALID).alias("email_is_valid"), "birth_date", "status"), ("raw_customer",)),
        step("raw_order", lambda: M.load(s, d, "orders").select(F.when(F.col("o_orderkey") % 333 != 0, F.col("o_orderkey")).alias("order_id"))),
        step("stg_order", lambda: G._staged(s, d)),
        step("core_order", lambda staged: staged.where("dq_status <> 'FAIL'"), ("stg_order",)),
        step("stg_order_item", lambda: M.load(s, d, "lineitem").select(F.when(F.col("l_orderkey") % 400 == 1,
            -F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("product"), F.when(F.col("l_orderkey") % 150 == 0, 2).otherwise(1).alias("quantity"),
            price.alias("unit_price"), price.alias("line_amount"))),
        step("stg_product", lambda: M.load(s, d, "part").select(F.col("p_partkey").alias("product"))),
        step("stg_case", lambda: M.load(s, d, "events").where("event_type = 'error'").select(F.col("ts").alias("opened_at"),
            F.when(i % 90 == 0, F.col("ts") - hour).when(i % 2 == 0, F.col("ts") + hour).alias("resolved_at"), (i % 7).alias("csat"))),
        step("stg_loyalty", lambda: M.load(s, d, "customer").select((k % 100 * 10).alias("earned"), F.when(k % 45 == 0, k % 100 * 10 + 5).otherwise(0).alias("redeemed"))),
        step("core_customer", lambda: _versions(s, d)),
        step("combined", lambda: _all(s, d)),
        step("customer_360", lambda rows: core.full_view(rows, _addresses(s, d), M.AS_OF, AT).select(F.col("customer").cast("string").alias("customer"),
            "total_net_revenue", "as_of_timestamp"), ("combined",)),
        step("features", lambda rows: core.dated_features(rows, M.AS_OF).select("customer", "feature_date"), ("combined",)),
        step("churn_score", lambda rows: _scores(rows).select("customer", "probability", "score_date"), ("combined",)),
    ]


def _ruled(s: SparkSession, d: str) -> DataFrame:
    """Results of all rules over tables that are written first."""
    store = Store(s, scratch(s, "ruled"))
    build.run(store, rule_steps(s, d), "all")
    return Q.execute(s, RULES, {n: store.read(n) for n in store.head().tables})


@query(f"{_RESULTS} SELECT * FROM results")
def dq_catalogue(s: SparkSession, d: str) -> DataFrame:
    """All rules."""
    return _ruled(s, d)


@query(f"{_RESULTS}, r AS (VALUES " + ", ".join(f"('{r.rule_id}', '{r.name}', '{r.dimension}', '{r.table}')" for r in RULES) + ") SELECT rule_id, rule_name, dimension, "
    "target_table, severity, rows_failed, rows_evaluated, fail_pct, status FROM r t(rule_id, rule_name, dimension, target_table) JOIN results USING (rule_id)")
def dq_scorecard(s: SparkSession, d: str) -> DataFrame:
    return Q.scorecard(Q.catalogue(s, RULES), _ruled(s, d))


_DUPLICATE = "row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY k) > 1 AND email IS NOT NULL"


@query(f"WITH {G.STAGED}, {_RAW} SELECT md5('DQ-C-001' || coalesce(email, CAST(k AS VARCHAR))) AS reject_id, 'DQ-C-001' AS rule_id, 'BLOCKING' AS severity, "
    f"coalesce(email, '(no key)') AS record_key, 'Customer record has no business key and cannot be identified or deduplicated.' AS reason FROM raw_customer WHERE "
    f"customer_id IS NULL OR trim(customer_id) = '' "
       "UNION ALL SELECT md5('DQ-O-002' || order_id), 'DQ-O-002', 'BLOCKING', order_id, 'Order amount is null or negative: ' || coalesce(CAST(CAST(amount AS "
           "DECIMAL(18,2)) AS VARCHAR), 'NULL') FROM staged WHERE amount IS NULL OR amount < 0 "
       f"UNION ALL SELECT md5('DQ-O-003' || order_id), 'DQ-O-003', 'BLOCKING', order_id, 'Order date is in the future: ' || coalesce(CAST(order_date AS VARCHAR), 'NULL') "
           f"FROM staged WHERE order_date IS NULL OR order_date > {DAY} - 30 "
       f"UNION ALL SELECT md5('DQ-C-005' || customer_id), 'DQ-C-005', 'WARNING', customer_id, 'Suppressed as a duplicate of an existing customer with the same e-mail.' "
           f"FROM (SELECT *, {_DUPLICATE} AS again FROM raw_customer WHERE customer_id IS NOT NULL) WHERE again")  # fmt: skip
def quarantine_rules(s: SparkSession, d: str) -> DataFrame:
    """Rejected rows of four rules with their reasons; the day is 30 days earlier, so that some orders are in the future."""
    raw, staged = _raw_customers(s, d).withColumn("row_id", F.col("k").cast("string")), G._staged(s, d)
    kept = Q.survivors(raw.where("customer_id IS NOT NULL"), F.coalesce(F.lower(clean(F.col("email"))), F.col("row_id")), F.col("k"))
    return Q.rejected(raw, staged, kept, M.AS_OF - dt.timedelta(days=30))


_LOCAL = "split_part(email, '@', 1)"
_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"


@query(f"""WITH {_RAW}, {_PROFILE.partition("addresses AS")[0].strip().rstrip(",")} SELECT customer, CASE WHEN contains(email, '@') THEN left(email, 1) || repeat('*',
greatest(length({_LOCAL}) - 1, 3)) || '@' || split_part(email, '@', 2) END AS email, CASE WHEN phone IS NULL OR phone = '' THEN phone WHEN length({_DIGITS}) >= 4 THEN
'***-***-' || right({_DIGITS}, 4) ELSE '***' END AS phone,
CASE WHEN birth_date IS NOT NULL THEN strftime(birth_date, '%Y') || '-**-**' END AS birth_date, 'Ann ' || left(n, 1) || repeat('*', greatest(length(n) - 1, 2)) AS
full_name, true AS masked, 'birth_date,email,full_name,phone' AS masked_fields FROM (SELECT *, CAST(customer AS VARCHAR) AS n FROM profiles)""")
def mask_profile(s: SparkSession, d: str) -> DataFrame:
    """Profiles of a caller without the right to see them; addresses without @ don't show."""
    p = _profiles(s, d).select("customer", F.when(F.contains("email", F.lit("@")), F.col("email")).alias("email"), "phone", "birth_date",
        F.concat(F.lit("Ann "), F.col("customer").cast("string")).alias("full_name"))
    return P.api_profile(p, False).withColumn("masked_fields", F.array_join("masked_fields", ","))


@query(f"""{WAREHOUSE}, n AS (SELECT customer, count(*) AS n_orders, max(order_date) AS newest FROM sales GROUP BY customer) SELECT customer, least(coalesce(n_orders,
0), 3) AS n_orders, newest, loyalty_tier, probability, r.driver AS first_driver, len(string_split(contributing_sources, ',')) AS n_sources, true AS partial, 'cases' AS
degraded
FROM full360 LEFT JOIN n USING (customer) LEFT JOIN score USING (customer) LEFT JOIN (SELECT customer, driver FROM ranked WHERE rank = 1) r USING (customer)""")
def customer_document(s: SparkSession, d: str) -> DataFrame:
    """Nested documents, read back; the branch of cases fails while it runs (text that is cast to a number) and is left out alone."""
    store = Store(s, scratch(s, "document"))
    read, failed = serving.branches(store, {"rows": lambda: _all(s, d), "addresses": lambda: _addresses(s, d), "orders": lambda: M.sales(s, d),
        "cases": lambda: M.cases(s, d).withColumn("case_type", F.col("case_type").cast("int"))}, needed=("rows", "addresses"))
    rows = read["rows"]
    doc = serving.nested(core.full_view(rows, read["addresses"], M.AS_OF, AT), read["orders"], read["cases"], rows.select("customer", "churn.*"), A.drivers(rows.select("customer", "parts.*")), 3)
    x = F.col("document")
    return doc.select("customer", F.size(x["orders"]).cast("long").alias("n_orders"), F.get(x["orders"], F.lit(0))["order_date"].alias("newest"),
        x["loyalty"]["loyaltyTier"].alias("loyalty_tier"), x["churnRisk"]["probability"].alias("probability"),
        x["churnRisk"]["drivers"][0]["driver"].alias("first_driver"), F.size(x["dataQuality"]["contributingSources"]).cast("long").alias("n_sources"),
        x["partial"].alias("partial"), F.array_join(x["degradedFields"], ",").alias("degraded"))
