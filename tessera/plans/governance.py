"""Queries of staging, history, quality, policies and operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import exprs as X
from tessera.operators import build, canonical
from tessera.operators import policies as P
from tessera.operators import quality as Q
from tessera.operators import scd2, serving, staging
from tessera.plans import mapping as M
from tessera.plans.customer import DAY, WITH
from tessera.plans.registry import query
from tessera.sources.store import Store, scratch

HASH = "md5(coalesce(event_type, ''))"
HISTORY = f"""hist0 AS (SELECT user_id AS customer, event_type, ts, event_id, {HASH} AS row_hash, lag({HASH}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
hist AS (SELECT customer, event_type, row_hash, ts AS valid_from, coalesce(lead(ts) OVER w, TIMESTAMP '9999-12-31 00:00:00') AS valid_to, lead(ts) OVER w IS NULL AS
is_current, row_number() OVER w AS version, CASE WHEN before IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS change_type
  FROM hist0 WHERE before IS NULL OR before <> row_hash WINDOW w AS (PARTITION BY customer ORDER BY ts, event_id))"""
_STATUS = ("COMPLETED", "SHIPPED", "CANCELLED", "RETURNED")


def _raw_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders as a source would send them: text, with every 50th amount unreadable, every 70th negative and each 10th order sent twice."""
    k = F.col("o_orderkey")
    amount = F.when(k % 50 == 0, "n/a").when(k % 70 == 0, F.lit("-1.00")).otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    copies = F.explode(F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    o = M.load(s, d, "orders").withColumn("copy", copies)
    status = F.when(F.col("o_orderstatus") == "F", " completed").when(F.col("o_orderstatus") == "O", "SHIPPED ").otherwise("lost")
    return o.select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer"),
        F.to_date("o_orderdate").cast("string").alias("order_date"), status.alias("status"), F.lower("o_orderpriority").alias("channel"),
        F.when(k % 60 == 0, "chf").when(k % 4 != 0, "usd").alias("currency"), amount.alias("amount"), F.lit("1.005").alias("discount"),
        F.date_add(F.to_date("o_orderdate"), F.col("copy")).cast("string").alias("updated_at"))


RAW_ORDERS = """raw AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
CASE o_orderstatus WHEN 'F' THEN ' completed' WHEN 'O' THEN 'SHIPPED ' ELSE 'lost' END AS status, lower(o_orderpriority) AS channel, CASE WHEN o_orderkey % 60 = 0 THEN
'chf' WHEN o_orderkey % 4 <> 0 THEN 'usd' END AS currency,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' WHEN o_orderkey % 70 = 0 THEN '-1.00' ELSE ' ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount, '1.005'
AS discount, CAST(CAST(o_orderdate AS DATE) + copy AS VARCHAR) AS updated_at
  FROM orders, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR o_orderkey % 10 = 0)"""
STAGED = f"""{RAW_ORDERS}, typed AS (SELECT trim(order_id) AS order_id, trim(customer) AS customer, try_cast(order_date AS DATE) AS order_date, upper(trim(status)) AS
status, upper(trim(channel)) AS channel, upper(coalesce(currency, 'USD')) AS currency, try_cast(amount AS DECIMAL(18,2)) AS amount, coalesce(try_cast(discount AS
DECIMAL(18,2)), 0) AS discount, try_cast(updated_at AS TIMESTAMP) AS updated_at FROM raw),
flags AS (SELECT *, coalesce(amount IS NULL OR amount < 0, false) AS f2, coalesce(order_date IS NULL OR order_date > {DAY}, false) AS f3, coalesce(status NOT IN
('COMPLETED','SHIPPED','CANCELLED','RETURNED','PENDING'), false) AS w4, currency NOT IN ('USD','EUR','GBP','CAD') AS w5 FROM typed),
staged AS (SELECT order_id, customer, order_date, status, channel, currency, CAST(amount AS DOUBLE) AS amount, CAST(coalesce(amount, 0) - discount AS DOUBLE) AS net,
coalesce(amount, 0) - discount AS exact, CASE WHEN f2 OR f3 THEN 'FAIL' WHEN w4 OR w5 THEN 'WARN' ELSE 'PASS' END AS dq_status,
  nullif(concat_ws(' ', CASE WHEN f2 THEN 'DQ-O-002' END, CASE WHEN f3 THEN 'DQ-O-003' END, CASE WHEN w4 THEN 'DQ-O-004' END, CASE WHEN w5 THEN 'DQ-O-005' END), '') AS
dq_failed_rules FROM flags QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY updated_at DESC NULLS LAST) = 1)"""


def _staged(s: SparkSession, d: str) -> DataFrame:
    return staging.stage(_raw_orders(s, d), staging.orders_spec(M.AS_OF))


@query(f"WITH {STAGED} SELECT * EXCLUDE exact FROM staged")
def dq_flags(s: SparkSession, d: str) -> DataFrame:
    return _staged(s, d).select("order_id", "customer", "order_date", "status", "channel", "currency", F.col("amount").cast("double").alias("amount"),
        F.col("net").cast("double").alias("net"), "dq_status", "dq_failed_rules")


@query(f"WITH {RAW_ORDERS} SELECT order_id, try_cast(order_date AS DATE) AS order_date, CAST(try_cast(amount AS DECIMAL(18,2)) AS DOUBLE) AS amount, try_cast(status AS INT) AS status_number FROM raw")
def typed_try_cast(s: SparkSession, d: str) -> DataFrame:
    return _raw_orders(s, d).select("order_id", X.typed(F.col("order_date"), "date").alias("order_date"),
        X.typed(F.col("amount"), "decimal(18,2)").cast("double").alias("amount"), X.typed(F.col("status"), "int").alias("status_number"))


@query("""SELECT event_id, CASE WHEN lower(trim(t)) IN ('true','1','y','yes') THEN true WHEN lower(trim(t)) IN ('false','0','n','no') THEN false END AS three_valued, coalesce(lower(trim(t)) IN ('true','1','y','yes'), false) AS two_valued FROM (SELECT event_id, [' Yes','1','TRUE','n','No ','0','maybe',NULL][event_id % 8 + 1] AS t FROM events)""")
def bool_lenient(s: SparkSession, d: str) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, (" Yes", "1", "TRUE", "n", "No ", "0", "maybe", None))), (F.col("event_id") % 8 + 1).cast("int"))
    return M.load(s, d, "events").select("event_id", X.lenient_bool(t).alias("three_valued"), X.lenient_bool(t, False).alias("two_valued"))


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1")
def dedupe_latest(s: SparkSession, d: str) -> DataFrame:
    return X.latest(M.load(s, d, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], F.desc_nulls_last("ts"), F.desc("event_id"))


@query("SELECT doc_id, match_key FROM (SELECT doc_id, md5(lower(trim(text))) AS match_key FROM documents) QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY doc_id) = 1")
def survivorship_two_stage(s: SparkSession, d: str) -> DataFrame:
    keyed = M.load(s, d, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("match_key"))
    return staging.survivors(keyed, "match_key", "doc_id", "doc_id")


@query("SELECT c_custkey, md5(concat_ws('|', coalesce(c_name, ''), coalesce(CAST(c_nationkey AS VARCHAR), ''), coalesce(c_mktsegment, ''))) AS row_hash FROM customer")
def row_hash(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "customer").select("c_custkey", X.key(F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")).alias("row_hash"))


def _history(s: SparkSession, d: str) -> DataFrame:
    log = M.load(s, d, "events").select(F.col("user_id").alias("customer"), "event_type", "ts", "event_id")
    return scd2.history(log, "customer", "ts", ["event_type"], "event_id")


def _text(df: DataFrame, *times: str) -> DataFrame:
    """Times as text, so that both engines show them alike."""
    return df.withColumns({t: F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS") for t in times})


_T = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"


@query(f"WITH {HISTORY} SELECT customer, event_type, row_hash, {_T.format('valid_from')}, {_T.format('valid_to')}, is_current, CAST(version AS INT) AS version, change_type FROM hist")
def scd2_history(s: SparkSession, d: str) -> DataFrame:
    return _text(_history(s, d), "valid_from", "valid_to")


CUT = "2024-01-15 00:00:00"


@query(f"""WITH {HISTORY.replace('FROM events', f"FROM events WHERE ts < TIMESTAMP '{CUT}'")},
stg AS (SELECT user_id AS customer, event_type, {HASH} AS h, ts FROM events WHERE ts >= TIMESTAMP '{CUT}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
closed AS (SELECT hist.customer, hist.event_type, row_hash, valid_from, CASE WHEN is_current AND h <> row_hash THEN greatest(ts, valid_from) ELSE valid_to END AS
valid_to, is_current AND NOT coalesce(h <> row_hash, false) AS is_current, version, CASE WHEN is_current AND h <> row_hash THEN 'UPDATE' ELSE change_type END AS
change_type FROM hist LEFT JOIN stg USING (customer)),
known AS (SELECT customer, max(version) AS v, max(CASE WHEN is_current THEN row_hash END) AS o FROM hist GROUP BY customer),
new AS (SELECT stg.customer, event_type, h AS row_hash, ts AS valid_from, TIMESTAMP '9999-12-31 00:00:00' AS valid_to, true AS is_current, coalesce(v, 0) + 1 AS version,
CASE WHEN v IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS change_type FROM stg LEFT JOIN known USING (customer) WHERE o IS NULL OR o <> h)
SELECT customer, event_type, row_hash, {_T.format('valid_from')}, {_T.format('valid_to')}, is_current, CAST(version AS INT) AS version, change_type FROM (SELECT * FROM
closed UNION ALL SELECT * FROM new)""")
def scd2_apply(s: SparkSession, d: str) -> DataFrame:
    log = M.load(s, d, "events").select(F.col("user_id").alias("customer"), "event_type", "ts", "event_id")
    before = scd2.history(log.where(F.col("ts") < F.lit(CUT).cast("timestamp")), "customer", "ts", ["event_type"], "event_id")
    snapshot = X.latest(log.where(F.col("ts") >= F.lit(CUT).cast("timestamp")), ["customer"], F.desc("ts"), F.desc("event_id"))
    staged = snapshot.select("customer", "event_type", F.md5(F.coalesce("event_type", F.lit(""))).alias("row_hash"), F.col("ts").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("created_at"), F.lit("PASS").alias("dq_status"))
    return _text(scd2.apply(before, staged, "customer", F.lit(CUT).cast("timestamp")), "valid_from", "valid_to")


@query(f"WITH {HISTORY}, shifted AS (SELECT customer, version, valid_from, valid_to + INTERVAL 1 HOUR AS valid_to FROM hist) SELECT a.customer, CAST(a.version AS INT) AS "
    f"a, CAST(b.version AS INT) AS b FROM shifted a JOIN shifted b USING (customer) WHERE a.version <> b.version AND a.valid_from < b.valid_to AND b.valid_from < "
    f"a.valid_to")
def scd2_overlap_check(s: SparkSession, d: str) -> DataFrame:
    """Versions made to overlap by an hour, found by the invariant check."""
    h = _history(s, d)
    return scd2.overlaps(h.withColumn("valid_to", F.col("valid_to") + F.expr("INTERVAL 1 HOUR")), "customer")


@query(f"WITH {HISTORY} SELECT e.event_id, e.user_id AS customer, h.version AS version, h.event_type AS state FROM (SELECT *, ts - INTERVAL 36 HOUR AS at FROM events) e "
    f"LEFT JOIN (SELECT customer, CAST(version AS INT) AS version, event_type, valid_from, valid_to FROM hist) h ON h.customer = e.user_id AND e.at >= h.valid_from AND "
    f"e.at < h.valid_to")
def pit_join(s: SparkSession, d: str) -> DataFrame:
    facts = M.load(s, d, "events").select("event_id", F.col("user_id").alias("customer"), (F.col("ts") - F.expr("INTERVAL 36 HOURS")).alias("at"))
    dim = _history(s, d).withColumnRenamed("event_type", "state")
    return scd2.as_of_join(facts, dim, "customer", "at", ["version", "state"]).select("event_id", "customer", "version", "state")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_ri(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "lineitem").select("l_orderkey", "l_linenumber").join(M.load(s, d,
        "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)")
def anti_join_orphans(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "orders").select("o_orderkey", "o_custkey").join(M.load(s, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey")),
        "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT customer, max(order_id) AS order_id, CAST(max(net) AS DOUBLE) AS net FROM (SELECT o_custkey AS customer, o_orderkey AS order_id, CAST(o_totalprice AS "
    "DECIMAL(18,2)) AS net FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) GROUP BY customer")
def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    """The latest version of each key by one aggregation instead of a correlated subquery."""
    return M.load(s, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.max_by(F.struct(F.col("o_orderkey").alias("order_id"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("net")), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("customer", "r.*")


@query(WITH + "SELECT order_id, customer, order_date, status, CAST(net AS DOUBLE) AS net, count(line) AS line_count, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units "
    "FROM sales LEFT JOIN items USING (order_id) GROUP BY order_id, customer, order_date, status, net")
def orders_api(s: SparkSession, d: str) -> DataFrame:
    lines = M.items(s, d).groupBy("order_id").agg(F.count("line").alias("line_count"), F.sum("quantity").cast("long").alias("units"))  # before the join: fewer rows to shuffle
    return M.sales(s, d).join(lines, "order_id", "left").select("order_id", "customer", "order_date", "status", F.col("net").cast("double").alias("net"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("units", F.lit(0)).alias("units"))


@query(WITH + "SELECT order_id, customer, segment, nation, status, CAST(net AS DOUBLE) AS net FROM sales LEFT JOIN customers USING (customer)")
def order_enriched(s: SparkSession, d: str) -> DataFrame:
    return M.sales(s, d).join(M.customers(s, d).select("customer", "segment", "nation"), "customer", "left").select("order_id", "customer", "segment", "nation", "status",
        F.col("net").cast("double").alias("net"))


@query(f"WITH {HISTORY} SELECT customer, CAST(version AS INT) AS version, event_type AS state, lag(event_type) OVER (PARTITION BY customer ORDER BY version) AS state_before FROM hist")
def consent_history(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return _history(s, d).select("customer", "version", F.col("event_type").alias("state"), F.lag("event_type").over(Window.partitionBy("customer").orderBy("version")).alias("state_before"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in M.TABLES))
def dq_rowcounts(s: SparkSession, d: str) -> DataFrame:
    return Q.row_counts({t: M.load(s, d, t) for t in M.TABLES})


RULES = [
    Q.Rule("DQ-O-002", "BLOCKING", 0, "stg_orders", where="amount IS NULL OR amount < 0"),
    Q.Rule("DQ-O-003", "BLOCKING", 0, "stg_orders", where=f"order_date IS NULL OR order_date > {DAY}"),
    Q.Rule("DQ-O-004", "WARNING", 5, "stg_orders", where="status NOT IN ('COMPLETED','SHIPPED','CANCELLED','RETURNED','PENDING')"),
    Q.Rule("DQ-O-006", "WARNING", 0, "stg_orders", "SELECT count(*) FROM stg_orders o WHERE NOT EXISTS (SELECT 1 FROM core_customer c WHERE CAST(c.c_custkey AS STRING) = o.customer)"),
    Q.Rule("DQ-C-005", "WARNING", 1, "core_customer", "SELECT count(*) FROM (SELECT lower(trim(c_name)) FROM core_customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1)"),
    Q.Rule("X-002", "BLOCKING", 0, "core_customer", "SELECT count(*) FROM (SELECT c_custkey FROM core_customer GROUP BY c_custkey HAVING count(*) > 1)"),
    Q.Rule("X-004", "INFO", 5, "core_customer", "SELECT count(*) FROM core_customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM core_customer) WHERE c_acctbal > m + 3 * sd"),
    Q.Rule("Z-999", "BLOCKING", 0, "core_customer", "SELECT count(*) FROM core_customer WHERE no_such_column = 1"),
]


@query(f"WITH {STAGED}, stg_orders AS (SELECT * FROM staged), core_customer AS (SELECT * FROM "
    f"customer), r AS (" + " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, {r.threshold} AS thr, {'-1' if 'no_such' in r.failed else '(' + (r.failed or f'SELECT count(*) FROM {r.table} WHERE {r.where}') + ')'} AS rows_failed, (SELECT count(*) FROM {r.table}) AS rows_evaluated" for r in RULES) + """)
SELECT rule_id, severity, CAST(rows_failed AS BIGINT) AS rows_failed, rows_evaluated, CASE WHEN rows_failed < 0 THEN 0.0 ELSE round(CAST(rows_failed AS DOUBLE) * 100 /
rows_evaluated, 4) END AS fail_pct,
CASE WHEN rows_failed < 0 THEN 'FAIL' WHEN rows_failed = 0 OR CAST(rows_failed AS DOUBLE) * 100 / rows_evaluated <= thr THEN 'PASS' WHEN severity = 'BLOCKING' THEN
'FAIL' WHEN severity = 'WARNING' THEN 'WARN' ELSE 'PASS' END AS status FROM r""")
def dq_run(s: SparkSession, d: str) -> DataFrame:
    """Eight rules, one of which can't be analysed, over staged orders that are written once."""
    store = Store(s, scratch(s, "rules"))
    build.run(store, [build.Step("stg_orders", lambda: _staged(s, d))], "all")
    return Q.run(s, RULES, {"stg_orders": store.read("stg_orders"), "core_customer": M.load(s, d, "customer")})


@query(f"WITH {STAGED} SELECT 'DQ-O-002' AS rule_id, order_id FROM staged WHERE amount IS NULL OR amount < 0 UNION ALL SELECT 'DQ-O-003', order_id FROM staged WHERE "
    f"order_date IS NULL OR order_date > {DAY}")
def quarantine(s: SparkSession, d: str) -> DataFrame:
    o = _staged(s, d)
    bad = Q.quarantine({"DQ-O-002": (o, F.col("amount").isNull() | (F.col("amount") < 0)), "DQ-O-003": (o, F.col("order_date").isNull() | (F.col("order_date") > F.lit(M.AS_OF)))})
    return bad.select("rule_id", F.get_json_object("payload", "$.order_id").alias("order_id"))


@query("SELECT event_type, user_id, event_id FROM events JOIN (SELECT event_type, max(CAST(ts AS DATE)) AS day FROM events GROUP BY event_type) USING (event_type) WHERE CAST(ts AS DATE) = day")
def dq_latest(s: SparkSession, d: str) -> DataFrame:
    return Q.newest(M.load(s, d, "events").select("event_type", "user_id", "event_id", F.to_date("ts").alias("day")), "event_type", "day").select("event_type", "user_id", "event_id")


@query("SELECT o_orderkey, o_orderdate::DATE AS order_date, CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS BIGINT) AS total, (SELECT count(*) FROM "
    "orders WHERE o_orderstatus = 'F') > 120 AS has_more FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 100")
def page_orders(s: SparkSession, d: str) -> DataFrame:
    o = M.load(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))
    return serving.page(o, 20, 100, F.desc("order_date"), "o_orderkey")


@query(f"SELECT CAST(max(o_orderdate) AS DATE) AS newest, count(*) AS rows_total, count(*) FILTER (CAST(o_orderdate AS DATE) >= {DAY} - 1) AS rows_fresh FROM orders")
def freshness(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "orders").agg(F.to_date(F.max("o_orderdate")).alias("newest"), F.count("*").alias("rows_total"),
        F.count(F.when(F.to_date("o_orderdate") >= F.date_sub(F.lit(M.AS_OF), 1), 1)).alias("rows_fresh"))


_PERSON = "(SELECT c_custkey, c_name, lower(replace(c_name, '#', '.')) || '@example.com' AS email, '+1-402-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, DATE '1970-01-01' + CAST(c_custkey % 9000 AS INT) AS born FROM customer)"


def _people(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return M.load(s, d, "customer").select("c_custkey", "c_name", F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1-402-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
        F.date_add(F.lit(dt.date(1970, 1, 1)), (k % 9000).cast("int")).alias("born"))


@query(f"SELECT c_custkey, left(email, 1) || '****@' || split_part(email, '@', 2) AS email, '***-***-' || right(phone, 4) AS phone, left(c_name, 1) || '.' AS name, "
    f"CAST(date_trunc('year', born) AS DATE) AS born, '[REDACTED: ' || length(c_name) || ' characters]' AS note FROM {_PERSON}")
def mask_sql_policy(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _people(s, d).select("c_custkey", P.mask_email(c("email"), set()).alias("email"), P.mask_phone(c("phone"), set()).alias("phone"),
        P.mask_name(c("c_name"), set()).alias("name"), P.mask_date(c("born"), set()).alias("born"), P.mask_text(c("c_name"), set()).alias("note"))


@query(f"SELECT c_custkey, left(email, 1) || repeat('*', greatest(length(split_part(email, '@', 1)) - 1, 3)) || '@' || split_part(email, '@', 2) AS email, strftime(born, "
    f"'%Y') || '-**-**' AS born FROM {_PERSON}")
def mask_api(s: SparkSession, d: str) -> DataFrame:
    return _people(s, d).select("c_custkey", P.api_email(F.col("email")).alias("email"), P.api_birth(F.col("born")).alias("born"))


@query("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def row_access_region(s: SparkSession, d: str) -> DataFrame:
    grants = s.createDataFrame([("ANALYST_ASIA", "ASIA"), ("ANALYST_EU", "EUROPE"), ("ADMIN", "*")], "role string, region string")
    c = M.load(s, d, "customer").join(M.load(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(M.load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.row_access(c, "r_name", grants, {"ANALYST_ASIA", "ANALYST_EU"}).select("c_custkey", F.col("n_name").alias("nation"))


@query("SELECT c_custkey FROM customer WHERE CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
def marketing_consent(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    return P.consented(M.load(s, d, "customer").withColumn("opt_in", F.when(k == 0, True).when(k == 1, False)), "opt_in").select("c_custkey")


@query("SELECT c_custkey, 'CUST_' || upper(left(sha256('pepper:' || CAST(c_custkey AS VARCHAR)), 12)) AS pseudonym FROM customer")
def pseudonymise(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "customer").select("c_custkey", P.pseudonym(F.col("c_custkey"), "CUST", "pepper").alias("pseudonym"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_path_projection(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'PREMIUM' WHEN 'BUILDING' THEN 'STANDARD' ELSE 'BASIC' END AS segment, strptime(strftime(DATE "
    "'1995-01-01' + CAST(c_custkey % 2000 AS INT), '%d/%m/%Y'), '%d/%m/%Y')::DATE AS created, c_custkey % 2 = 0 AS opt_in FROM customer")
def canonical_crm_map(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = M.load(s, d, "customer").select("c_custkey", F.substring("c_mktsegment", 1, 1).alias("code"),
        F.date_format(F.date_add(F.lit(dt.date(1995, 1, 1)), (k % 2000).cast("int")), "dd/MM/yyyy").alias("created"), F.when(k % 2 == 0, "Y").otherwise("N").alias("opt"))
    return canonical.customers(raw, codes={"segment": ("code", {"A": "PREMIUM", "B": "STANDARD"}, "BASIC")}, dates={"created": "created"}, flags={"opt_in": "opt"}, keep=("c_custkey",))


@query(f"SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= {DAY} - INTERVAL 36 MONTH")
def retention_filter(s: SparkSession, d: str) -> DataFrame:
    return Q.retained(M.load(s, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", M.AS_OF, 36).select("o_orderkey")


@query("""WITH o AS (SELECT DISTINCT event_type AS source, CASE WHEN event_id % 2 = 0 THEN 'core' ELSE 'ai' END AS target FROM events WHERE event_type <> 'view'),
dcl(source, target) AS (VALUES ('click','core'), ('click','ai'), ('view','core'), ('error','core'))
SELECT source, target, CASE WHEN d.s2 IS NULL THEN 'UNDOCUMENTED' WHEN o2 IS NULL THEN 'DEAD' ELSE 'HEALTHY' END AS state FROM (SELECT *, 1 AS o2 FROM o) FULL JOIN
(SELECT *, 1 AS s2 FROM dcl) d USING (source, target)""")
def lineage_reconcile(s: SparkSession, d: str) -> DataFrame:
    seen = M.load(s, d, "events").where("event_type <> 'view'").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 2 == 0, "core").otherwise("ai").alias("target"))
    return Q.reconcile(seen, s.createDataFrame([("click", "core"), ("click", "ai"), ("view", "core"), ("error", "core")], "source string, target string"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, round(avg(n) OVER (PARTITION BY event_type
ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM d)
SELECT *, coalesce(abs(n - mean_before) > 0.2 * mean_before, false) AS drifted FROM m""")
def rowcount_drift(s: SparkSession, d: str) -> DataFrame:
    return Q.drift(M.load(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")), "event_type", "day", "n")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS calls, round(count(*) FILTER (event_type = 'error') * 1.0::DOUBLE / count(*), 6) AS block_rate, CAST(sum(CAST(value "
    "AS DECIMAL(18,4))) AS DOUBLE) AS cost, count(DISTINCT user_id) AS clients FROM events GROUP BY 1")
def ai_ops_metrics(s: SparkSession, d: str) -> DataFrame:
    return M.load(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"),
        F.round(F.count(F.when(F.col("event_type") == "error", 1)) * F.lit(1.0) / F.count("*"), 6).alias("block_rate"),
        F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("cost"), F.countDistinct("user_id").alias("clients"))


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN max(value) >= 100 THEN 'HIGH' WHEN max(value) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM events GROUP BY ALL)
SELECT * FROM (SELECT *, lag(band) OVER (PARTITION BY user_id ORDER BY day) AS band_before FROM b) WHERE band_before <> band""")
def band_crossing(s: SparkSession, d: str) -> DataFrame:
    top = F.max("value")
    daily = M.load(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.when(top >= 100, "HIGH").when(top >= 40, "MEDIUM").otherwise("LOW").alias("band"))
    return Q.crossings(daily, "user_id", "day", "band")


@query()
def nested_document(s: SparkSession, d: str) -> DataFrame:
    return serving.documents(M.customers(s, d), M.sales(s, d), 3)


@query("""SELECT 'orders' AS table_name, '{"customer":7,"order_date":"' || CAST(o_orderdate AS DATE) || '","order_id":' || o_orderkey || ',"status":"' || o_orderstatus
|| '"}' AS row FROM orders WHERE o_custkey = 7 UNION ALL
SELECT 'interactions', '{"channel":"' || event_type || '","customer":7,"id":' || event_id || ',"negative":' || CASE WHEN event_type = 'error' THEN 'true' ELSE 'null' END
|| '}' FROM events WHERE user_id = 7""")
def subject_extract(s: SparkSession, d: str) -> DataFrame:
    """All that is kept of one customer."""
    orders = M.load(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("order_date"),
        F.col("o_orderstatus").alias("status"))
    touches = M.touches(s, d).select("id", "customer", "channel", F.when(F.col("negative"), True).alias("negative"))
    return P.subject_extract("customer", 7, {"orders": orders, "interactions": touches})


@query("SELECT o_orderkey, 'C_' || upper(left(sha256('salt:' || CAST(o_custkey AS VARCHAR)), 12)) AS customer FROM orders WHERE o_custkey % 100 = 7")
def subject_erasure(s: SparkSession, d: str) -> DataFrame:
    gone = M.customers(s, d).where("customer % 100 = 7").select("customer")
    _, sales = P.erase("customer", gone, M.customers(s, d), M.sales(s, d), "C", "salt")
    return sales.where(F.col("customer").startswith("C_")).select(F.col("order_id").alias("o_orderkey"), "customer")
