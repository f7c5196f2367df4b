"""Queries of operations: marks, queues, alerts, runs, what flows where, objects in text, ids, explanations and what columns hold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import objects as O
from tessera.operators import core, insight, lineage, operations, serving
from tessera.operators import analytics as A
from tessera.plans import governance as G
from tessera.plans import mapping as M
from tessera.plans import warehouse as W
from tessera.plans.customer import ALL, WHOLE, _combined
from tessera.plans.registry import query
from tessera.sources.store import Store, scratch
from tessera.streaming import alerts

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}".format
_UNTIL = "2024-02-05"
_QUEUED = "SELECT CASE event_id % 3 WHEN 0 THEN 'CLAIMS' WHEN 1 THEN 'OFFERS' ELSE 'SAFETY' END AS queue, ts AS opened_at, CASE WHEN event_id % 40 <> 0 THEN ts + INTERVAL 1 DAY * (event_id % 9) END AS closed_at FROM events WHERE event_type IN ('error', 'view')"


@query(f"""WITH q AS ({_QUEUED}), span AS (SELECT queue, CAST(min(opened_at) AS DATE) AS a FROM q GROUP BY queue), days AS (SELECT queue, CAST(unnest(generate_series(a,
DATE '{_UNTIL}', INTERVAL 1 DAY)) AS DATE) AS day FROM span)
SELECT d.queue, d.day, count(*) FILTER (CAST(opened_at AS DATE) = d.day) AS opened, count(*) FILTER (CAST(closed_at AS DATE) = d.day) AS closed, count(*) FILTER
(closed_at IS NULL OR CAST(closed_at AS DATE) > d.day) AS depth,
strftime(min(opened_at) FILTER (closed_at IS NULL OR CAST(closed_at AS DATE) > d.day), '%Y-%m-%d %H:%M:%S.%f') AS oldest, CAST(date_diff('day', min(CAST(opened_at AS
DATE)) FILTER (closed_at IS NULL OR CAST(closed_at AS DATE) > d.day), d.day) AS INT) AS age_days FROM days d JOIN q ON q.queue = d.queue AND CAST(opened_at AS DATE) <=
d.day GROUP BY d.queue, d.day""")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    """Depth of three queues by day, and how long the oldest open item has waited."""
    i = F.col("event_id")
    items = M.load(s, d, "events").where("event_type IN ('error', 'view')").select(
        F.when(i % 3 == 0, "CLAIMS").when(i % 3 == 1, "OFFERS").otherwise("SAFETY").alias("queue"), F.col("ts").alias("opened_at"),
            F.when(i % 40 != 0, F.col("ts") + F.make_dt_interval((i % 9).cast("int"))).alias("closed_at")
    )
    out = operations.review_queue(items, F.lit(_UNTIL).cast("date"))
    return out.select("queue", "day", "opened", "closed", "depth", F.date_format("oldest", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("oldest"), F.datediff("day", F.to_date("oldest")).alias("age_days"))


def _results(s: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return M.load(s, d, "events").groupBy(F.col("event_type").alias("rule_id"),
        F.date_trunc("day", "ts").alias("at")).agg(F.when(n % 3 == 0, "FAIL").when(n % 3 == 1, "WARN").otherwise("PASS").alias("status"))


@query("""WITH r AS (SELECT event_type AS rule_id, date_trunc('day', ts) AS at_, CASE count(*) % 3 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS status FROM
events GROUP BY ALL), b AS (SELECT *, lag(status) OVER (PARTITION BY rule_id ORDER BY at_) AS before FROM r)
SELECT rule_id, strftime(at_, '%Y-%m-%d') AS day, before FROM b WHERE status = 'FAIL' AND (before IS NULL OR before <> 'FAIL')""")
def dq_alerts(s: SparkSession, d: str) -> DataFrame:
    """Alerts of rules whose results come in three batches, the second of them twice, and the first again at the end."""
    store = Store(s, scratch(s, "alerts"))
    rows = _results(s, d)
    cut = [rows.where("at < '2024-01-10'"), rows.where("at >= '2024-01-10' AND at < '2024-01-20'"), rows.where("at >= '2024-01-20'")]
    for number in (0, 1, 1, 2, 0):
        alerts.alert(store, cut[number], number)
    return store.read("alerts").select("rule_id", F.date_format("at", "yyyy-MM-dd").alias("day"), "before")


@query(f"SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '{G.CUT}'")
def watermark_incremental(s: SparkSession, d: str) -> DataFrame:
    """What the second of two loads appends: rows and mark of the first were committed together, and the second reads from its mark on."""
    store = Store(s, scratch(s, "marks"))
    events = M.load(s, d, "events").select("event_id", "user_id", "ts")
    store.advance("events", "events", events.where(F.col("ts") <= F.lit(G.CUT).cast("timestamp")), "ts", ["event_id"])
    store.advance("events", "events", events, "ts", ["event_id"])
    return store.appended("events").select("event_id", "user_id")


@query(f"WITH {G.STAGED} SELECT channel AS batch, count(*) AS n_rows, count(*) FILTER (dq_status = 'FAIL') AS quarantined, round(count(*) FILTER (dq_status = 'FAIL') * "
    f"1.0::DOUBLE / count(*), 6) AS share, count(*) FILTER (dq_status = 'FAIL') > 0.005::DOUBLE * count(*) AS too_many FROM staged GROUP BY channel")
def quarantine_share(s: SparkSession, d: str) -> DataFrame:
    return operations.quarantine_share(G._staged(s, d).withColumnRenamed("channel", "batch"), "batch")


@query("""WITH r AS (SELECT event_type AS step, CAST(ts AS DATE) AS day, CAST(floor(sum(CAST(value AS DECIMAL(18,4)))) AS DOUBLE) AS seconds FROM events GROUP BY ALL),
m AS (SELECT *, round(avg(seconds) OVER (PARTITION BY step ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS mean_before, seconds > 2 * avg(seconds) OVER
(PARTITION BY step ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS slow FROM r) SELECT step, day, seconds, mean_before, coalesce(slow, false) AS slow FROM m""")
def slow_runs(s: SparkSession, d: str) -> DataFrame:
    """Runs that took more than twice the mean of the seven before."""
    runs = M.load(s, d, "events").groupBy(F.col("event_type").alias("step"), F.to_date("ts").alias("day")).agg(F.floor(F.sum(F.col("value").cast("decimal(18,4)"))).cast("double").alias("seconds"))
    return operations.slow_runs(runs)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS calls, count(DISTINCT user_id) AS clients, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS cost, round(count(*) "
    "FILTER (event_type = 'error') * 1.0::DOUBLE / count(*), 6) AS block_rate, "
       "CAST((2 * sum(CASE WHEN event_id % 5 <> 0 THEN event_id % 100 * 100 END) + count(CASE WHEN event_id % 5 <> 0 THEN 1 END)) // (2 * count(CASE WHEN event_id % 5 <> "
           "0 THEN 1 END)) AS DOUBLE) / 10000 AS groundedness FROM events GROUP BY 1")  # fmt: skip
def ai_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls of models by day, with the mean groundedness of what they wrote."""
    i = F.col("event_id")
    audit = M.load(s, d, "events").select(F.col("ts").alias("at"), F.col("user_id").alias("client"), F.col("value").alias("cost"),
        (F.col("event_type") == "error").alias("blocked"), F.when(i % 5 != 0, (i % 100).cast("decimal(10,4)") / 100).alias("groundedness"))
    return operations.calls(audit)


_NBA = "CASE WHEN open_cases > 0 THEN 'RESOLVE_OPEN_CASE' WHEN band IN ('HIGH','CRITICAL') AND coalesce(days_since_last_order, 9999) >= 120 THEN 'RETENTION_OFFER_15_PCT' WHEN band IN ('HIGH','CRITICAL') THEN 'PROACTIVE_SERVICE_CALL' WHEN tier_rank = 0 THEN 'DOUBLE_POINTS_MONTH' ELSE 'NO_ACTION' END"


@query(f"{ALL}{WHOLE}, n AS (SELECT {_NBA} AS action, count(*) AS n FROM c360 LEFT JOIN osum USING (customer) GROUP BY 1) SELECT action, n, round(n * 1.0::DOUBLE / sum(n) OVER (), 6) AS share FROM n")
def action_distribution(s: SparkSession, d: str) -> DataFrame:
    return operations.actions(serving.next_best_action(A.customer_360(_combined(s, d), "days_since_last_order"), premium="BUILDING"))


_EDGES = """e AS (SELECT DISTINCT 'customer.' || c_nationkey AS source, 'stage.' || c_mktsegment AS target FROM customer UNION SELECT DISTINCT 'stage.' || c_mktsegment,
'core.' || o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey
  UNION SELECT DISTINCT 'core.' || o_orderpriority, 'mart.' || l_returnflag || l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION SELECT DISTINCT
'mart.' || l_returnflag || l_linestatus, 'core.' || o_orderpriority FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1
  UNION SELECT DISTINCT 'mart.' || l_returnflag || l_linestatus, 'report.' || CAST(l_quantity AS INT) FROM lineitem WHERE l_quantity < 5)"""


@query(f"""WITH RECURSIVE {_EDGES}, seeds AS (SELECT DISTINCT source AS node FROM e WHERE source LIKE 'customer.%'),
walk AS (SELECT node AS origin, node, 0 AS hops, [node] AS path FROM seeds UNION ALL SELECT w.origin, e.target, w.hops + 1, list_append(w.path, e.target) FROM walk w
JOIN e ON e.source = w.node WHERE NOT list_contains(w.path, e.target) AND w.hops < 5)
SELECT origin, node, CAST(min(hops) AS INT) AS hops, array_to_string(arg_min(path, (hops, path)), ' > ') AS path FROM walk WHERE hops > 0 GROUP BY origin, node""")
def lineage_pii_path(s: SparkSession, d: str) -> DataFrame:
    """By which path what is personal (the customers of each nation) comes to which report; flows are observed in the tables, and some go in circles."""
    t = lambda prefix, c: F.concat(F.lit(prefix), F.col(c) if isinstance(c, str) else c)
    c, o, l = M.load(s, d, "customer"), M.load(s, d, "orders"), M.load(s, d, "lineitem")
    mart = F.concat("l_returnflag", "l_linestatus")
    lines = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority", mart.alias("mart")).agg(F.max(F.col("l_linenumber") == 1).alias("back"))
    edges = c.select(t("customer.", F.col("c_nationkey").cast("string")).alias("source"), t("stage.", "c_mktsegment").alias("target"))
    edges = edges.union(o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(t("stage.", "c_mktsegment"), t("core.", "o_orderpriority")))
    edges = edges.union(lines.select(t("core.", "o_orderpriority"), t("mart.", "mart"))).union(lines.where("back").select(t("mart.", "mart"), t("core.", "o_orderpriority")))
    edges = edges.union(l.where("l_quantity < 5").select(t("mart.", mart), t("report.", F.col("l_quantity").cast("int").cast("string"))))
    out = lineage.reached(edges, edges.where("source LIKE 'customer.%'").select(F.col("source").alias("node")))
    return out.select("origin", "node", "hops", F.array_join("path", " > ").alias("path"))


SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://example.com/customers")


@query("SELECT c_custkey, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || "
    "h[21:32] AS id FROM (SELECT c_custkey, " f"sha1(unhex('{SPACE.hex}') || encode('customer/' || c_custkey)) AS h FROM customer)")
def stable_ids(s: SparkSession, d: str) -> DataFrame:
    """Ids that a retry makes again."""
    return M.load(s, d, "customer").select("c_custkey", O.named_uuid(SPACE, F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"))).alias("id"))


_CODES = ["RESOLVE_OPEN_CASE", "RETENTION_OFFER_15_PCT", "PROACTIVE_SERVICE_CALL", "DOUBLE_POINTS_MONTH", "NO_ACTION"]


@query("""SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_type IN ('click', 'purchase') THEN 'NO_ACTION' ELSE 'PROACTIVE_SERVICE_CALL' END END AS
choice, CASE WHEN event_id % 7 <> 0 AND event_type IN ('click', 'purchase') THEN 'BUY_' || event_type END AS suppressed,
CASE WHEN event_id % 7 <> 0 THEN '{"action": "' || CASE WHEN event_type IN ('click', 'purchase') THEN 'BUY_' || event_type ELSE 'PROACTIVE_SERVICE_CALL' END || '",
"why": {"text": "a } b \\" {", "props": ' || props || '}}' END AS object FROM events""")
def extracted_action(s: SparkSession, d: str) -> DataFrame:
    """The action that an answer in prose recommends, if it is on the list; every seventh answer breaks off."""
    i = F.col("event_id")
    action = F.when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit("BUY_"), "event_type")).otherwise("PROACTIVE_SERVICE_CALL")
    made = F.concat(F.lit('{"action": "'), action, F.lit('", "why": {"text": "a } b \\" {", "props": '), "props", F.lit("}}"))
    answer = F.when(i % 7 != 0, F.concat(F.lit("Sure, as asked: "), made, F.lit(' or {"action": "NO_ACTION"} } "'))).otherwise(F.concat(F.lit("Sure: "), F.substring(made, 1, 20)))
    return M.load(s, d, "events").select("event_id", O.closed_choice(answer, "action", _CODES, "NO_ACTION").alias("o")).select("event_id", "o.choice", "o.suppressed", "o.object")


@query("SELECT o_orderkey, '{\"status\":\"' || CASE WHEN o_orderkey % 2 = 0 THEN 'late' ELSE o_orderstatus END || '\",\"priority\":\"' || o_orderpriority || '\"}' AS "
    "object, array_to_string(string_split(o_orderpriority || ' x y', ' ')[-2:], '|') AS last_two, array_to_string(string_split(o_orderpriority || ' x y', ' ')[2:-2], "
    "'|') AS inner_ones FROM orders")
def objects_and_parts(s: SparkSession, d: str) -> DataFrame:
    """Pairs as an object, the last of a repeated key stays; parts of arrays from the end."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    k = F.col("o_orderkey")
    pairs = F.array(pair("status", F.col("o_orderstatus")), pair("priority", F.col("o_orderpriority")), pair("status", F.when(k % 2 == 0, "late").otherwise(F.col("o_orderstatus"))))
    words = F.split(F.concat("o_orderpriority", F.lit(" x y")), " ")
    return M.load(s, d, "orders").select("o_orderkey", F.to_json(O.object_of(pairs)).alias("object"), F.array_join(O.part(words, -2), "|").alias("last_two"),
        F.array_join(O.part(words, 1, -1), "|").alias("inner_ones"))


_SAID = {
    "PURCHASE_RECENCY": "CASE WHEN days_since_last_order IS NULL THEN 'they have no recent purchase activity' ELSE 'they have not ordered for ' || "
        "days_since_last_order || ' days' END", "DECLINING_ORDER_TREND": "'their recent order rate has fallen (trend ratio ' || CAST(order_trend_ratio AS "
        "DECIMAL(18,4)) || ')'",
    "SUPPORT_CASE_VOLUME": "'they have raised ' || coalesce(CAST(cases_last_90d AS VARCHAR), 'n/a') || ' support cases in the last 90 days'",
        "LOW_SATISFACTION": "'their average satisfaction score is ' || coalesce(CAST(CAST(ssum.avg_csat AS DECIMAL(10,2)) AS VARCHAR), 'n/a')",
    "LOW_ENGAGEMENT": "'their engagement score is ' || CAST(esum.engagement_score AS DECIMAL(10,6)) || ' out of 100'",
        "LOYALTY_INACTIVITY": "'their loyalty account has been inactive'",
        "NEGATIVE_SIGNALS": "'they generated ' || esum.negative_signals_90d || ' negative engagement signals in the last 90 days'",
}


@query(f"{ALL}, said AS (SELECT customer, rank, CASE driver {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _SAID.items())} END AS reason FROM ranked JOIN feat USING "
    f"(customer) LEFT JOIN osum USING (customer) LEFT JOIN ssum USING (customer) LEFT JOIN esum USING (customer) WHERE rank <= 3) "
       "SELECT customer, 'Churn risk is ' || any_value(band) || ' with a probability of ' || CAST(any_value(probability) AS DECIMAL(6,4)) || '. The main reasons are that "
           "' || string_agg(reason, '; ' ORDER BY rank) || '.' AS explanation FROM said JOIN score USING (customer) GROUP BY customer")  # fmt: skip
def churn_explanation(s: SparkSession, d: str) -> DataFrame:
    """Why each customer may leave, in words."""
    rows = _combined(s, d)
    pairs = F.array_sort(F.array(*(F.struct((-F.col(f"parts.{n}")).alias("minus"), F.lit(n).alias("driver")) for n in A.DRIVERS)))
    exact = lambda c, kind: F.col(c).cast(kind)
    said = rows.select(
        "customer", "churn.band", exact("churn.probability", "decimal(6,4)").alias("probability"),
            F.transform(F.slice(pairs, 1, 3), lambda p: p["driver"]).alias("drivers"), "days_since_last_order", "cases_last_90d", "negative_signals_90d",
        exact("features.order_trend_ratio", "decimal(18,4)").alias("order_trend_ratio"), exact("avg_csat", "decimal(10,2)").alias("avg_csat"),
            exact("engagement_score", "decimal(10,6)").alias("engagement_score"),
    )
    return insight.churn_explanation(said)


@query("SELECT c_custkey, '- segment: ' || c_mktsegment || chr(10) || '- balance: ' || CASE WHEN c_acctbal > 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) "
    "ELSE 'NOT AVAILABLE' END || chr(10) || '- note: NOT AVAILABLE' || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '- drivers: NOT AVAILABLE' ELSE '- drivers:' || "
    "chr(10) || '    * nation ' || c_nationkey || chr(10) || '    * two' END AS facts FROM customer")
def rendered_facts(s: SparkSession, d: str) -> DataFrame:
    """Facts as a model gets them."""
    k = F.col("c_custkey")
    facts = {"segment": F.col("c_mktsegment"), "balance": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)")), "note": F.lit("")}
    items = F.when(k % 3 != 0, F.array(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), F.lit("two")))
    return M.load(s, d, "customer").select("c_custkey", insight.rendered_facts(facts, {"drivers": items}).alias("facts"))


@query(f"""{W.WAREHOUSE} SELECT customer, 'Customer ' || left(regexp_replace(full_name, '^Customer#', ''), 1) AS display_name, segment, customer_status AS status, coalesce(segment = 'BUILDING', false) OR value_tier = 'HIGH' AS vip, loyalty_tier, loyalty_points_balance, data_completeness_score AS completeness, true AS masked FROM full360""")
def shop_view(s: SparkSession, d: str) -> DataFrame:
    """What a shop's screen shows: a masked name (cut after its first letters here, as both engines can) and no contact data."""
    whole = core.full_view(W._all(s, d), W._addresses(s, d), M.AS_OF, W.AT)
    seen = serving.store_view(whole.withColumn("full_name", F.concat(F.lit("Customer "), F.left(F.regexp_replace("full_name", "^Customer#", ""), F.lit(1)))), True, premium="BUILDING")
    return seen.withColumn("masked", F.lit(True))


def _kinds(table: str) -> str:
    """SQL for the description of a table; content is told by its columns' values."""
    parts = []
    for name, kind in _COLUMNS[table].items():
        if kind == "text":
            looks = " ".join(f"WHEN count(*) FILTER (regexp_matches({name}, '{p}')) >= {insight.SURE} * count({name}) THEN '{k}'" for k, p in insight.LOOKS.items())
            content = f"CASE WHEN count({name}) = 0 THEN 'EMPTY' {looks} WHEN sum(length({name}) - length(replace({name}, ' ', ''))) >= {insight.WORDY} * count({name}) THEN 'FREE_TEXT' ELSE 'TEXT' END"
        else:
            content = f"'{kind}'"
        parts.append(f"SELECT '{table}' AS table_name, '{name}' AS column_name, count(*) AS n_rows, round(1 - count({name}) * 1.0::DOUBLE / greatest(count(*), 1), 6) AS "
            f"null_share, count(DISTINCT {name}) AS n_distinct, {content} AS content FROM {table}")
    return " UNION ALL ".join(parts)


_COLUMNS = {
    "region": {"r_regionkey": "NUMBER", "r_name": "text"}, "nation": {"n_nationkey": "NUMBER", "n_name": "text", "n_regionkey": "NUMBER"},
    "customer": {"c_custkey": "NUMBER", "c_name": "text", "c_nationkey": "NUMBER", "c_acctbal": "NUMBER", "c_mktsegment": "text"},
        "supplier": {"s_suppkey": "NUMBER", "s_name": "text", "s_nationkey": "NUMBER", "s_acctbal": "NUMBER"},
    "part": {"p_partkey": "NUMBER", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "NUMBER", "p_retailprice": "NUMBER"},
    "orders": {"o_orderkey": "NUMBER", "o_custkey": "NUMBER", "o_orderstatus": "text", "o_totalprice": "NUMBER", "o_orderdate": "TIME", "o_orderpriority": "text"},
    "lineitem": {c: "NUMBER" for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()} | {"l_returnflag": "text",
        "l_linestatus": "text", "l_shipdate": "TIME"},
    "events": {"event_id": "NUMBER", "ts": "TIME", "user_id": "NUMBER", "event_type": "text", "value": "NUMBER", "props": "text"},
        "documents": {"doc_id": "NUMBER", "text": "text", "lang": "text", "source": "text", "n_chars": "NUMBER"},
    "embeddings": {"vec_id": "NUMBER", "embedding": "VECTOR", "label": "NUMBER"}, "pages": {"page_id": "NUMBER", "url": "text", "html": "text"}, "benchmark": {"item_id": "NUMBER", "text": "text"},
    "labels": {"doc_id": "NUMBER", "quality": "NUMBER", "toxic": "NUMBER"}, "conversations": {"conv_id": "NUMBER", "turn": "NUMBER", "role": "text", "text": "text"},
}


_DESCRIBED = " UNION ALL ".join(map(_kinds, _COLUMNS))
_BY_NAME = "CASE " + " ".join(f"WHEN regexp_matches(lower(column_name), '{'|'.join(v)}') THEN '{k}'" for k, v in insight.PII_HINTS.items()) + " ELSE 'NONE' END"
#: Columns that the dictionary describes in words.
_WORDS = [("customer", "c_custkey"), ("customer", "c_name"), ("events", "ts"), ("lineitem", "l_quantity")]


def _described(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name in _COLUMNS:
        one = insight.described(M.load(s, d, name), name)
        out = one if out is None else out.unionByName(one)
    return out


@query(_DESCRIBED)
def described_columns(s: SparkSession, d: str) -> DataFrame:
    """What the columns of all tables hold, by their values: nulls, distinct values, kind of content."""
    return _described(s, d)


@query(f"SELECT table_name, column_name, n_rows, content, {_BY_NAME} AS pii_class FROM ({_DESCRIBED})")
def data_dictionary(s: SparkSession, d: str) -> DataFrame:
    """All columns with what their values hold and what their names say about persons."""
    return insight.classified(_described(s, d)).select("table_name", "column_name", "n_rows", "content", "pii_class")


@query(f"SELECT table_name, count(*) AS columns, count(w) AS described, round(100.0::DOUBLE * count(w) / count(*), 2) AS coverage_pct, CAST(sum(n_rows) AS BIGINT) AS "
    f"n_values FROM ({_DESCRIBED}) LEFT JOIN (SELECT *, 1 AS w FROM (VALUES {', '.join(str(x) for x in _WORDS)}) v(table_name, column_name)) USING (table_name, "
    f"column_name) GROUP BY table_name")
def dictionary_coverage(s: SparkSession, d: str) -> DataFrame:
    """Share of each table's columns that the dictionary describes in words, with how many values they have."""
    columns = _described(s, d)
    out = insight.coverage(columns, s.createDataFrame(_WORDS, "table_name string, column_name string"))
    return out.join(columns.groupBy("table_name").agg(F.sum("n_rows").alias("n_values")), "table_name")
