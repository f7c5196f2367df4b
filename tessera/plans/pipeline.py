"""The whole build, from raw text to the unified view: the driver's tables as nine sources would send them (with defects planted by key), staging, the core layer, summaries, features and scores.

Raw columns are expressions that both engines read alike; `copy` is 1 where a row is sent again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import build, core, staging
from tessera.plans import governance as G
from tessera.plans import mapping as M
from tessera.plans.customer import DAY, ENGAGEMENT, FEATURES, ORDERS, PARTS, SUPPORT
from tessera.plans.registry import query
from tessera.plans.warehouse import FULL_COLUMNS
from tessera.sources.store import Store, scratch

AT = dt.datetime(2001, 8, 1)
_S = "CAST({} AS STRING)".format

#: name -> (table, rows, rows that are sent again, columns)
RAW: dict[str, tuple[str, str, str, dict[str, str]]] = {
    "raw_customer": ("customer", "true", "c_custkey % 10 = 0", {
        "customer": f"CASE WHEN c_custkey % 97 <> 0 THEN ' ' || {_S('c_custkey')} END", "first_name": f"' Ann' || {_S('c_custkey % 50')}", "last_name": "c_name || ' '",
        "email": f"CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'bad#address' WHEN c_custkey % 53 = 0 THEN "
            f"'CUSTOMER' || {_S('c_custkey - 1')} || '@EXAMPLE.COM ' ELSE 'customer' || {_S('c_custkey')} || '@example.com' END",
        "phone": f"CASE WHEN c_custkey % 43 <> 0 THEN '+1 (402) ' || {_S('c_custkey')} END",
        "birth_date": f"CASE WHEN c_custkey % 211 = 0 THEN '1899-12-31' WHEN c_custkey % 17 = 0 THEN 'unknown' WHEN c_custkey % 19 "
            f"<> 0 THEN {_S("DATE '1950-01-01' + CAST(c_custkey % 15000 AS INT)")} END",
        "segment": "lower(c_mktsegment)", "opt_in": "CASE c_custkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' END",
            "channel": "CASE c_custkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN ' STORE ' END",
        "status": "CASE WHEN c_custkey % 61 = 0 THEN 'lost' WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'inactive ' ELSE 'Active' END",
        "created_at": _S("DATE '1994-01-01' + CAST(c_custkey % 900 AS INT)"),
            "updated_at": f"CASE WHEN c_custkey % 29 = 0 THEN 'never' ELSE {_S("DATE '1996-01-01' + CAST(c_custkey % 300 AS INT) + copy")} END",
    }),
    "raw_item": ("lineitem", "true", "l_suppkey % 20 = 0", {
        "item_id": f"CASE WHEN l_partkey % 701 <> 0 THEN {_S('l_orderkey')} || '-' || {_S('l_linenumber')} END", "order_id": _S("l_orderkey"),
            "product": f"' ' || {_S('l_partkey')}", "sku": f"'sku-' || {_S('l_partkey')}",
        "quantity": f"CASE WHEN l_partkey % 150 = 0 THEN '0' WHEN l_partkey % 151 = 0 THEN 'many' ELSE {_S('CAST(l_quantity AS INT)')} END", "unit_price": _S("CAST(l_extendedprice AS DECIMAL(18,2))"),
        "line_amount": _S("CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_quantity AS INT) + CASE WHEN l_suppkey % 40 = 0 THEN 1 ELSE 0 END"),
            "currency": "CASE WHEN l_linenumber % 2 = 0 THEN 'eur' END",
    }),
    "raw_product": ("part", "true", "p_partkey % 25 = 0", {
        "product": _S("p_partkey"), "sku": f"'sku-' || {_S('p_partkey')} || CASE WHEN copy = 1 THEN 'z' ELSE '' END", "name": "' ' || p_name", "category": "p_type", "brand": "p_brand || ' '",
        "unit_price": f"CASE WHEN p_partkey % 89 = 0 THEN 'tbd' ELSE {_S('CAST(p_retailprice AS DECIMAL(18,2))')} END",
            "is_active": "CASE p_partkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'y' WHEN 3 THEN 'perhaps' END",
    }),
    "raw_case": ("events", "event_type = 'error'", "event_id % 12 = 0", {
        "case_id": _S("event_id"), "customer": f"{_S('user_id')} || ' '", "case_type": "CASE event_id % 4 WHEN 0 THEN 'billing' WHEN 1 THEN 'Delivery' WHEN 2 THEN 'PRODUCT' ELSE 'return' END",
        "priority": "CASE event_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END",
            "status": "CASE WHEN event_id % 3 = 0 THEN 'open' ELSE 'closed' END", "opened_at": _S("date_trunc('second', ts)"),
        "resolved_at": f"CASE WHEN event_id % 90 = 0 THEN {_S("date_trunc('second', ts) - INTERVAL '1' HOUR")} WHEN event_id % 3 "
            f"= 1 THEN {_S("date_trunc('second', ts) + INTERVAL '5' HOUR")} WHEN event_id % 7 = 0 THEN {_S("date_trunc('second', ts) + INTERVAL '100' HOUR")} END",
        "csat": f"CASE WHEN event_id % 11 <> 0 THEN {_S('event_id % 7')} END", "reopens": f"CASE WHEN event_id % 2 = 0 THEN {_S('event_id % 3')} END",
    }),
    "raw_interaction": ("events", "event_type <> 'error'", "event_id % 8 = 0", {
        "interaction_id": _S("event_id"), "customer": _S("user_id"),
            "interaction_type": "CASE event_id % 6 WHEN 0 THEN 'cart_abandoned' WHEN 1 THEN ' Newsletter_Unsubscribe' ELSE event_type END",
            "channel": "CASE WHEN event_id % 2 = 0 THEN 'web ' ELSE event_type END",
        "ts": f"CASE WHEN event_id % 101 = 0 THEN 'soon' ELSE {_S("date_trunc('second', ts)")} END", "campaign": f"CASE WHEN event_id % 3 = 0 THEN 'camp' || {_S('event_id % 9')} END",
    }),
    "raw_loyalty": ("customer", "c_acctbal > 0", "c_custkey % 15 = 0", {
        "account_id": f"'L' || {_S('c_custkey')}", "customer": _S("c_custkey"),
            "tier": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'platinum' WHEN 'BUILDING' THEN 'Gold' WHEN 'FURNITURE' THEN 'SILVER' WHEN 'HOUSEHOLD' THEN "
            "'bronze ' ELSE 'wood' END",
        "balance": f"CASE WHEN c_custkey % 33 <> 0 THEN {_S('c_custkey * 10')} END", "earned": _S("c_custkey % 100 * 10"),
            "redeemed": f"CASE WHEN c_custkey % 45 = 0 THEN {_S('c_custkey % 100 * 10 + 5')} ELSE '0' END",
        "enrolled_at": _S("DATE '1995-01-01' + CAST(c_custkey % 700 AS INT)"),
            "last_activity_at": f"CASE WHEN c_custkey % 21 <> 0 THEN {_S("DATE '2001-01-01' + CAST(c_custkey % 200 AS INT) + copy")} END",
            "status": "CASE WHEN c_custkey % 6 = 0 THEN 'lapsed' ELSE 'active' END",
    }),
    "raw_address": ("customer", "c_custkey % 5 <> 0", "true", {
        "address_id": f"{_S('c_custkey')} || '-' || {_S('copy')}", "customer": _S("c_custkey"), "address_type": "CASE WHEN copy = 0 THEN 'home' ELSE 'work' END",
            "city": f"'City' || {_S('c_custkey % 100')} || {_S('copy')}", "state": f"'s' || {_S('c_custkey % 7')}",
        "postal_code": f"CASE WHEN c_custkey % 13 = 0 THEN ' ' WHEN c_custkey % 14 <> 0 THEN {_S('10000 + c_custkey % 9000')} END",
            "country": "CASE WHEN c_custkey % 3 = 0 THEN 'ca' END", "is_primary": "CASE WHEN copy = 1 AND c_custkey % 2 = 0 THEN 'yes' ELSE 'maybe' END",
            "valid_from": _S("DATE '1995-01-01' + CAST(c_custkey % 900 AS INT)"),
    }),
    "raw_contact": ("customer", "c_custkey % 4 <> 0", "true", {
        "contact_id": f"CASE WHEN c_custkey % 66 <> 0 THEN {_S('c_custkey')} || '-' || {_S('copy')} END", "customer": _S("c_custkey"),
            "contact_type": "CASE WHEN copy = 0 THEN 'email' ELSE 'Phone' END", "contact_value": f"' value' || {_S('c_custkey')}",
        "is_verified": "CASE c_custkey % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN '0' END", "is_primary": "CASE WHEN copy = 0 THEN '1' ELSE 'n' END",
    }),
}


def raw(s: SparkSession, d: str, name: str) -> DataFrame:
    table, rows, again, columns = RAW[name]
    copies = F.explode(F.expr(f"CASE WHEN {again} THEN array(0, 1) ELSE array(0) END"))
    return M.load(s, d, table).where(rows).withColumn("copy", copies).selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def _raw_sql(name: str) -> str:
    table, rows, again, columns = RAW[name]
    return f"{name} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}, (VALUES (0), (1)) c(copy) WHERE ({rows}) AND (copy = 0 OR {again}))"


def _bool(name: str, other: str = "false") -> str:
    return f"CASE WHEN lower(trim({name})) IN ('true','1','y','yes') THEN true WHEN lower(trim({name})) IN ('false','0','n','no') THEN false ELSE {other} END AS {name}"


def _stamped(name: str, typed: str, fails: dict[str, str], warns: dict[str, str], key: str, order: str, more: str = "") -> str:
    """SQL for a staging table: typed columns of its raw one, the status and the rules, the first row of each key."""
    fired = {k: f"coalesce({v}, false)" for k, v in (fails | warns).items()}
    any_of = lambda ids: " OR ".join(fired[i] for i in ids) or "false"
    ids = ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in fired.items()) or "NULL"
    status = f"CASE WHEN {any_of(fails)} THEN 'FAIL' WHEN {any_of(warns)} THEN 'WARN' ELSE 'PASS' END AS dq_status, nullif(concat_ws(' ', {ids}), '') AS dq_failed_rules"
    return f"stg_{name} AS (SELECT *{more}, {status} FROM (SELECT {typed} FROM raw_{name}) WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


_K = "nullif(trim({0}), '') AS {0}".format
_U = "upper(trim({0})) AS {0}".format
_T = "trim({0}) AS {0}".format
_AS = "try_cast({0} AS {1}) AS {0}".format
_MONEY = "DECIMAL(18,2)"
_CURRENCY = "upper(coalesce(currency, 'USD')) AS currency"
_VALID = r"coalesce(regexp_matches(email, '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$'), false)"
_NAME = "lower(coalesce(first_name, '') || '|' || coalesce(last_name, '') || '|' || coalesce(CAST(birth_date AS VARCHAR), ''))"
_HASHED = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in staging.TRACKED)

STAGING = ",\n".join([*map(_raw_sql, RAW), G.STAGED,
    _stamped("customer", ", ".join([_K("customer"), _T("first_name"), _T("last_name"), "lower(trim(email)) AS email",
        "regexp_replace(coalesce(phone, ''), '[^0-9+]', '', 'g') AS phone", _AS("birth_date", "DATE"), _U("segment"), _bool("opt_in", "NULL"), _U("channel"),
        _U("status"), _AS("created_at", "TIMESTAMP"), _AS("updated_at", "TIMESTAMP")]), {},
        {"DQ-C-002": f"NOT {_VALID}", "DQ-C-003": f"birth_date > {DAY} OR birth_date < DATE '1900-01-01'", "DQ-C-004": "status NOT IN ('ACTIVE','INACTIVE','CLOSED')"},
            "customer", "updated_at DESC NULLS LAST, created_at DESC NULLS LAST, email",
        f", trim(coalesce(first_name, '') || ' ' || coalesce(last_name, '')) AS full_name, {_VALID} AS email_is_valid, "
            f"md5(CASE WHEN {_VALID} THEN email ELSE {_NAME} END) AS match_key, md5({_HASHED}) AS row_hash").replace("stg_customer AS", "stg_customer0 AS", 1),
    "stg_customer AS (SELECT * FROM stg_customer0 QUALIFY row_number() OVER (PARTITION BY match_key ORDER BY created_at NULLS LAST, customer) = 1)",
    _stamped("item", ", ".join([_K("item_id"), _T("order_id"), _T("product"), _T("sku"), _AS("quantity", "DECIMAL(12,0)"), _AS("unit_price", _MONEY),
        _AS("line_amount", _MONEY), _CURRENCY]), {"DQ-OI-001": "quantity IS NULL OR quantity <= 0"},
        {"DQ-OI-002": "abs(coalesce(line_amount, 0) - coalesce(quantity, 0) * coalesce(unit_price, 0)) > 0.01"}, "item_id", "order_id, line_amount DESC NULLS LAST, product"),
    _stamped("product", ", ".join([_K("product"), _T("sku"), _T("name"), _T("category"), _T("brand"), _AS("unit_price", _MONEY), _bool("is_active")]),
        {"DQ-P-001": "unit_price IS NULL"}, {}, "product", "sku, name"),
    _stamped("case", ", ".join([_K("case_id"), _T("customer"), _U("case_type"), _U("priority"), _U("status"), _AS("opened_at", "TIMESTAMP"),
        _AS("resolved_at", "TIMESTAMP"), _AS("csat", "INT"), "coalesce(try_cast(reopens AS INT), 0) AS reopens"]), {"DQ-S-002": "resolved_at < opened_at"},
        {"DQ-S-003": "csat NOT BETWEEN 1 AND 5"}, "case_id", "opened_at DESC NULLS LAST, resolved_at DESC NULLS LAST",
            ", round(CAST(date_diff('second', opened_at, resolved_at) AS DOUBLE) / 3600, 2) AS resolution_hours"),
    _stamped("interaction", ", ".join([_K("interaction_id"), _T("customer"), _U("interaction_type"), _U("channel"), _AS("ts", "TIMESTAMP"), _T("campaign")]), {},
        {"DQ-I-001": "ts IS NULL"}, "interaction_id", "ts DESC NULLS LAST, interaction_type"),
    _stamped("loyalty", ", ".join([_K("account_id"), _T("customer"), _U("tier"), *(_AS(c, "DECIMAL(18,0)") for c in ("balance", "earned", "redeemed")),
        _AS("enrolled_at", "DATE"), _AS("last_activity_at", "DATE"), _U("status")]), {},
        {"DQ-L-001": "tier NOT IN ('BRONZE','SILVER','GOLD','PLATINUM')", "DQ-L-003": "coalesce(redeemed, 0) > coalesce(earned, 0)"}, "account_id", "last_activity_at DESC NULLS LAST, customer"),
    _stamped("address", ", ".join([_K("address_id"), _T("customer"), _U("address_type"), _T("city"), _U("state"), _T("postal_code"),
        "upper(coalesce(country, 'US')) AS country", _bool("is_primary"), _AS("valid_from", "DATE")]), {}, {"DQ-A-001": "coalesce(postal_code, '') = ''"}, "address_id",
        "valid_from DESC NULLS LAST, city"),
    _stamped("contact", ", ".join([_K("contact_id"), _T("customer"), _U("contact_type"), _T("contact_value"), _bool("is_verified"), _bool("is_primary")]), {}, {},
        "contact_id", "contact_type, contact_value"),
])


def _loaded(name: str, key: str, more: str = "", where: str = "true") -> str:
    return f"core_{name} AS (SELECT md5({key}) AS sk, * EXCLUDE (dq_status, dq_failed_rules){more} FROM stg_{name} WHERE dq_status <> 'FAIL' AND {where})"


_SLA = "CASE priority WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 24 ELSE 72 END"
CORE = ",\n".join([
    f"core_customer AS (SELECT *, md5(customer || '|' || CAST(valid_from AS VARCHAR)) AS customer_sk FROM (SELECT * EXCLUDE (updated_at, created_at, dq_status), "
        f"coalesce(updated_at, created_at, TIMESTAMP '{AT}') AS valid_from, TIMESTAMP '9999-12-31 00:00:00' AS valid_to, true AS is_current, 1 AS version, 'INSERT' AS "
        f"change_type FROM stg_customer WHERE dq_status <> 'FAIL'))",
    "core_order AS (SELECT md5(order_id) AS sk, s.* EXCLUDE (dq_status, dq_failed_rules), customer_sk, status IN ('COMPLETED','SHIPPED') AS is_revenue_recognised FROM "
        "staged s LEFT JOIN (SELECT customer, customer_sk, valid_from, valid_to FROM core_customer) c ON c.customer = s.customer AND CAST(order_date AS TIMESTAMP) >= "
        "valid_from AND CAST(order_date AS TIMESTAMP) < valid_to WHERE dq_status <> 'FAIL')",
    _loaded("item", "item_id", where="order_id IN (SELECT order_id FROM core_order)"), _loaded("product", "product"),
        _loaded("case", "case_id", f", coalesce(resolution_hours, 999) > {_SLA} AS is_sla_breached"),
    _loaded("interaction", "interaction_id", ", interaction_type IN ('CART_ABANDONED','NEWSLETTER_UNSUBSCRIBE') AS is_negative_signal"),
    _loaded("loyalty", "account_id", ", CASE tier WHEN 'PLATINUM' THEN 4 WHEN 'GOLD' THEN 3 WHEN 'SILVER' THEN 2 WHEN 'BRONZE' THEN 1 ELSE 0 END AS tier_rank"),
        _loaded("address", "address_id"), _loaded("contact", "contact_id"),
])
LAYERS = f"WITH {STAGING},\n{CORE}"
ENTITIES = f""", profiles AS (SELECT c.customer, c.customer_sk, c.match_key AS master_customer_id, c.full_name, c.email, c.phone, c.birth_date, c.segment, c.channel AS
preferred_channel, c.opt_in AS marketing_opt_in, c.status, CAST(s.created_at AS DATE) AS created_at FROM core_customer c JOIN stg_customer s USING (customer) WHERE
is_current),
customers AS (SELECT * FROM profiles), sales AS (SELECT order_id, customer, order_date, status, CAST(exact AS DECIMAL(18,2)) AS net, channel FROM core_order), items AS
(SELECT order_id, product FROM core_item), products AS (SELECT product, category FROM core_product),
touches AS (SELECT customer, channel, ts, is_negative_signal AS negative FROM core_interaction), cases AS (SELECT customer, case_type, status, opened_at, csat,
CAST(resolution_hours AS DECIMAL(18,2)) AS hours, reopens, {_SLA} AS sla_hours FROM core_case),
account AS (SELECT customer, account_id AS loyalty_account, tier, status AS loyalty_status, CAST(balance AS BIGINT) AS points_balance, enrolled_at AS
loyalty_enrolled_at, last_activity_at, tier_rank, CAST(date_diff('day', last_activity_at, {DAY}) AS INT) AS inactive_days FROM core_loyalty),
loyalty AS (SELECT customer, tier_rank, inactive_days FROM account), address AS (SELECT customer, city, state, country FROM core_address QUALIFY row_number() OVER
(PARTITION BY customer ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END, address_type, city) = 1)
"""
BUILT = f"{LAYERS}{ENTITIES}{ORDERS}{SUPPORT}{ENGAGEMENT}{FEATURES}{PARTS}"


def steps(s: SparkSession, d: str) -> list[build.Step]:
    """Every table of the build, each from those before it."""
    spec = {"item": staging.items_spec(), "product": staging.products_spec(), "case": staging.cases_spec(), "interaction": staging.interactions_spec(),
        "loyalty": staging.loyalty_spec(), "address": staging.addresses_spec(), "contact": staging.contacts_spec()}
    keys = {"product": "product", "address": "address_id", "contact": "contact_id"}
    load = {"case": core.cases, "interaction": core.interactions, "loyalty": core.loyalty} | {n: lambda t, k=k: core.type1(t, k) for n, k in keys.items()}
    hours = F.col("resolution_hours").cast("decimal(18,2)")
    return [
        build.Step("stg_customer", lambda: staging.stage_customers(raw(s, d, "raw_customer"), M.AS_OF)),
        build.Step("stg_order", lambda: G._staged(s, d)),
        *(build.Step(f"stg_{n}", lambda n=n: staging.stage(raw(s, d, f"raw_{n}"), spec[n])) for n in spec),
        build.Step("core_customer", lambda t: core.customers(t, AT), ("stg_customer",)),
        build.Step("core_order", core.orders, ("stg_order", "core_customer")),
        build.Step("core_item", core.order_items, ("stg_item", "core_order")),
        *(build.Step(f"core_{n}", f, (f"stg_{n}",)) for n, f in load.items()),
        build.Step("order_summary", lambda o, i, p: A.order_summary(o, i, p, M.AS_OF), ("core_order", "core_item", "core_product")),
        build.Step("support_summary", lambda c: A.support_summary(c.withColumns({"hours": hours, "sla_hours": core.allowed_hours(F.col("priority"))}), M.EVENT_AS_OF), ("core_case",)),
        build.Step("combined", _combined, ("core_customer", "stg_customer", "order_summary", "support_summary", "core_interaction", "core_loyalty")),
        build.Step("customer_360", lambda c, a: core.full_view(c, a, M.AS_OF, AT), ("combined", "core_address")),
        build.Step("features", lambda c: core.dated_features(c, M.AS_OF), ("combined",)),
        build.Step("churn_score", lambda c: c.select("customer", "churn.*", F.lit(M.AS_OF).alias("score_date")), ("combined",)),
    ]


def _combined(customers: DataFrame, staged: DataFrame, orders: DataFrame, support: DataFrame, touches: DataFrame, accounts: DataFrame) -> DataFrame:
    c = F.col
    profiles = customers.where("is_current").join(staged.select("customer", "created_at"), "customer").select(
        "customer", "customer_sk", c("match_key").alias("master_customer_id"), "full_name", "email", "phone", "birth_date", "segment",
            c("channel").alias("preferred_channel"), c("opt_in").alias("marketing_opt_in"), "status", "created_at"
    )
    account = accounts.select("customer", c("account_id").alias("loyalty_account"), "tier", c("status").alias("loyalty_status"),
        c("balance").cast("long").alias("points_balance"), c("enrolled_at").alias("loyalty_enrolled_at"), "last_activity_at", "tier_rank",
        F.datediff(F.lit(M.AS_OF), "last_activity_at").alias("inactive_days"))
    return A.combined(profiles, orders, support, touches.withColumnRenamed("is_negative_signal", "negative"), account, M.EVENT_AS_OF)


def built(s: SparkSession, d: str) -> Store:
    """The build in a folder of its own."""
    store = Store(s, scratch(s, "warehouse"))
    build.run(store, steps(s, d), "all")
    return store


@query(f"{BUILT}, full360 AS ({FULL_COLUMNS}) SELECT * EXCLUDE as_of_timestamp FROM full360")
def pipeline_build(s: SparkSession, d: str) -> DataFrame:
    """The unified view at the end of a whole build: raw text of nine sources, staged, loaded, summarised; each table is computed once."""
    return built(s, d).read("customer_360").drop("as_of_timestamp")


def _made(s: SparkSession, d: str, name: str) -> DataFrame:
    """One table of the build, by the plans of the steps that it needs, none of them written."""
    by_name = {x.name: x for x in steps(s, d)}
    make = lambda n: by_name[n].make(*map(make, by_name[n].needs))
    return make(name)


_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}".format


@query(f"{LAYERS} SELECT * REPLACE ({_STAMP('created_at')}, {_STAMP('updated_at')}) FROM stg_customer")
def stage_customers(s: SparkSession, d: str) -> DataFrame:
    """Customers after both stages of identity resolution."""
    return G._text(_made(s, d, "stg_customer"), "created_at", "updated_at")


def _numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines show them alike."""
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema if f.dataType.typeName() == "decimal"})


@query(f"{LAYERS} SELECT * REPLACE (CAST(quantity AS DOUBLE) AS quantity, CAST(unit_price AS DOUBLE) AS unit_price, CAST(line_amount AS DOUBLE) AS line_amount) FROM core_item")
def core_items(s: SparkSession, d: str) -> DataFrame:
    """Order lines of orders that were loaded."""
    return _numbers(_made(s, d, "core_item"))


@query(f"{LAYERS} SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price) FROM core_product")
def core_products(s: SparkSession, d: str) -> DataFrame:
    return _numbers(_made(s, d, "core_product"))


@query(f"{LAYERS} SELECT * REPLACE ({_STAMP('opened_at')}, {_STAMP('resolved_at')}) FROM core_case")
def core_cases(s: SparkSession, d: str) -> DataFrame:
    """Cases with the hours they took and whether that broke the agreement for their priority."""
    return G._text(_made(s, d, "core_case"), "opened_at", "resolved_at")


@query(f"{LAYERS} SELECT * REPLACE ({_STAMP('ts')}) FROM core_interaction")
def core_interactions(s: SparkSession, d: str) -> DataFrame:
    return G._text(_made(s, d, "core_interaction"), "ts")


@query(f"{LAYERS} SELECT * REPLACE (CAST(balance AS DOUBLE) AS balance, CAST(earned AS DOUBLE) AS earned, CAST(redeemed AS DOUBLE) AS redeemed) FROM core_loyalty")
def core_loyalty(s: SparkSession, d: str) -> DataFrame:
    return _numbers(_made(s, d, "core_loyalty"))


@query(f"{LAYERS} SELECT address_id AS id, customer, address_type AS kind, city || '/' || state || '/' || country AS value, is_primary, dq_status FROM stg_address UNION "
    f"ALL SELECT contact_id, customer, contact_type, contact_value, is_primary, dq_status FROM stg_contact")
def stage_addresses_contacts(s: SparkSession, d: str) -> DataFrame:
    """Staged addresses and contacts in one list."""
    a, c = _made(s, d, "stg_address"), _made(s, d, "stg_contact")
    place = F.concat_ws("/", "city", "state", "country")
    return a.select(F.col("address_id").alias("id"), "customer", F.col("address_type").alias("kind"), place.alias("value"), "is_primary",
        "dq_status").union(c.select("contact_id", "customer", "contact_type", "contact_value", "is_primary", "dq_status"))
