"""What readers of the warehouse ask for: cohorts, pages, actions, safe statements, nested documents."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import policies
from tessera.sources.store import Store

RISK = ("HIGH", "CRITICAL")


def high_risk_cohort(whole: DataFrame, k: int) -> DataFrame:
    """The k customers at risk with the largest realised value."""
    return whole.where(F.col("band").isin(*RISK)).select("customer", "band", "clv_realised").orderBy(F.desc("clv_realised"), "customer").limit(k)


def next_best_action(whole: DataFrame, premium: str) -> DataFrame:
    """The first action that applies, and whether the customer is a VIP."""
    risk, open_ = F.col("band").isin(*RISK), F.col("open_cases") > 0
    late = F.coalesce("days_since_last_order", F.lit(9999)) >= 120
    action = F.when(open_, "RESOLVE_OPEN_CASE").when(risk & late, "RETENTION_OFFER_15_PCT").when(risk, "PROACTIVE_SERVICE_CALL").when(F.col("tier_rank") == 0,
        "DOUBLE_POINTS_MONTH").otherwise("NO_ACTION")
    return whole.select("customer", action.alias("action"), F.when(open_ | (risk & late), "HIGH").when(risk, "MEDIUM").otherwise("LOW").alias("priority"),
        ((F.col("segment") == premium) | (F.col("value_tier") == "HIGH")).alias("vip"))


def page(df: DataFrame, size: int, offset: int, *order) -> DataFrame:
    """A page of rows in a total order, with the number of all rows and whether more follow."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + size)


_FORBIDDEN = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|call|set|use|copy|put|get|refresh|cache|add|load)\b", re.I)


def statement(spark: SparkSession, text: str, bindings: dict[str, object] | None = None) -> DataFrame:
    """A single SELECT or WITH statement; values are bound in the order of their integer keys."""
    plain = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";")
    if not re.match(r"(?i)(select|with)\b", plain):
        raise ValueError("only SELECT and WITH statements are read")
    if ";" in plain:
        raise ValueError("one statement at a time")
    if m := _FORBIDDEN.search(plain):
        raise ValueError(f"not allowed in a statement that reads: {m[0]}")
    values = [v for _, v in sorted((bindings or {}).items(), key=lambda x: int(x[0]))]
    return spark.sql(text.rstrip().rstrip(";"), args=values) if values else spark.sql(text.rstrip().rstrip(";"))


def row_types(df: DataFrame) -> dict[str, str]:
    """The row type of each column, as the API calls it."""
    name = lambda t: "FIXED" if isinstance(t, T.IntegralType | T.DecimalType) else "REAL" if isinstance(t, T.FractionalType) else {T.BooleanType: "BOOLEAN",
        T.DateType: "DATE", T.TimestampType: "TIMESTAMP_NTZ", T.TimestampNTZType: "TIMESTAMP_NTZ", T.ArrayType: "ARRAY"}.get(type(t), "TEXT")
    return {f.name: name(f.dataType) for f in df.schema}


def rendered(df: DataFrame) -> DataFrame:
    """All values as text, as the API returns them: true and false, dates and times in ISO form (fractions of a second only where there are any), arrays in brackets with null for missing elements."""

    def text(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
        if isinstance(f.dataType, T.ArrayType):
            return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ",", "null"), F.lit("]")))
        return c.cast("string")

    return df.select(*(text(f).alias(f.name) for f in df.schema))


def coerced(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text as the row types say: FIXED (the whole part), REAL and BOOLEAN (true, 1 and t in any case, else false); other types stay text. A number that can't be read is NULL."""

    def value(name: str):
        c = F.col(f"`{name}`")
        kind = types.get(name)
        if kind == "FIXED":
            return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))
        if kind == "REAL":
            return c.try_cast("double")
        return F.lower(c).isin("true", "1", "t") if kind == "BOOLEAN" else c

    return df.select(*(value(n).alias(n) for n in df.columns))


def camel(name: str) -> str:
    """snake_case as camelCase."""
    head, *rest = name.lower().split("_")
    return head + "".join(p.title() for p in rest)


def _newest(df: DataFrame, at: str, key: str, k: int, name: str) -> DataFrame:
    """customer and an array of its k rows with the latest times, as structs: rows are numbered first, so that no more than k of a customer are ever put together."""
    w = Window.partitionBy("customer").orderBy(F.desc(at), F.desc(key))
    row = F.struct(at, key, *(c for c in df.columns if c not in ("customer", at, key)))
    top = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return top.groupBy("customer").agg(F.sort_array(F.collect_list(row), asc=False).alias(name))


def documents(whole: DataFrame, orders: DataFrame, k: int, degraded: tuple[str, ...] = ()) -> DataFrame:
    """A nested document for each customer with its k latest orders; nulls are left out of the JSON, missing branches are named."""
    top = _newest(orders.select("customer", "order_date", "order_id", "status", "net"), "order_date", "order_id", k, "orders")
    doc = whole.join(top, "customer", "left").select("customer",
        F.struct(*(F.col(c).alias(camel(c)) for c in whole.columns), F.coalesce("orders", F.array().cast(top.schema["orders"].dataType)).alias("orders"),
        F.array(*map(F.lit, degraded)).cast("array<string>").alias("degradedFields")).alias("d"))
    return doc.select("customer", F.to_json("d").alias("document"))


def branches(store: Store, parts: dict[str, Callable[[], DataFrame]], seconds: float = 600.0, needed: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame | None], dict[str, str]]:
    """Tables of named reads, each planned, run and written on its own, all side by side; and why those that are None failed.

    An error of one, when it is planned or while it runs, or a run of more than so many seconds leaves the others alone. An error of a needed read is raised. A read
    without rows is no failure. What is written belongs to a run of the store that is never published."""
    run = store.begin()

    def read(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        store.spark.addTag(f"{run}-{name}")
        return store.frame(store.write(make(), name, run))

    frames: dict[str, DataFrame | None] = {}
    failed: dict[str, str] = {}
    pool = ThreadPoolExecutor(max(1, len(parts)))
    try:
        jobs = {n: pool.submit(inheritable_thread_target(store.spark)(read), n, make) for n, make in parts.items()}
        end = time.monotonic() + seconds
        for n, job in jobs.items():
            try:
                frames[n] = job.result(max(0.0, end - time.monotonic()))
            except Exception as e:
                if n in needed:
                    raise
                frames[n], failed[n] = None, f"{type(e).__name__}: {str(e)[:300]}"
                store.spark.interruptTag(f"{run}-{n}")
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return frames, failed


#: Where the columns of the full view stand in a nested document.
BLOCKS = {
    "profile": ["full_name", "email", "phone", "birth_date", "segment", "preferred_channel", "marketing_opt_in", "customer_status", "customer_since", "tenure_days", "city", "state", "country"],
    "loyalty": ["loyalty_account", "loyalty_tier", "loyalty_status", "loyalty_points_balance", "loyalty_enrolled_at"],
    "analytics": ["customer_lifetime_value", "predicted_clv_12m", "value_tier", "engagement_score", "total_orders", "total_net_revenue", "avg_order_value", "return_rate", "open_cases", "avg_csat"],
}


def nested(whole: DataFrame, orders: DataFrame | None, cases: DataFrame | None, churn: DataFrame | None, drivers: DataFrame | None, k: int = 10) -> DataFrame:
    """customer and a document (struct) of the full view in blocks, with the k latest orders (customer, order_date, order_id and more), the k latest cases (customer, opened_at, case_id and more),
    the score (customer, probability, band) with its drivers (customer, rank, driver, contribution) and the sources as an array.

    A branch that is None couldn't be read (branches() tells): it gets its default (an empty array or null), and the document is partial and names it. A customer without
    rows in a branch has the default, too, but that is no outage."""
    fields = {"orders": orders, "cases": cases, "churn": churn}
    degraded = sorted(n for n, df in fields.items() if df is None)
    out = whole

    def latest(df: DataFrame | None, name: str, at: str, key: str) -> None:
        nonlocal out
        if df is None:
            out = out.withColumn(f"_{name}", F.array())
            return
        top = _newest(df, at, key, k, f"_{name}")
        out = out.join(top, "customer", "left").withColumn(f"_{name}", F.coalesce(f"_{name}", F.array().cast(top.schema[f"_{name}"].dataType)))

    latest(orders, "orders", "order_date", "order_id")
    latest(cases, "cases", "opened_at", "case_id")
    if churn is None:
        out = out.withColumn("_churn", F.lit(None))
    else:
        scored = churn.select("customer", "probability", F.col("band").alias("_band"))
        if drivers is not None:
            scored = scored.join(drivers.groupBy("customer").agg(F.sort_array(F.collect_list(F.struct("rank", "driver", "contribution"))).alias("_drivers")), "customer", "left")
        risk = F.struct("probability", F.col("_band").alias("band"), *([F.col("_drivers").alias("drivers")] if drivers is not None else []))
        out = out.join(scored.select("customer", risk.alias("_churn")), "customer", "left")
    block = lambda names: F.struct(*(F.col(c).alias(camel(c)) for c in names if c in whole.columns))
    quality = F.struct(F.col("data_completeness_score").alias("completenessScore"), F.split("contributing_sources", ",").alias("contributingSources"))
    return out.select("customer", F.struct(
        F.col("customer").alias("customerId"), *(block(names).alias(n) for n, names in BLOCKS.items()), F.col("_orders").alias("orders"),
            F.col("_cases").alias("support"), F.col("_churn").alias("churnRisk"), quality.alias("dataQuality"),
        F.lit(bool(degraded)).alias("partial"), F.array(*map(F.lit, degraded)).cast("array<string>").alias("degradedFields"),
    ).alias("document"))


def store_view(whole: DataFrame, may_see: bool, premium: str = "PREMIUM") -> DataFrame:
    """What a shop's screen shows of a customer. Address, phone and date of birth aren't masked but absent: the columns are named one by one, so a new column of the full view can't slip in. A derived flag stands for the value behind it."""
    c = F.col
    vip = F.coalesce(c("segment") == premium, F.lit(False)) | F.coalesce(c("value_tier") == "HIGH", F.lit(False))
    name = c("full_name") if may_see else policies.api_full_name(c("full_name"))
    return whole.select("customer", name.alias("display_name"), "segment", c("customer_status").alias("status"), vip.alias("vip"), "loyalty_tier",
        "loyalty_points_balance", c("data_completeness_score").alias("completeness"), F.lit(not may_see).alias("masked"))


#: Personal fields that views for models and shops must not have.
PERSONAL = ("full_name", "email", "phone", "birth_date", "city", "postal_code")
#: What a model may see of a customer: behaviour only. Names, addresses, phones and birth dates are absent because nothing here names them.
MODEL_CONTEXT = [
    "customer", "segment", "value_tier", "tenure_days", "total_orders", "total_net_revenue", "avg_order_value", "order_frequency_per_year", "days_since_last_order",
        "total_cases", "open_cases", "cases_last_90d", "avg_csat", "top_case_type",
    "loyalty_tier", "loyalty_status", "loyalty_points_balance", "interactions_last_90d", "negative_signals_90d", "engagement_score",
]


def model_view(whole: DataFrame, facts: list[str] = MODEL_CONTEXT) -> DataFrame:
    """What a model may read of a customer: the named facts and nothing else. An error if a personal field is among them."""
    if there := set(facts) & set(PERSONAL):
        raise ValueError(f"personal fields: {sorted(there)}")
    return whole.select(*facts)
