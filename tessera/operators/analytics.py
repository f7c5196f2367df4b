"""Per-customer summaries. Each is one pass over its facts with conditional aggregates; joins are on the customer key only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import money, ratio, rounded

REVENUE = ("COMPLETED", "SHIPPED")


def _count(c: Column) -> Column:
    return F.count(F.when(c, 1))


def _mean(total: Column, n: Column, digits: int = 2) -> Column:
    """Decimal mean, half up."""
    return F.round(total / F.nullif(n, F.lit(0)), digits)


def categories(sales: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct product categories bought, over all statuses: a star join of facts with a dimension."""
    return sales.select("customer", "order_id").join(items.select("order_id", "product"), "order_id").join(products.select("product", "category"),
        "product").groupBy("customer").agg(F.countDistinct("category").alias("distinct_categories"))


def _rolled_up(by_value: DataFrame, value: str, name: str, **columns: str) -> DataFrame:
    """Aggregates by customer from those by customer and value (columns: sum, min or max), and the customer's most common value, the least in a tie, as name: one pass over the facts. _n counts rows."""
    kind = lambda c: by_value.schema[c].dataType
    rolled = [getattr(F, how)(c).cast(kind(c)).alias(c) for c, how in columns.items()]
    return by_value.groupBy("customer").agg(F.sum("_n").alias("_n"), *rolled, F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def order_summary(sales: DataFrame, items: DataFrame, products: DataFrame, as_of: dt.date) -> DataFrame:
    sales = sales.where("customer IS NOT NULL")
    day = F.lit(as_of)
    rev = F.col("status").isin(*REVENUE)
    near = lambda n: F.col("order_date") >= F.date_sub(day, n)
    prior = (F.col("order_date") >= F.date_sub(day, 365)) & (F.col("order_date") < F.date_sub(day, 90))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = {
        "completed_orders": _count(F.col("status") == "COMPLETED"), "cancelled_orders": _count(F.col("status") == "CANCELLED"), "returned_orders": _count(F.col("status") == "RETURNED"),
        "total_net_revenue": zero(F.sum(F.when(rev, F.col("net")))), "_rev": _count(rev), "orders_last_90d": _count(near(90)), "orders_last_365d": _count(near(365)),
        "revenue_last_90d": zero(F.sum(F.when(near(90) & rev, F.col("net")))), "revenue_last_365d": zero(F.sum(F.when(near(365) & rev, F.col("net")))),
            "orders_prior": _count(prior), "revenue_prior": zero(F.sum(F.when(prior & rev, F.col("net")))),
    }
    by_channel = sales.groupBy("customer", "channel").agg(
        F.count("*").alias("_n"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"),
        zero(F.max(F.when(rev, F.col("net")))).alias("max_order_value"), *(c.alias(n) for n, c in sums.items()),
    )
    facts = _rolled_up(by_channel, "channel", "primary_channel", first_order_date="min", last_order_date="max", max_order_value="max",
        **dict.fromkeys(sums, "sum")).withColumnRenamed("_n", "total_orders")
    days = F.greatest(F.datediff(day, F.col("first_order_date")), F.lit(30))
    facts = facts.withColumns({
        "days_since_last_order": F.datediff(day, F.col("last_order_date")), "avg_order_value": zero(_mean(F.col("total_net_revenue"), F.col("_rev"))),
        "order_frequency_per_year": rounded(F.col("total_orders") * 365.0 / days, 4), "return_rate": ratio(F.col("returned_orders"), F.col("total_orders")), "as_of_date": day,
    })
    out = facts.join(categories(sales, items, products), "customer", "left")
    amounts = {c: money(F.col(c)).cast("double") for c in ("total_net_revenue", "max_order_value", "revenue_last_90d", "revenue_last_365d", "revenue_prior", "avg_order_value")}
    return out.withColumns({"distinct_categories": zero(F.col("distinct_categories")), "order_frequency_per_year": F.col("order_frequency_per_year").cast("double")} | amounts).drop("_rev")


def support_summary(cases: DataFrame, as_of: dt.date) -> DataFrame:
    near = lambda n: F.col("opened_at") >= F.date_sub(F.lit(as_of), n).cast("timestamp")
    sums = {
        "open_cases": _count(F.col("status") == "OPEN"), "cases_last_90d": _count(near(90)), "cases_last_365d": _count(near(365)),
            "_csat": F.sum(F.col("csat").cast("decimal(18,2)")), "_rated": F.count("csat"),
        "_hours": F.sum("hours"), "_resolved": F.count("hours"), "total_reopens": F.sum(F.coalesce("reopens", F.lit(0))), "sla_breaches": _count(F.coalesce("hours", F.lit(999)) > F.col("sla_hours")),
    }
    by_type = cases.where("customer IS NOT NULL").groupBy("customer", "case_type").agg(F.count("*").alias("_n"), F.min("csat").alias("min_csat"),
        F.max(F.to_date("opened_at")).alias("last_case_date"), *(c.alias(n) for n, c in sums.items()))
    out = _rolled_up(by_type, "case_type", "top_case_type", min_csat="min", last_case_date="max", **dict.fromkeys(sums, "sum")).withColumnRenamed("_n", "total_cases")
    return out.withColumns({
        "avg_csat": _mean(F.col("_csat"), F.col("_rated")).cast("double"), "avg_resolution_hours": _mean(F.col("_hours"), F.col("_resolved")).cast("double"),
            "days_since_last_case": F.datediff(F.lit(as_of), F.col("last_case_date")),
    }).drop("_csat", "_rated", "_hours", "_resolved")


def combined(customers: DataFrame, orders: DataFrame, support: DataFrame, touches: DataFrame, loyalty: DataFrame, as_of: dt.date) -> DataFrame:
    """One row for each customer, those without any activity too: all columns of customers, of the summaries of orders and support, of its loyalty account and of its interactions, with
    _orders, _support and _loyalty (true, or null where it has none), and structs features, parts (contributions to churn) and churn (the score).

    All that is said of a customer is computed within this row: the only joins are those of the summaries, each read once."""
    near = lambda n: F.col("ts") >= F.date_sub(F.lit(as_of), n).cast("timestamp")
    seen = touches.where("customer IS NOT NULL").groupBy("customer").agg(
        _count(near(90)).alias("interactions_last_90d"), _count(near(365)).alias("interactions_last_365d"), _count(near(90) & F.col("negative")).alias("negative_signals_90d"),
        F.max(F.to_date("ts")).alias("last_interaction_date"), F.countDistinct("channel").alias("distinct_channels"),
    )
    here = lambda df, name: df.withColumn(name, F.lit(True))
    out = customers
    for part in (here(orders, "_orders"), here(support, "_support"), seen, here(loyalty.dropDuplicates(["customer"]), "_loyalty")):
        out = out.join(part, "customer", "left")
    counts = ("interactions_last_90d", "interactions_last_365d", "negative_signals_90d", "distinct_channels")
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts} | {"days_since_interaction": F.datediff(F.lit(as_of), F.col("last_interaction_date"))})
    out = out.withColumn("engagement_score", _engagement_score()).withColumn("features", F.struct(*_features()))
    out = out.withColumn("parts", F.struct(*_contributions(F.col("features"))))
    return out.withColumn("churn", F.struct(*_score(F.col("parts"))))


def _engagement_score() -> Column:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    cap = lambda x: F.least(F.lit(1.0), x)
    score = (
        30 * F.greatest(F.lit(0.0), 1 - F.coalesce("days_since_last_order", F.lit(999)) / 365.0) + 25 * cap(zero("order_frequency_per_year") / 12) + 15 * cap(zero("interactions_last_90d") / 10)
        + 15 * zero("tier_rank") / 4 + 15 * (F.coalesce("avg_csat", F.lit(3.5)).cast("double") - 1) / 4 - 10 * cap(zero("negative_signals_90d") / 3)
    )
    return rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 6)


ENGAGEMENT = ["interactions_last_90d", "interactions_last_365d", "negative_signals_90d", "distinct_channels", "last_interaction_date", "days_since_interaction", "engagement_score"]


def engagement_summary(all_of: DataFrame) -> DataFrame:
    """Interactions and the score of engagement, from combined rows."""
    return all_of.select("customer", *ENGAGEMENT)


def _features() -> list[Column]:
    """Features of a combined row, with defaults for customers without activity."""
    or_ = lambda c, x: F.coalesce(F.col(c), F.lit(x)).alias
    trend = F.coalesce(rounded((F.col("orders_last_90d") / 90.0).cast("double") / F.nullif((F.col("orders_prior") / 275.0).cast("double"), F.lit(0.0)), 4), F.lit(0.0))
    return [
        or_("days_since_last_order", 9999)("recency_days"), or_("orders_last_365d", 0)("frequency_365d"), or_("revenue_last_365d", 0.0)("monetary_365d"),
            or_("avg_order_value", 0.0)("avg_order_value"),
        trend.alias("order_trend_ratio"), or_("cases_last_90d", 0)("cases_90d"), or_("open_cases", 0)("open_cases"), or_("avg_csat", 3.5)("avg_csat"),
            or_("total_reopens", 0)("reopen_count"), or_("sla_breaches", 0)("sla_breaches"),
        or_("tier_rank", 0)("loyalty_tier_rank"), or_("inactive_days", 9999)("loyalty_inactive_days"), or_("engagement_score", 0.0)("engagement_score"),
            or_("negative_signals_90d", 0)("negative_signals_90d"), or_("return_rate", 0.0)("return_rate"),
    ]


def features(all_of: DataFrame) -> DataFrame:
    """One row of features for each customer, from combined rows."""
    return all_of.select("customer", "features.*")


#: Drivers of churn and their weights.
DRIVERS = {"PURCHASE_RECENCY": 0.30, "DECLINING_ORDER_TREND": 0.20, "SUPPORT_CASE_VOLUME": 0.15, "LOW_SATISFACTION": 0.10, "LOW_ENGAGEMENT": 0.10, "LOYALTY_INACTIVITY": 0.08, "NEGATIVE_SIGNALS": 0.07}
#: Least sum of each band.
BANDS = {"CRITICAL": 0.70, "HIGH": 0.50, "MEDIUM": 0.30, "LOW": 0.0}


def _contributions(f: Column) -> list[Column]:
    d = lambda c: f[c].cast("double")
    low, one, zero = F.least, F.lit(1.0), F.lit(0.0)
    part = {
        "PURCHASE_RECENCY": low(one, d("recency_days") / 240), "DECLINING_ORDER_TREND": F.greatest(zero, 1 - low(one, d("order_trend_ratio"))), "SUPPORT_CASE_VOLUME": low(one, d("cases_90d") / 3),
        "LOW_SATISFACTION": F.greatest(zero, (4 - low(F.lit(5.0), d("avg_csat"))) / 3), "LOW_ENGAGEMENT": F.greatest(zero, 1 - d("engagement_score") / 100),
            "LOYALTY_INACTIVITY": low(one, d("loyalty_inactive_days") / 365), "NEGATIVE_SIGNALS": low(one, d("negative_signals_90d") / 2),
    }
    return [rounded(w * part[n], 6).alias(n) for n, w in DRIVERS.items()]


def contributions(f: DataFrame) -> DataFrame:
    """customer and a column for each driver, from rows of features."""
    return f.select("customer", *_contributions(F.struct(*(c for c in f.columns if c != "customer"))))


def drivers(parts: DataFrame, k: int = 3) -> DataFrame:
    """The k largest contributions of each customer with their rank: an unpivot within the row, without a shuffle."""
    pairs = F.array(*(F.struct((-F.col(n)).alias("minus"), F.lit(n).alias("driver")) for n in DRIVERS))
    return parts.select("customer", F.posexplode(F.slice(F.array_sort(pairs), 1, k)).alias("pos", "d")).select("customer", (F.col("pos") + 1).alias("rank"),
        F.col("d.driver").alias("driver"), (-F.col("d.minus")).alias("contribution"))


def _score(p: Column) -> list[Column]:
    score = rounded(sum((p[n] for n in list(DRIVERS)[1:]), p[next(iter(DRIVERS))]), 4)
    band = F.lit("LOW")
    for name, least in sorted(BANDS.items(), key=lambda x: x[1]):
        band = F.when(score >= least, name).otherwise(band)
    first = F.element_at(F.array_sort(F.array(*(F.struct((-p[n]).alias("minus"), F.lit(n).alias("driver")) for n in DRIVERS))), 1)
    return [F.greatest(F.lit(0.01), F.least(F.lit(0.99), score)).alias("probability"), band.alias("band"), first["driver"].alias("top_driver")]


def churn_score(parts: DataFrame) -> DataFrame:
    """Probability, band (of the sum before it is clamped) and the first driver."""
    return parts.select("customer", *_score(F.struct(*DRIVERS)))


def predicted_value() -> Column:
    """Value that a combined row's customer is expected to bring in a year, rounded as decimals are."""
    part = lambda c, x, kind: F.coalesce(F.col(c), F.lit(x)).cast(kind)
    stays = (1 - F.coalesce("churn.probability", F.lit(0.25))).cast("decimal(6,4)")
    return F.round(part("avg_order_value", 0.0, "decimal(18,2)") * part("order_frequency_per_year", 0.0, "decimal(10,4)") * stays, 2).cast("double")


def customer_360(all_of: DataFrame, *more: str) -> DataFrame:
    """The unified view: one row for each customer, from combined rows (with name and segment), and more of their columns."""
    zero = lambda c, x=0: F.coalesce(F.col(c), F.lit(x))
    revenue = zero("total_net_revenue", 0.0)
    known = [F.col("name").isNotNull(), F.col("segment").isNotNull(), F.col("_orders").isNotNull(), F.col("_support").isNotNull(), F.col("_loyalty").isNotNull()]
    came = {"_orders": "OMS", "_support": "SUPPORT", "_loyalty": "LOYALTY", "last_interaction_date": "ENGAGEMENT"}
    sources = F.concat(F.lit("CRM"), *(F.when(F.col(c).isNotNull(), f",{name}").otherwise("") for c, name in came.items()))
    return all_of.select(
        "customer", "segment", zero("total_orders").alias("total_orders"), revenue.alias("clv_realised"), predicted_value().alias("clv_predicted"),
        F.when(revenue >= 2000, "HIGH").when(revenue >= 500, "MEDIUM").otherwise("LOW").alias("value_tier"), zero("open_cases").alias("open_cases"), "engagement_score",
            zero("tier_rank").alias("tier_rank"), "churn.band",
        F.round(100 * sum((k.cast("int") for k in known[1:]), known[0].cast("int")) / F.lit(len(known)), 2).alias("completeness"), sources.alias("contributing_sources"), *more,
    )
