"""The Type-1 core layer and what is built on it: surrogate keys, facts with the customer version of their day, dated features and scores, the full customer view."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.exprs import latest
from tessera.operators import scd2
from tessera.operators.analytics import predicted_value

#: Fixed values.
FEATURE_SET = "v1.2.0"
REVENUE = ("COMPLETED", "SHIPPED")
SLA_HOURS = {"CRITICAL": 2, "HIGH": 8, "MEDIUM": 24}
OTHER_SLA_HOURS, UNRESOLVED_HOURS = 72, 999
TIER_RANK = {"PLATINUM": 4, "GOLD": 3, "SILVER": 2, "BRONZE": 1}
NEGATIVE = ("CART_ABANDONED", "NEWSLETTER_UNSUBSCRIBE")


def surrogate(key: Column, effective: Column | None = None) -> Column:
    """A key that rebuilds don't change: MD5 of the business key, and for versions of the time from which they hold."""
    return F.md5(key.cast("string") if effective is None else F.concat(key.cast("string"), F.lit("|"), effective.cast("string")))


def loaded(staged: DataFrame) -> DataFrame:
    """Staged rows that may be loaded; the rest stay in staging, reported by the rules."""
    return staged.where("dq_status <> 'FAIL'").drop("dq_status", "dq_failed_rules")


def type1(staged: DataFrame, key: str) -> DataFrame:
    """A Type-1 table: staged rows with a surrogate key first."""
    return loaded(staged).select(surrogate(F.col(key)).alias("sk"), "*")


def orders(staged: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the key of the customer version of their day (null where none held) and whether their revenue is recognised. customers: versions with customer, customer_sk, valid_from and valid_to."""
    facts = type1(staged, "order_id").withColumn("_day", F.col("order_date").cast("timestamp"))
    return scd2.as_of_join(facts, customers, "customer", "_day", ["customer_sk"]).drop("_day").withColumn("is_revenue_recognised", F.col("status").isin(*REVENUE))


def order_items(staged: DataFrame, core_orders: DataFrame) -> DataFrame:
    """Order lines of orders that are loaded; orphans are reported by a rule."""
    return type1(staged, "item_id").join(core_orders.select("order_id"), "order_id", "left_semi")


def allowed_hours(priority: Column) -> Column:
    """How long a case of a priority may take."""
    allowed = F.lit(OTHER_SLA_HOURS)
    for name, most in SLA_HOURS.items():
        allowed = F.when(priority == name, most).otherwise(allowed)
    return allowed


def breached(priority: Column, hours: Column) -> Column:
    """Whether a case took longer than its priority allows; open ones do."""
    return F.coalesce(hours, F.lit(UNRESOLVED_HOURS)) > allowed_hours(priority)


def customers(staged: DataFrame, now: dt.datetime) -> DataFrame:
    """The Type-2 dimension after its first load of staged customers, with a key for each version."""
    attributes = [f for f in staged.schema if f.name not in ("row_hash", "updated_at", "created_at", "dq_status")]
    spans = "row_hash string, valid_from timestamp, valid_to timestamp, is_current boolean, version int, change_type string"
    empty = staged.sparkSession.createDataFrame([], T.StructType([*attributes, *T._parse_datatype_string(spans).fields]))
    return scd2.apply(empty, staged, "customer", F.lit(now)).withColumn("customer_sk", surrogate(F.col("customer"), F.col("valid_from")))


def cases(staged: DataFrame) -> DataFrame:
    return type1(staged, "case_id").withColumn("is_sla_breached", breached(F.col("priority"), F.col("resolution_hours")))


def interactions(staged: DataFrame) -> DataFrame:
    return type1(staged, "interaction_id").withColumn("is_negative_signal", F.col("interaction_type").isin(*NEGATIVE))


def tier_rank(tier: Column) -> Column:
    rank = F.lit(0)
    for name, n in TIER_RANK.items():
        rank = F.when(tier == name, n).otherwise(rank)
    return rank


def loyalty(staged: DataFrame) -> DataFrame:
    return type1(staged, "account_id").withColumn("tier_rank", tier_rank(F.col("tier")))


def main_address(addresses: DataFrame) -> DataFrame:
    """One address of each customer: a primary one, else by type."""
    return latest(addresses, ["customer"], F.when(F.col("is_primary"), 0).otherwise(1), F.col("address_type"), F.col("city")).select("customer", "city", "state", "country")


def dated_features(all_of: DataFrame, as_of: dt.date) -> DataFrame:
    """Features of combined rows (with created_at) with the day, the tenure, the trend of revenue (a day's revenue in the last 90 days against that in the 275 before) and the version of the set."""
    day = F.lit(as_of)
    trend = F.coalesce(F.round((F.col("revenue_last_90d") / 90.0) / F.nullif(F.col("revenue_prior") / 275.0, F.lit(0.0)), 4), F.lit(0.0))
    return all_of.select("customer", day.alias("feature_date"), "features.*", F.datediff(day, F.to_date("created_at")).alias("tenure_days"),
        trend.alias("revenue_trend_ratio"), F.lit(FEATURE_SET).alias("feature_set_version"))


def scored_features(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Features with the score of the same customer and day."""
    return features.join(scores.withColumnRenamed("score_date", "feature_date"), ["customer", "feature_date"])


def full_view(all_of: DataFrame, addresses: DataFrame, as_of: dt.date, at: dt.datetime) -> DataFrame:
    """The unified view of each current customer, all columns, from combined rows of whole profiles and loyalty accounts; addresses may have several for each."""
    out = all_of.join(main_address(addresses), "customer", "left")
    c, day = F.col, F.lit(as_of)
    zero = lambda n, x=0: F.coalesce(c(n), F.lit(x))
    since = F.least(F.to_date("created_at"), F.coalesce("first_order_date", F.to_date("created_at")))
    revenue = zero("total_net_revenue", 0.0)
    known = [c("email").isNotNull(), F.coalesce(c("phone") != "", F.lit(False)), c("birth_date").isNotNull(), c("city").isNotNull(), c("segment").isNotNull(),
        c("_orders").isNotNull(), c("_loyalty").isNotNull(), c("_support").isNotNull()]
    came = [F.when(c(n).isNotNull(), f",{name}").otherwise("") for n, name in (("_orders", "OMS"), ("_support", "SUPPORT"), ("_loyalty", "LOYALTY"))]
    return out.select(
        "customer", "customer_sk", "master_customer_id", "full_name", "email", "phone", "birth_date", "segment", "preferred_channel", "marketing_opt_in", c("status").alias("customer_status"),
        since.alias("customer_since"), F.datediff(day, since).alias("tenure_days"), "city", "state", "country",
        zero("total_orders").alias("total_orders"), revenue.alias("total_net_revenue"), zero("avg_order_value", 0.0).alias("avg_order_value"),
            zero("order_frequency_per_year", 0.0).alias("order_frequency_per_year"), "last_order_date", "days_since_last_order",
        zero("revenue_last_365d", 0.0).alias("revenue_last_365d"), zero("return_rate", 0.0).alias("return_rate"), c("primary_channel").alias("primary_order_channel"),
        zero("total_cases").alias("total_cases"), zero("open_cases").alias("open_cases"), zero("cases_last_90d").alias("cases_last_90d"), "avg_csat", "avg_resolution_hours", "top_case_type",
        "loyalty_account", zero("tier", "NONE").alias("loyalty_tier"), zero("loyalty_status", "NOT_ENROLLED").alias("loyalty_status"),
            zero("points_balance").alias("loyalty_points_balance"), "loyalty_enrolled_at", F.datediff(day, c("last_activity_at")).alias("days_since_loyalty_activity"),
        zero("interactions_last_90d").alias("interactions_last_90d"), zero("negative_signals_90d").alias("negative_signals_90d"), zero("engagement_score", 0.0).alias("engagement_score"),
        F.round(revenue, 2).alias("customer_lifetime_value"), predicted_value().alias("predicted_clv_12m"),
        F.when(revenue >= 2000, "HIGH").when(revenue >= 500, "MEDIUM").otherwise("LOW").alias("value_tier"), "churn.band",
        F.round(100 * sum((k.cast("int") for k in known[1:]), known[0].cast("int")) / F.lit(len(known)), 2).alias("data_completeness_score"),
            F.concat(F.lit("CRM"), *came, F.lit(",ENGAGEMENT")).alias("contributing_sources"), F.lit(at).alias("as_of_timestamp"),
    )
