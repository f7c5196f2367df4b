"""Invariants of a whole build over the driver's smallest tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import build, scd2, staging
from tessera.plans import mapping as M
from tessera.plans import pipeline as L
from tessera.plans import warehouse as W
from tessera.sources.store import Store

CORE_KEYS = {"core_order": "order_id", "core_item": "item_id", "core_product": "product", "core_case": "case_id", "core_interaction": "interaction_id", "core_loyalty": "account_id", "core_address": "address_id", "core_contact": "contact_id"}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    made = Store(spark, str(tmp_path_factory.mktemp("warehouse")))
    build.run(made, L.steps(spark, "/root/testdata/sf0.001"), "first")
    return made


def none(df):
    assert df.limit(5).collect() == []


def test_the_view_covers_every_current_customer(store):
    current = store.read("core_customer").where("is_current").select("customer")
    whole = store.read("customer_360")
    none(current.join(whole, "customer", "left_anti"))
    none(whole.join(current, "customer", "left_anti"))
    none(whole.groupBy("customer").count().where("count > 1"))
    assert whole.where("loyalty_status = 'NOT_ENROLLED' AND loyalty_account IS NULL AND loyalty_points_balance = 0").count() > 0  # customers without an account are there
    none(whole.where("total_orders = 0 AND (total_net_revenue <> 0 OR last_order_date IS NOT NULL)"))


def test_history_is_sound(store):
    dim = store.read("core_customer")
    scd2.check(dim, "customer")
    none(dim.where(F.col("is_current") & (F.col("valid_to") < F.lit("9999-12-31").cast("timestamp"))))
    none(dim.groupBy("customer_sk").count().where("count > 1"))
    none(dim.where("row_hash IS NULL"))


def test_what_is_not_tracked_makes_no_version(spark):
    raw = L.raw(spark, "/root/testdata/sf0.001", "raw_customer").where("customer IS NOT NULL")
    before = staging.stage_customers(raw, M.AS_OF).select("customer", "row_hash")
    hash_of = lambda df: {r.customer: r.row_hash for r in df.select("customer", "row_hash").collect()}
    assert "birth_date" not in staging.TRACKED
    # the name key uses the date of birth, so only customers with a valid address are compared
    with_mail = raw.where("email LIKE '%@example.com'")
    same = hash_of(staging.stage_customers(with_mail.withColumn("birth_date", F.lit("1980-05-05")), M.AS_OF))
    first = hash_of(staging.stage_customers(with_mail, M.AS_OF))
    assert first == same and len(first) > 50
    moved = hash_of(staging.stage_customers(with_mail.withColumn("segment", F.lit("other")), M.AS_OF))
    assert not {k for k in first if first[k] == moved[k]} and before.count() > len(first) - 1


def test_replays_and_duplicates_are_one_row(spark, store):
    staged = store.read("stg_customer")
    none(staged.groupBy("customer").count().where("count > 1"))
    none(staged.groupBy("match_key").count().where("count > 1"))
    raw = L.raw(spark, "/root/testdata/sf0.001", "raw_customer")
    assert raw.where("trim(customer) = '10'").count() == 2  # sent twice
    # an address that another customer had first, in capitals and with a blank
    assert raw.where("trim(customer) = '53'").count() == 1 and staged.where("customer = '53'").count() == 0 and staged.where("customer = '52'").count() == 1
    for name, key in CORE_KEYS.items():
        none(store.read(name).groupBy(key).count().where("count > 1"))
        none(store.read(name).where(f"{key} IS NULL OR trim({key}) = '' OR sk <> md5({key})"))


def test_only_recognised_orders_make_revenue(store):
    orders = store.read("core_order")
    again = orders.where("is_revenue_recognised").groupBy("customer").agg(F.sum("net").cast("double").alias("again"))
    summary = store.read("order_summary")
    none(summary.join(again, "customer", "left").where("abs(total_net_revenue - coalesce(again, 0)) > 0.01"))
    assert orders.where("NOT is_revenue_recognised").count() > 0
    whole = store.read("customer_360")
    none(whole.join(summary.select("customer", F.col("total_net_revenue").alias("r")), "customer").where("abs(total_net_revenue - r) > 0.01"))
    none(whole.where("abs(customer_lifetime_value - total_net_revenue) > 0.01"))  # realised, not predicted
    assert whole.where("predicted_clv_12m <> customer_lifetime_value").count() > 0


def test_orphans_and_failures_stay_out_of_core(store):
    items, orders = store.read("core_item"), store.read("core_order")
    none(items.join(orders, "order_id", "left_anti"))
    assert store.read("stg_item").where("dq_status <> 'FAIL'").join(orders, "order_id", "left_anti").count() > 0  # there were some
    none(orders.where(F.col("amount").isNull() | (F.col("amount") < 0) | (F.col("order_date") > F.lit(M.AS_OF))))
    none(items.where("quantity IS NULL OR quantity <= 0"))
    none(store.read("core_case").where("resolved_at < opened_at"))
    for name, key in CORE_KEYS.items():
        staged = store.read(name.replace("core_", "stg_"))
        failed, warned = staged.where("dq_status = 'FAIL'"), staged.where("dq_status = 'WARN'")
        none(failed.join(store.read(name), key, "left_semi"))
        if name != "core_item":
            none(warned.join(store.read(name), key, "left_anti"))  # rows with warnings do load
    assert store.read("core_customer").where("NOT email_is_valid").count() > 0


def test_orders_bear_the_version_of_their_day(store):
    joined = store.read("core_order").join(store.read("core_customer").select("customer_sk", "valid_from", "valid_to"), "customer_sk", "left")
    none(joined.where("customer_sk IS NOT NULL AND NOT (cast(order_date AS timestamp) >= valid_from AND cast(order_date AS timestamp) < valid_to)"))
    assert joined.where("customer_sk IS NULL").count() > 0 and joined.where("customer_sk IS NOT NULL").count() > 0


def test_scores_are_probabilities_and_bands_follow_them(store):
    score = store.read("churn_score")
    none(score.where("probability < 0.01 OR probability > 0.99 OR band IS NULL OR top_driver IS NULL"))
    least = {r.band: r.p for r in score.groupBy("band").agg(F.min("probability").alias("p")).collect()}
    assert all(least[b] >= x for b, x in (("CRITICAL", 0.7), ("HIGH", 0.5), ("MEDIUM", 0.3)) if b in least)
    features = store.read("features")
    assert features.count() == score.count() == store.read("customer_360").count()
    none(features.where("recency_days IS NULL OR avg_csat IS NULL OR order_trend_ratio IS NULL"))


def test_a_rebuild_makes_the_same(spark, store):
    """The same input gives the same keys and rows, whatever the run; readers of the first version keep it."""
    old = store.read("customer_360")
    build.run(store, L.steps(spark, "/root/testdata/sf0.001"), "second")
    new = store.read("customer_360")
    assert store.head().version == 2 and old.exceptAll(new).count() == new.exceptAll(old).count() == 0
    assert store.read("core_order").select("sk", "customer_sk").exceptAll(store.read("core_order", 1).select("sk", "customer_sk")).count() == 0


def test_rules_are_data(spark):
    assert len({r.rule_id for r in W.RULES}) == len(W.RULES) == 22
    assert all(r.owner and r.dimension and r.severity and r.name and bool(r.where) != bool(r.failed) for r in W.RULES)
    assert {r.dimension for r in W.RULES} == {"COMPLETENESS", "VALIDITY", "CONSISTENCY", "UNIQUENESS", "ACCURACY", "TIMELINESS"}
    assert 0 < sum(r.severity == "BLOCKING" for r in W.RULES) <= len(W.RULES) // 2


def test_rejects_have_reasons(spark, small):
    rejected = W.quarantine_rules(spark, small)
    none(rejected.where("reason IS NULL OR trim(reason) = '' OR record_key IS NULL OR reject_id IS NULL"))
    assert {r.rule_id for r in rejected.select("rule_id").distinct().collect()} == {"DQ-C-001", "DQ-C-005", "DQ-O-002", "DQ-O-003"}


def test_new_facts_show_up_in_the_next_build_only(spark, store):
    """A reader that holds a version doesn't see a half-done build, even when it stops."""
    steps = L.steps(spark, "/root/testdata/sf0.001")
    version, n = store.head().version, store.read("customer_360").count()
    stops = [build.Step(x.name, (lambda *t: (_ for _ in ()).throw(RuntimeError("stop"))) if x.name == "features" else x.make, x.needs) for x in steps]
    with pytest.raises(build.BuildError):
        build.run(store, stops, f"half {dt.date.today()}")
    assert store.head().version == version and store.read("customer_360").count() == n
