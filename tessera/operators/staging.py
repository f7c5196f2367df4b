"""From raw text to typed, stamped and deduplicated rows, by declarative specs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import EMAIL_VALID, clean, latest, lenient_bool, stamp, typed


@dataclass(frozen=True)
class Spec:
    """columns: name and expression over raw text; fails and warns: rule id and condition over those columns; key: what rows are deduplicated by; order: the first row stays."""

    columns: dict[str, Column]
    key: list[str]
    order: list[Column]
    fails: dict[str, Column] = field(default_factory=dict)
    warns: dict[str, Column] = field(default_factory=dict)
    derived: dict[str, Column] = field(default_factory=dict)


def stage(raw: DataFrame, spec: Spec) -> DataFrame:
    """Typed rows with dq_status and dq_failed_rules, the first of each key; rows without a key go before that."""
    df = raw.select(*(c.alias(n) for n, c in spec.columns.items()))
    for name, c in spec.derived.items():
        df = df.withColumn(name, c)
    status, rules = stamp(spec.fails, spec.warns)
    df = df.withColumns({"dq_status": status, "dq_failed_rules": rules})
    for k in spec.key:
        df = df.where(F.col(k).isNotNull())
    return latest(df, spec.key, *spec.order)


def _id(name: str) -> Column:
    """A business key: trimmed, NULL where nothing is left."""
    return F.nullif(clean(F.col(name)), F.lit(""))


def _upper(name: str) -> Column:
    return F.upper(clean(F.col(name)))


def _currency() -> Column:
    return F.upper(F.coalesce(F.col("currency").cast("string"), F.lit("USD")))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


#: Vocabularies.
ORDER_STATUS = ("COMPLETED", "SHIPPED", "CANCELLED", "RETURNED", "PENDING")
CURRENCIES = ("USD", "EUR", "GBP", "CAD")
CUSTOMER_STATUS = ("ACTIVE", "INACTIVE", "CLOSED")
TIERS = ("BRONZE", "SILVER", "GOLD", "PLATINUM")


def orders_spec(as_of) -> Spec:
    """Orders; net leaves out shipping."""
    c = F.col
    money = lambda n: typed(c(n), "decimal(18,2)")
    return Spec(
        {
            "order_id": _id("order_id"), "customer": _id("customer"), "order_date": typed(c("order_date"), "date"), "status": _upper("status"), "channel": _upper("channel"), "currency": _currency(),
            "amount": money("amount"), "discount": F.coalesce(money("discount"), F.lit(0)), "updated_at": typed(c("updated_at"), "timestamp"),
        },
        ["order_id"], [c("updated_at").desc_nulls_last(), c("amount").desc_nulls_last(), c("status")],
        {"DQ-O-002": c("amount").isNull() | (c("amount") < 0), "DQ-O-003": c("order_date").isNull() | (c("order_date") > F.lit(as_of))},
        {"DQ-O-004": ~c("status").isin(*ORDER_STATUS), "DQ-O-005": ~c("currency").isin(*CURRENCIES)},
        {"net": F.round(_zero("amount") - c("discount"), 2)},
    )


def items_spec() -> Spec:
    c = F.col
    return Spec(
        {
            "item_id": _id("item_id"), "order_id": clean(c("order_id")), "product": clean(c("product")), "sku": clean(c("sku")), "quantity": typed(c("quantity"), "decimal(12,0)"),
            "unit_price": typed(c("unit_price"), "decimal(18,2)"), "line_amount": typed(c("line_amount"), "decimal(18,2)"), "currency": _currency(),
        },
        ["item_id"], [c("order_id"), c("line_amount").desc_nulls_last(), c("product")],
        {"DQ-OI-001": c("quantity").isNull() | (c("quantity") <= 0)}, {"DQ-OI-002": F.abs(_zero("line_amount") - _zero("quantity") * _zero("unit_price")) > 0.01},
    )


def products_spec() -> Spec:
    """Products; what isn't surely active isn't active."""
    c = F.col
    return Spec(
        {"product": _id("product"), "sku": clean(c("sku")), "name": clean(c("name")), "category": clean(c("category")), "brand": clean(c("brand")),
            "unit_price": typed(c("unit_price"), "decimal(18,2)"), "is_active": lenient_bool(c("is_active"), False)},
        ["product"], [c("sku"), c("name")], {"DQ-P-001": c("unit_price").isNull()},
    )


def cases_spec() -> Spec:
    c = F.col
    return Spec(
        {
            "case_id": _id("case_id"), "customer": clean(c("customer")), "case_type": _upper("case_type"), "priority": _upper("priority"), "status": _upper("status"),
                "opened_at": typed(c("opened_at"), "timestamp"),
            "resolved_at": typed(c("resolved_at"), "timestamp"), "csat": typed(c("csat"), "int"), "reopens": F.coalesce(typed(c("reopens"), "int"), F.lit(0)),
        },
        ["case_id"], [c("opened_at").desc_nulls_last(), c("resolved_at").desc_nulls_last()], {"DQ-S-002": c("resolved_at") < c("opened_at")}, {"DQ-S-003": ~c("csat").between(1, 5)},
        {"resolution_hours": F.round(((F.unix_timestamp("resolved_at") - F.unix_timestamp("opened_at")) / F.lit(3600)).cast("double"), 2)},
    )


def interactions_spec() -> Spec:
    c = F.col
    return Spec(
        {"interaction_id": _id("interaction_id"), "customer": clean(c("customer")), "interaction_type": _upper("interaction_type"), "channel": _upper("channel"),
            "ts": typed(c("ts"), "timestamp"), "campaign": clean(c("campaign"))},
        ["interaction_id"], [c("ts").desc_nulls_last(), c("interaction_type")], {}, {"DQ-I-001": c("ts").isNull()},
    )


def loyalty_spec() -> Spec:
    c = F.col
    points = lambda n: typed(c(n), "decimal(18,0)")
    return Spec(
        {
            "account_id": _id("account_id"), "customer": clean(c("customer")), "tier": _upper("tier"), "balance": points("balance"), "earned": points("earned"), "redeemed": points("redeemed"),
            "enrolled_at": typed(c("enrolled_at"), "date"), "last_activity_at": typed(c("last_activity_at"), "date"), "status": _upper("status"),
        },
        ["account_id"], [c("last_activity_at").desc_nulls_last(), c("customer")], {}, {"DQ-L-001": ~c("tier").isin(*TIERS), "DQ-L-003": _zero("redeemed") > _zero("earned")},
    )


def addresses_spec() -> Spec:
    c = F.col
    return Spec(
        {
            "address_id": _id("address_id"), "customer": clean(c("customer")), "address_type": _upper("address_type"), "city": clean(c("city")), "state": _upper("state"),
                "postal_code": clean(c("postal_code")),
            "country": F.upper(F.coalesce(c("country").cast("string"), F.lit("US"))), "is_primary": lenient_bool(c("is_primary"), False), "valid_from": typed(c("valid_from"), "date"),
        },
        ["address_id"], [c("valid_from").desc_nulls_last(), c("city")], {}, {"DQ-A-001": F.coalesce(c("postal_code"), F.lit("")) == ""},
    )


def contacts_spec() -> Spec:
    """Contacts always pass."""
    c = F.col
    return Spec(
        {"contact_id": _id("contact_id"), "customer": clean(c("customer")), "contact_type": _upper("contact_type"), "contact_value": clean(c("contact_value")),
            "is_verified": lenient_bool(c("is_verified"), False), "is_primary": lenient_bool(c("is_primary"), False)},
        ["contact_id"], [c("contact_type"), c("contact_value")],
    )


#: What a change of makes a new version of a customer; the date of birth doesn't.
TRACKED = ("first_name", "last_name", "email", "phone", "segment", "status", "channel", "opt_in")


def stage_customers(raw: DataFrame, as_of) -> DataFrame:
    """Two-stage identity resolution: the latest row of each id, then of those that share an e-mail (or, without a valid one, name and birth date) the one created first."""
    c = F.col
    valid = F.coalesce(c("email").rlike(EMAIL_VALID), F.lit(False))
    spec = Spec(
        {
            "customer": _id("customer"), "first_name": clean(c("first_name")), "last_name": clean(c("last_name")), "email": F.lower(clean(c("email"))),
                "phone": F.regexp_replace(F.coalesce(c("phone").cast("string"), F.lit("")), "[^0-9+]", ""),
            "birth_date": typed(c("birth_date"), "date"), "segment": _upper("segment"), "opt_in": lenient_bool(c("opt_in")), "channel": _upper("channel"),
                "status": _upper("status"), "created_at": typed(c("created_at"), "timestamp"), "updated_at": typed(c("updated_at"), "timestamp"),
        },
        ["customer"], [c("updated_at").desc_nulls_last(), c("created_at").desc_nulls_last(), c("email")], {},
        {"DQ-C-002": ~valid, "DQ-C-003": (c("birth_date") > F.lit(as_of)) | (c("birth_date") < F.lit("1900-01-01").cast("date")), "DQ-C-004": ~c("status").isin(*CUSTOMER_STATUS)},
        {"full_name": F.trim(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit("")))), "email_is_valid": valid},
    )
    text = lambda n: F.coalesce(c(n).cast("string"), F.lit(""))
    name = F.lower(F.concat(text("first_name"), F.lit("|"), text("last_name"), F.lit("|"), text("birth_date")))
    staged = stage(raw, spec).withColumns({"match_key": F.md5(F.when(c("email_is_valid"), c("email")).otherwise(name)), "row_hash": F.md5(F.concat_ws("|", *map(text, TRACKED)))})
    return survivors(staged, "match_key", "created_at", "customer")


def survivors(df: DataFrame, match: str, created: str, key: str) -> DataFrame:
    """Of rows with one match key, the one created first (the least key in a tie)."""
    return latest(df, [match], F.col(created).asc_nulls_last(), F.col(key))
