"""The catalogue of data-quality rules."""

from __future__ import annotations

from tessera.operators.quality import Rule

_CUSTOMER, _ORDER, _PRODUCT, _SERVICE, _LOYALTY, _PLATFORM, _AI = (f"{x} Owner" for x in ("Customer Data Domain", "Order Data Domain", "Product Data Domain",
    "Service Data Domain", "Loyalty Data Domain", "Data Platform", "AI Platform"))


def rules(today: str, now: str) -> list[Rule]:
    """All rules as of a day and a time (SQL literals). Tables: raw_customer, stg_customer, raw_order, stg_order, core_order, stg_order_item, stg_product, stg_case, stg_loyalty, core_customer, customer_360, features, churn_score."""
    #: Id, severity, threshold in percent, table, name, dimension, column, owner, and what fails: a row's condition or a count.
    return [
        Rule("DQ-C-001", "BLOCKING", 0.0, "raw_customer", name="Customer business key must be present", dimension="COMPLETENESS", column="customer_id", owner=_CUSTOMER,
            where="customer_id IS NULL OR trim(customer_id) = ''"),
        Rule("DQ-C-002", "WARNING", 2.0, "stg_customer", name="Customer e-mail must be syntactically valid", dimension="VALIDITY", column="email", owner=_CUSTOMER, where="email_is_valid = false"),
        Rule("DQ-C-003", "WARNING", 1.0, "stg_customer", name="Date of birth must be plausible", dimension="VALIDITY", column="birth_date", owner=_CUSTOMER,
            where=f"birth_date > {today} OR birth_date < DATE '1900-01-01'"),
        Rule("DQ-C-004", "WARNING", 0.5, "stg_customer", name="Customer status must be from the controlled vocabulary", dimension="CONSISTENCY", column="status",
            owner=_CUSTOMER, where="status NOT IN ('ACTIVE','INACTIVE','CLOSED')"),
        Rule("DQ-C-005", "WARNING", 1.0, "raw_customer", name="No duplicate customers by match key", dimension="UNIQUENESS", column="email", owner=_CUSTOMER,
            failed="SELECT count(*) FROM (SELECT lower(trim(email)) AS e FROM raw_customer WHERE email IS NOT NULL GROUP BY 1 HAVING count(DISTINCT customer_id) > 1) d"),
        Rule("DQ-O-001", "BLOCKING", 0.0, "raw_order", name="Order business key must be present", dimension="COMPLETENESS", column="order_id", owner=_ORDER, where="order_id IS NULL"),
        Rule("DQ-O-002", "BLOCKING", 0.0, "stg_order", name="Order amount must be non-negative", dimension="VALIDITY", column="amount", owner=_ORDER, where="amount IS NULL OR amount < 0"),
        Rule("DQ-O-003", "BLOCKING", 0.0, "stg_order", name="Order date must not be in the future", dimension="VALIDITY", column="order_date", owner=_ORDER,
            where=f"order_date IS NULL OR order_date > {today}"),
        Rule("DQ-O-006", "WARNING", 0.0, "core_order", name="Every order must reference a known customer", dimension="CONSISTENCY", column="customer", owner=_ORDER,
            failed="SELECT count(*) FROM core_order o WHERE o.customer IS NOT NULL AND NOT EXISTS (SELECT 1 FROM core_customer c WHERE c.customer = o.customer)"),
        Rule("DQ-OI-002", "WARNING", 1.0, "stg_order_item", name="Order line amount must equal quantity x unit price", dimension="ACCURACY", column="line_amount",
            owner=_ORDER, where="abs(coalesce(line_amount, 0) - coalesce(quantity, 0) * coalesce(unit_price, 0)) > 0.01"),
        Rule("DQ-OI-003", "WARNING", 0.0, "stg_order_item", name="Every order line must reference a known product", dimension="CONSISTENCY", column="product",
            owner=_PRODUCT, failed="SELECT count(*) FROM stg_order_item i WHERE i.product IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stg_product p WHERE "
            "p.product = i.product)"),
        Rule("DQ-S-002", "BLOCKING", 0.0, "stg_case", name="Support case cannot be resolved before it was opened", dimension="VALIDITY", column="resolved_at",
            owner=_SERVICE, where="resolved_at IS NOT NULL AND opened_at IS NOT NULL AND resolved_at < opened_at"),
        Rule("DQ-S-003", "WARNING", 0.5, "stg_case", name="CSAT score must be between 1 and 5", dimension="VALIDITY", column="csat", owner=_SERVICE,
            where="csat IS NOT NULL AND (csat < 1 OR csat > 5)"),
        Rule("DQ-L-003", "WARNING", 1.0, "stg_loyalty", name="Redeemed points cannot exceed points ever earned", dimension="CONSISTENCY", column="redeemed",
            owner=_LOYALTY, where="coalesce(redeemed, 0) > coalesce(earned, 0)"),
        Rule("DQ-X-001", "BLOCKING", 0.0, "customer_360", name="Customer 360 must cover every current customer", dimension="COMPLETENESS", column="customer",
            owner=_PLATFORM, failed="SELECT count(*) FROM core_customer c WHERE c.is_current = true AND NOT EXISTS (SELECT 1 FROM customer_360 x WHERE "
            "x.customer = c.customer)"),
        Rule("DQ-X-002", "BLOCKING", 0.0, "core_customer", name="Exactly one current version per customer", dimension="UNIQUENESS", column="is_current", owner=_PLATFORM,
            failed="SELECT count(*) FROM (SELECT customer FROM core_customer WHERE is_current = true GROUP BY customer HAVING count(*) > 1) d"),
        Rule("DQ-X-003", "BLOCKING", 0.0, "core_customer", name="SCD2 validity windows must not overlap", dimension="CONSISTENCY", column="valid_from", owner=_PLATFORM,
            failed="SELECT count(*) FROM core_customer a JOIN core_customer b ON a.customer = b.customer AND a.customer_sk <> b.customer_sk AND a.valid_from < b.valid_to "
            "AND b.valid_from < a.valid_to"),
        Rule("DQ-X-004", "INFO", 5.0, "customer_360", name="Revenue outliers for review", dimension="ACCURACY", column="total_net_revenue", owner=_PLATFORM,
            failed="SELECT count(*) FROM customer_360 WHERE total_net_revenue > (SELECT avg(total_net_revenue) + 3 * stddev(total_net_revenue) FROM customer_360)"),
        Rule("DQ-X-005", "WARNING", 0.0, "churn_score", name="Churn score must exist for every scored customer", dimension="COMPLETENESS", column="probability",
            owner=_AI, failed=f"SELECT count(*) FROM features f WHERE f.feature_date = {today} AND NOT EXISTS (SELECT 1 FROM churn_score s WHERE s.customer = f.customer "
            f"AND s.score_date = f.feature_date)"),
        Rule("DQ-X-006", "BLOCKING", 0.0, "churn_score", name="Churn probability must be a probability", dimension="VALIDITY", column="probability", owner=_AI,
            where="probability < 0 OR probability > 1"),
        Rule("DQ-X-007", "BLOCKING", 0.0, "customer_360", name="Customer 360 must be no more than 24 hours old", dimension="TIMELINESS", column="as_of_timestamp",
            owner=_PLATFORM, where=f"as_of_timestamp < {now} - INTERVAL '24' HOUR"),
        Rule("DQ-X-008", "WARNING", 0.0, "churn_score", name="Churn scores must be refreshed daily", dimension="TIMELINESS", column="score_date", owner=_AI, where=f"score_date < {today}"),
    ]
