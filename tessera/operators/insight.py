"""Rule-based insight text, sentiment and the dictionary of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the name of a column says about its content.
PII_HINTS = {"DIRECT": ("email", "phone", "name", "birth", "address"), "INDIRECT": ("customer", "postal", "city", "nation", "user"), "FREE_TEXT": ("text", "description", "note", "comment")}


def sentiment(csat: Column) -> tuple[Column, Column]:
    """Score (csat - 3) / 2 and its label, with a cut at 0.2 on either side; neutral where there is none."""
    score = F.round((csat - 3) / F.lit(2.0), 4)
    return score, F.when(score > 0.2, "POSITIVE").when(score < -0.2, "NEGATIVE").otherwise("NEUTRAL")


def summary(whole: DataFrame) -> DataFrame:
    """A sentence or two for each customer from facts that are there."""
    number = lambda c: F.col(c).cast("string")
    orders = F.when(F.col("total_orders") > 0, F.concat(F.lit("They have placed "), number("total_orders"), F.lit(" orders."))).otherwise("They have no recorded purchase history.")
    cases = F.when(F.col("open_cases") > 0, F.concat(F.lit(" "), number("open_cases"), F.lit(" support cases are open.")))
    risk = F.when(F.col("band").isNotNull(), F.concat(F.lit(" Churn risk is "), F.col("band"), F.lit(".")))
    return whole.select("customer", F.concat(F.lit("The customer is in the "), F.col("segment"), F.lit(" segment. "), orders, F.coalesce(cases, F.lit("")),
        F.coalesce(risk, F.lit(""))).alias("summary"))


#: What each driver of churn reads like, with the column it quotes and what stands there without one.
REASONS = {
    "PURCHASE_RECENCY": ("they have not ordered for {} days", "days_since_last_order", "they have no recent purchase activity"),
    "DECLINING_ORDER_TREND": ("their recent order rate has fallen (trend ratio {})", "order_trend_ratio", "their recent order rate has fallen"),
    "SUPPORT_CASE_VOLUME": ("they have raised {} support cases in the last 90 days", "cases_last_90d", None),
    "LOW_SATISFACTION": ("their average satisfaction score is {}", "avg_csat", None),
    "LOW_ENGAGEMENT": ("their engagement score is {} out of 100", "engagement_score", None),
    "LOYALTY_INACTIVITY": ("their loyalty account has been inactive", None, None),
    "NEGATIVE_SIGNALS": ("they generated {} negative engagement signals in the last 90 days", "negative_signals_90d", None),
}
UNKNOWN = "n/a"


def churn_explanation(rows: DataFrame, drivers: str = "drivers") -> DataFrame:
    """customer and explanation: why a customer may leave, in a sentence, from band, probability, an array of driver names (the main ones, in order) and the columns that REASONS quotes; numbers are quoted as text has them."""

    def reason(d: Column) -> Column:
        out = F.lower(F.replace(d, F.lit("_"), F.lit(" ")))
        for name, (form, column, without) in REASONS.items():
            said = F.lit(form)
            if column:
                before, after = form.split("{}")
                value = F.col(column).cast("string")
                said = F.concat(F.lit(before), F.coalesce(value, F.lit(UNKNOWN)), F.lit(after))
                said = F.when(value.isNull(), without).otherwise(said) if without else said
            out = F.when(d == name, said).otherwise(out)
        return out

    some = F.filter(drivers, lambda d: d.isNotNull() & (d != ""))
    head = F.concat(F.lit("Churn risk is "), F.coalesce("band", F.lit("unclassified")), F.lit(" with a probability of "),
        F.coalesce(F.col("probability").cast("string"), F.lit(UNKNOWN)), F.lit(". The main reasons are that "))
    text = F.concat(head, F.array_join(F.transform(some, reason), "; "), F.lit("."))
    return rows.select("customer", F.when(F.size(some) > 0, text).otherwise("No churn drivers were supplied, so no explanation can be given.").alias("explanation"))


def rendered_facts(facts: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """Facts as a flat list of labelled values, a line each, so that nothing is there to paraphrase: - key: value, NOT AVAILABLE where there is none, and a line for each item of a list (NULL lists aren't available, either)."""
    line = lambda k, v: F.concat(F.lit(f"- {k}: "), F.coalesce(F.nullif(v.cast("string"), F.lit("")), F.lit("NOT AVAILABLE")))
    items = lambda v: F.array_join(F.transform(v, lambda x: F.concat(F.lit("\n    * "), x.cast("string"))), "")
    lines = [line(k, v) for k, v in facts.items()]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"- {k}:"), items(v))).otherwise(F.lit(f"- {k}: NOT AVAILABLE")) for k, v in (lists or {}).items()]
    return F.concat_ws("\n", *lines)


#: What text looks like by kind of content, and the share of a column's values that must look so.
LOOKS = {"EMAIL": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "PHONE": r"^\+?[0-9][0-9() -]{6,}$", "NUMBER": r"^-?[0-9]+(\.[0-9]+)?$", "URL": r"^https?://", "JSON": r"^[\[{].*[\]}]$"}
SURE, WORDY = 0.8, 5.0


def described(df: DataFrame, name: str) -> DataFrame:
    """A row for each column of a table: rows, share of nulls, distinct values, and the kind of content that its values (not its name) suggest: a look that most of them
    have, FREE_TEXT where they have many blanks, TEXT otherwise; other types by type.

    The columns are unpivoted into hashes, counted once by value and then by column: one scan and one pre-aggregated shuffle for any number of columns. Arrays count as
    whole values; distinct values are told apart by 64-bit hashes of their text."""
    kind = {f.name: f.dataType.typeName() for f in df.schema}
    text = [c for c, t in kind.items() if t == "string"]

    def entry(c: str) -> Column:
        v = F.col(f"`{c}`")
        looks = [F.coalesce(v.rlike(p), F.lit(False)).cast("int").alias(k) for k, p in LOOKS.items()] if c in text else [F.lit(0).alias(k) for k in LOOKS]
        blanks = F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit(""))) if c in text else F.lit(0)
        return F.struct(F.lit(c).alias("column"), F.when(v.isNotNull(), F.xxhash64(v)).alias("hash"), *looks, F.coalesce(blanks, F.lit(0)).alias("blanks"))

    long = df.select(F.explode(F.array(*map(entry, df.columns))).alias("e")).select("e.*")
    by_value = long.groupBy("column", "hash").agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in LOOKS), F.sum("blanks").alias("blanks"))
    there = F.sum(F.when(F.col("hash").isNotNull(), F.col("n")).otherwise(0))
    out = by_value.groupBy("column").agg(F.sum("n").alias("n_rows"), there.alias("n_there"), F.count("hash").alias("n_distinct"), *(F.sum(k).alias(k) for k in LOOKS), F.sum("blanks").alias("blanks"))
    content = F.when(F.col("blanks") >= WORDY * F.col("n_there"), "FREE_TEXT").otherwise("TEXT")
    for k in reversed(LOOKS):
        content = F.when(F.col(k) >= SURE * F.col("n_there"), k).otherwise(content)
    content = F.when(F.col("n_there") == 0, "EMPTY").otherwise(content)
    types = F.create_map(*(F.lit(x) for c, t in kind.items() for x in (c, t)))
    by_type = F.when(types[F.col("column")] == "string", content).when(types[F.col("column")].isin("timestamp", "timestamp_ntz", "date"),
        "TIME").when(types[F.col("column")] == "boolean", "FLAG").when(types[F.col("column")] == "array", "VECTOR").otherwise("NUMBER")
    return out.select(F.lit(name).alias("table_name"), F.col("column").alias("column_name"), "n_rows",
        F.round(1 - F.col("n_there") / F.greatest("n_rows", F.lit(1)), 6).alias("null_share"), "n_distinct", by_type.alias("content"))


def classified(columns: DataFrame) -> DataFrame:
    """Columns (table_name, column_name) with the class of personal data that their name suggests."""
    low, out = F.lower("column_name"), F.lit("NONE")
    for kind, hints in reversed(PII_HINTS.items()):
        hit = low.contains(hints[0])
        for h in hints[1:]:
            hit = hit | low.contains(h)
        out = F.when(hit, kind).otherwise(out)
    return columns.withColumn("pii_class", out)


def coverage(columns: DataFrame, described: DataFrame) -> DataFrame:
    """Share of each table's columns that the dictionary describes."""
    both = columns.join(described.select("table_name", "column_name").withColumn("_d", F.lit(1)), ["table_name", "column_name"], "left")
    return both.groupBy("table_name").agg(F.count("*").alias("columns"), F.count("_d").alias("described"), F.round(100.0 * F.count("_d") / F.count("*"), 2).cast("double").alias("coverage_pct"))


def trace(audit: DataFrame, insights: DataFrame, correlation: str) -> DataFrame:
    """Requests of a correlation id with what they produced."""
    return audit.where(F.col("correlation_id") == correlation).join(insights, "correlation_id", "left")
