"""Records of source systems under canonical names and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import money


def expanded(code: Column, meanings: dict[str, str], other: str | None = None) -> Column:
    """A code as what it means, `other` where it is unknown."""
    out = F.lit(other)
    for k, v in meanings.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def customers(raw: DataFrame, codes: dict[str, tuple[str, dict[str, str], str | None]], dates: dict[str, str], flags: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """Customers of a system that writes codes, dates as day/month/year and flags as Y and N: codes (name -> column, meanings, meaning of others), dates and flags (name -> column); a date that can't be read is NULL, a flag that isn't Y false."""
    made = {n: expanded(F.col(c), meanings, other) for n, (c, meanings, other) in codes.items()}
    made |= {n: F.try_to_timestamp(F.col(c), F.lit("dd/MM/yyyy")).cast("date") for n, c in dates.items()}
    made |= {n: F.coalesce(F.upper(F.trim(F.col(c))) == "Y", F.lit(False)) for n, c in flags.items()}
    return raw.select(*keep, *(c.alias(n) for n, c in made.items()))


def orders(raw: DataFrame) -> DataFrame:
    """Orders (order_id, order_date, status, channel, amount, discount) with gross, discount and net amounts; a missing discount is 0, the net amount is the rest, to the cent."""
    amount, discount = money(F.col("amount")), F.coalesce(money(F.col("discount")), F.lit(0))
    return raw.select(
        "order_id", F.to_date("order_date").alias("order_date"), "status", "channel", amount.cast("double").alias("gross_amount"),
            discount.cast("double").alias("discount_amount"), F.round(amount - discount, 2).cast("double").alias("net_amount")
    )
