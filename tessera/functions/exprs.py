"""Column expressions that the operators share. They never fail on bad values: what can't be read is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as true and false in text.
TRUE, FALSE = ("true", "1", "y", "yes"), ("false", "0", "n", "no")
EMAIL_VALID = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"


def clean(c: Column) -> Column:
    return F.trim(c.cast("string"))


def lenient_bool(c: Column, unknown: bool | None = None) -> Column:
    """true/1/y/yes and false/0/n/no in any case; anything else is `unknown`."""
    low = F.lower(clean(c))
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).otherwise(F.lit(unknown).cast("boolean"))


def typed(c: Column, kind: str) -> Column:
    """Text as a type, NULL where it isn't one."""
    return c.cast("string").try_cast(kind)


def key(*parts: Column) -> Column:
    """MD5 of the parts, NULLs as empty strings."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def stamp(fails: dict[str, Column], warns: dict[str, Column]) -> tuple[Column, Column]:
    """dq_status (FAIL, WARN or PASS) and the ids of the rules that fired, in order, NULL if none; a rule whose condition is NULL doesn't fire."""
    fired = lambda rules: [F.coalesce(c, F.lit(False)) for c in rules.values()]
    any_of = lambda flags: F.lit(False) if not flags else F.greatest(*flags) if len(flags) > 1 else flags[0]
    status = F.when(any_of(fired(fails)), "FAIL").when(any_of(fired(warns)), "WARN").otherwise("PASS")
    ids = F.concat_ws(" ", *[F.when(c, F.lit(name)) for name, c in {**fails, **warns}.items()])
    return status, F.when(ids != "", ids)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key, for work that costs far more than they hold: a small file is a single split, and with a number given adaptive execution leaves small partitions apart."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def most_common(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """For each `by` the value that occurs most often, the least of those in a tie. Two aggregations, no sort of rows."""
    counted = df.groupBy(by, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b as double, NULL where b is 0."""
    return F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), digits)


def rounded(c: Column, digits: int) -> Column:
    """A double scaled, rounded half away from zero and scaled back, as SQL on binary doubles does it; F.round goes by the shortest decimal, so it takes 0.52065 (5206.499999999999 when scaled) up."""
    scale = F.lit(float(10**digits))
    return F.round(c * scale) / scale


def last_part(c: Column, by: str) -> Column:
    """What follows the last separator, all of it without one."""
    return F.split_part(c, F.lit(by), F.lit(-1))


def numbered(prefix: Column, n: Column, width: int = 3) -> Column:
    """A prefix and a number with leading zeros."""
    return F.concat_ws("-", prefix, F.lpad(n.cast("string"), width, "0"))


def minutes_between(a: Column, b: Column) -> Column:
    """Full minutes of the clock from a to b: seconds don't count."""
    minute = lambda c: F.unix_seconds(F.date_trunc("minute", c))
    return ((minute(b) - minute(a)) / 60).cast("long")


def finite(c: Column, digits: int = 4) -> tuple[Column, Column]:
    """A double rounded, NULL where it is NaN or infinite, and whether it is a whole number."""
    v = c.cast("double")
    ok = F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
    return F.round(ok, digits), ok == F.floor(ok)


def flattened(c: Column, fields: dict[str, str]) -> Column:
    """Rows of a JSON array of objects: a struct of the fields (by their names there) as text; an array that can't be read gives none."""
    element = "struct<" + ",".join(f"`{k}`:string" for k in fields) + ">"
    renamed = F.transform(F.from_json(c, f"array<{element}>"), lambda x: F.struct(*(x[k].alias(n) for k, n in fields.items())))
    return F.explode(renamed)


def money(c: Column) -> Column:
    return c.cast("decimal(18,2)")
