"""Who may see what: masking, pseudonyms, row access, consent, subject requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask_email(c: Column, roles: set[str], allowed: frozenset[str] = frozenset({"PII_READER"})) -> Column:
    """Warehouse policy: x****@domain, *** where there is no domain."""
    if roles & allowed:
        return c
    at = F.locate("@", c)
    return F.when(c.isNull(), None).when(at > 1, F.concat(F.left(c, F.lit(1)), F.lit("****@"), F.split_part(c, F.lit("@"), F.lit(2)))).otherwise("***")


def mask_phone(c: Column, roles: set[str], allowed: frozenset[str] = frozenset({"PII_READER"})) -> Column:
    if roles & allowed:
        return c
    return F.when(c.isNull(), None).when(F.length(c) >= 4, F.concat(F.lit("***-***-"), F.right(c, F.lit(4)))).otherwise("***")


def mask_name(c: Column, roles: set[str], allowed: frozenset[str] = frozenset({"PII_READER"})) -> Column:
    return c if roles & allowed else F.concat(F.left(c, F.lit(1)), F.lit("."))


def mask_date(c: Column, roles: set[str], allowed: frozenset[str] = frozenset({"PII_READER"})) -> Column:
    return c if roles & allowed else F.trunc(c, "YEAR")


def mask_text(c: Column, roles: set[str], allowed: frozenset[str] = frozenset({"PII_READER"})) -> Column:
    return c if roles & allowed else F.concat(F.lit("[REDACTED: "), F.length(c).cast("string"), F.lit(" characters]"))


def api_email(c: Column) -> Column:
    """API variant: the first character and stars for the rest of the local part, three at least."""
    local = F.split_part(c, F.lit("@"), F.lit(1))
    return F.when(c.contains("@"), F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(local) - 1, F.lit(3))), F.lit("@"),
        F.split_part(c, F.lit("@"), F.lit(2)))).otherwise(F.lit(None))


def api_birth(c: Column) -> Column:
    return F.concat(F.date_format(c, "yyyy"), F.lit("-**-**"))


def api_phone(c: Column) -> Column:
    """Stars and the last four digits; only stars if there are fewer; empty and null stay."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(c.isNull() | (c == ""), c).when(F.length(digits) >= 4, F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))).otherwise("***")


def api_name(c: Column) -> Column:
    """The first letter and stars for the rest, two at least."""
    return F.when(c.isNull() | (c == ""), c).otherwise(F.concat(F.left(c, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(c) - 1, F.lit(2)))))


def api_full_name(c: Column) -> Column:
    """The first name as it is, the others masked."""
    parts = F.filter(F.split(c, r"\s+"), lambda p: p != "")
    return F.when(c.isNull() | (F.size(parts) == 0), c).otherwise(F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(F.slice(parts, F.lit(2),
        F.greatest(F.size(parts) - 1, F.lit(0))), api_name)), " "))


#: How the API masks each field of a profile.
API_MASKS = {"email": api_email, "phone": api_phone, "birth_date": lambda c: api_birth(c), "full_name": api_full_name, "first_name": api_name, "last_name": api_name}


def api_profile(df: DataFrame, allowed: bool) -> DataFrame:
    """Profiles as a caller may see them: as they are, or with the fields that they have masked and these named; a field that isn't there isn't invented."""
    if allowed:
        return df
    there = [c for c in df.columns if c in API_MASKS]
    return df.withColumns({c: API_MASKS[c](F.col(c)) for c in there} | {"masked": F.lit(True), "masked_fields": F.array(*map(F.lit, sorted(there))).cast("array<string>")})


def pseudonym(c: Column, prefix: str, salt: str) -> Column:
    """PREFIX_ and the first 12 hexadecimal digits of a salted SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), c.cast("string")), 256), 1, 12)))


def row_access(df: DataFrame, region: str, entitlement: DataFrame, roles: set[str]) -> DataFrame:
    """Rows of the regions that any of the roles is entitled to ('*' for all); none without an entitlement. The entitlements of a session are few."""
    mine = entitlement.where(F.col("role").isin(*sorted(roles))).select(F.col("region").alias("_r")).distinct()
    return df.join(F.broadcast(mine), (F.col("_r") == "*") | (F.col("_r") == F.col(region)), "left_semi")


def consented(df: DataFrame, opt_in: str) -> DataFrame:
    """Rows with consent; an unknown one is none."""
    return df.where(F.coalesce(F.col(opt_in), F.lit(False)))


def subject_extract(key: str, value, tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of a subject in all tables, a line each: the table and the row as JSON with its columns in order. However many rows a subject has, none are put together in one task; write the lines partitioned by table_name for a file of each."""
    parts = [df.where(F.col(key) == value).select(F.lit(n).alias("table_name"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("row")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def erase(key: str, subjects: DataFrame, profiles: DataFrame, transactions: DataFrame, prefix: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """Profiles without the subjects, and transactions with their keys as pseudonyms."""
    gone = subjects.select(key).distinct()
    marked = transactions.join(gone.withColumn("_gone", F.lit(True)), key, "left")
    return profiles.join(gone, key, "left_anti"), marked.withColumn(key, F.when(F.col("_gone"), pseudonym(F.col(key), prefix, salt)).otherwise(F.col(key).cast("string"))).drop("_gone")
