"""Objects in text, objects from pairs, parts of arrays, and ids made from names; column expressions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole string in double quotes with its escapes, a brace, what is neither, or a quote that is never closed. Possessive, so that long texts need no stack.
_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}]|[^"{}]++|"'


def first_object(c: Column) -> Column:
    """The first balanced {...} of a text, from its first brace on; braces within quoted strings don't count. NULL where there is none or it never closes.

    Its strings and braces are walked through one after another, with the depth and the number of characters so far."""
    rest = F.substring(c, F.instr(c, "{"), F.length(c))
    tokens = F.when(F.instr(c, "{") > 0, F.regexp_extract_all(rest, F.lit(_TOKEN), F.lit(0)))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        at = acc["at"] + F.length(t)
        open_ = (acc["end"] == 0) & (t != '"')
        return F.struct(
            F.when(open_, depth).otherwise(acc["depth"]).cast("int").alias("depth"), F.when(open_, at).otherwise(acc["at"]).cast("int").alias("at"),
            F.when(acc["end"] != 0, acc["end"]).when(t == '"', -1).when(depth == 0, at).otherwise(0).cast("int").alias("end"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    end = F.aggregate(tokens, start, step)["end"]
    return F.when(end > 0, F.substring(rest, F.lit(1), end))


def closed_choice(text: Column, key: str, allowed: list[str], instead: str) -> Column:
    """A struct of what an answer in text chose: choice (the value of key in its first object if that is allowed, else `instead`), suppressed (a value that wasn't allowed) and object (as JSON); NULL where no object can be read."""
    found = first_object(text)
    read = F.try_parse_json(found)
    value = F.try_variant_get(read, f"$.{key}", "string")
    ok = F.coalesce(value.isin(*allowed), F.lit(False))
    return F.when(read.isNotNull(), F.struct(F.when(ok, value).otherwise(F.lit(instead)).alias("choice"), F.when(~ok, value).alias("suppressed"), found.alias("object")))


def object_of(pairs: Column) -> Column:
    """A map of pairs (structs of key and value) in their order; of a key that comes again the last value stays, at the key's first place. Pairs without a key are left out; NULL stays NULL."""
    some = F.filter(pairs, lambda p: p["key"].isNotNull())
    keys = F.array_distinct(F.transform(some, lambda p: p["key"]))
    values = F.transform(keys, lambda k: F.element_at(F.filter(some, lambda p: p["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, values)


def part(c: Column, start: int | None = None, stop: int | None = None) -> Column:
    """The elements from start up to stop; negative places count from the end, those outside are cut to the array."""
    n = F.size(c)

    def place(k: int | None, default: Column) -> Column:
        return default if k is None else F.greatest(F.lit(0), n + k) if k < 0 else F.least(n, F.lit(k))

    a, b = place(start, F.lit(0)), place(stop, n)
    return F.when(c.isNotNull(), F.slice(c, a + 1, F.greatest(F.lit(0), b - a)))


def named_uuid(namespace: uuid.UUID, name: Column) -> Column:
    """The version-5 UUID of a name: SHA-1 of the namespace's bytes and the name's, so a retry makes the same id. NULL stays NULL."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name.cast("string"), "UTF-8")))
    at = lambda a, n: F.substring(h, a, n)
    variant = F.translate(at(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))
