"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidate spans come from patterns. Labelers vote on each: a regular-expression labeler (strict shape or checksum), a gazetteer labeler (known
domains, prefixes, issuers) and two context labelers (cue words before it; what touches it). Expectation maximisation over the counts of vote patterns estimates how reliable
each labeler is for each kind, and its posteriors train a logistic classifier of spans on shape and context. Only counts by pattern
reach the driver: their number is bounded by votes, features and kinds, whatever the corpus. Spans that match a base rule stay whatever
the classifier says; others are added where it says so.

Cases: null texts are empty and have no spans; a document without candidates has empty strings of spans; spans of one kind never overlap (a base span keeps its place, and a
base pattern's match that fails its rule is no span), those of different kinds may; repeated rows are scanned each; other columns are ignored; an empty table gives no
rows. All texts are read whole; positions are found by sums in blocks,
so a text with very many matches takes time in proportion to them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, table

#: The base rules, with possessive repeats and anchored starts, which find the same matches without backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond them.
SECRET = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}+"
LOCAL = r"(?<![0-9A-Za-z+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"

DIGITS = "text rlike '[0-9]'"
#: kind, pattern, whether a row can have a match (cheap), order in the result.
KINDS = [
    ("email", EMAIL, "contains(text, '@')", 0, True),
    ("ip", IP, rf"{DIGITS} and text rlike '[0-9]\\.[0-9]'", 1, True),
    ("card", CARD, rf"{DIGITS} and text rlike '(?:[0-9][ -]?){{15}}[0-9]'", 2, True),
    ("phone", PHONE, "contains(text, '+')", 3, True),
    ("phone", LOCAL, rf"{DIGITS} and text rlike '[0-9]{{3}}[.-][0-9]{{4}}'", 3, False),
    ("secret", SECRET, DIGITS, 4, False),
    ("ssn", SSN, rf"{DIGITS} and text rlike '[0-9]{{3}}-[0-9]{{2}}-'", 5, False),
    ("iban", IBAN, rf"{DIGITS} and text rlike '[A-Z]{{2}}[0-9]{{2}}'", 6, False),
]
ORDER = {kind: order for kind, _, _, order, _ in KINDS}

#: Gazetteers. What begins or ends a value of a kind, and words that announce one.
DOMAINS = "com|org|net|edu|gov|int|info|io|eu|uk|de|fr|es|it|nl|us|ca|ch|at"
SECRET_PREFIXES = "AKIA|ASIA|ghp_|gho_|sk-|sk_|pk_|xoxb-|xoxp-|AIza|eyJ"
CUES = {
    "email": "mail|contact|write|courriel|correo",
    "ip": r"\bip\b|host|server|address|from",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta|pan",
    "phone": r"phone|tel\b|tel\.|call|fax|mobile|telefon|t[ée]l[ée]phone",
    "secret": "token|secret|passw|api.?key|access.?key|private|bearer|credential",
    "ssn": "ssn|social",
    "iban": "iban|account|konto|compte|cuenta",
}

BLOCK = 128
LABELERS = 4
FEATURES = ["cue", "glued", "quoted", "mixed", "long", "digits"]


def _sums(lengths: str) -> str:
    """SQL for the sums of all elements before each of an array of longs, in blocks so that arrays aren't copied for each element."""
    inner = "aggregate(b, named_struct('s', acc.s, 'a', cast(array() AS array<bigint>)), (q, y) -> named_struct('s', q.s + y, 'a', concat(q.a, array(q.s))), q -> q.a)"
    return (
        f"flatten(aggregate(transform(sequence(0, (greatest(size({lengths}), 1) - 1) div {BLOCK}), k -> slice({lengths}, cast(k * {BLOCK} + 1 AS int), {BLOCK})), "
        f"named_struct('s', 0L, 'a', cast(array() AS array<array<bigint>>)), (acc, b) -> named_struct('s', acc.s + aggregate(b, 0L, (x, y) -> x + y), 'a', "
            f"concat(acc.a, array({inner}))), acc -> acc.a))"
    )


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(pattern: str, guard: str) -> str:
    """SQL for the matches of a pattern in text: array of structs with m, start (from 0), before (up to 24 characters) and after (1)."""
    q = _quote(pattern)
    # a variable of transform(array(value), ...) holds its value, which would be computed for each element otherwise
    matches = f"named_struct('m', regexp_extract_all(text, {q}, 0), 'p', split(text, {q}, -1))"
    lengths = "transform(z.p, (p, i) -> cast(length(p) + coalesce(length(get(z.m, i)), 0) AS bigint))"
    one = "named_struct('m', m, 'start', s[i] + length(z.p[i]), 'before', right(z.p[i], 24), 'after', left(z.p[i + 1], 1))"
    return f"CASE WHEN {guard} THEN transform(array({matches}), z -> transform(transform(array({lengths}), l -> {_sums('l')}), s -> transform(z.m, (m, i) -> {one}))[0])[0] END"


_NUMBER = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(split(reverse({_NUMBER}), ''), (d, i) -> coalesce(try_cast(d AS int), 0) * (1 + i % 2)), 0, (t, v) -> t + if(v > 9, v - 9, v)) % 10 = 0"""
#: SQL for whether a match x of a base pattern counts.
VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '\\\\.'), v -> length(ltrim('0', v)) <= 3 AND coalesce(try_cast(right(v, 3) AS int), 0) <= 255)",
    "card": f"length({_NUMBER}) BETWEEN 16 AND 19 AND {_LUHN}",
    "phone": f"length({_NUMBER}) BETWEEN 8 AND 15",
}
#: SQL for the votes of the regular-expression and the gazetteer labeler: true, false, or null to abstain.
STRICT = VALID | {
    "email": "length(x.m) <= 254 AND NOT x.m rlike '\\\\.\\\\.|^\\\\.|\\\\.@'",
    "secret": "x.m rlike '^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$' OR x.m rlike '[a-z]' AND x.m rlike '[A-Z]' AND x.m rlike '[0-9].*[0-9]'",
    "ssn": "NOT x.m rlike '^(?:000|666|9)|-00-|-0000$'",
    "iban": "length(replace(x.m, ' ', '')) BETWEEN 15 AND 34",
    "local": "true",
}
GAZETTEER = {
    "email": f"x.m rlike '\\\\.(?:{DOMAINS})$'",
    "ip": "NOT x.m rlike '^(?:0|127|255)\\\\.'",
    "card": "x.m rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)'",
    "phone": "x.m rlike '^[+](?:1|3[0-9]|4[0-9]|5|6|7|8|9)' OR NOT startswith(x.m, '+')",
    "secret": f"if(x.m rlike '^(?:{SECRET_PREFIXES})', true, if(x.m rlike '^[A-Za-z]+[0-9]{{1,4}}$', false, null))",
    "ssn": "if(x.m rlike '^(?:123-45-6789|078-05-1120)$', false, null)",
    "iban": "x.m rlike '^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|PL)'",
}


def _vote(condition: str) -> str:
    return f"coalesce(if({condition}, '1', '0'), '2')"


def _candidates(kind: str, pattern: str, guard: str, order: int, base: bool) -> str:
    cue = f"lower(x.before) rlike {_quote(CUES[kind])}"
    glued = "(x.before rlike '[A-Za-z0-9_]$' OR x.after rlike '[A-Za-z0-9_]')"
    votes = ", ".join([_vote(STRICT["local" if kind == "phone" and not base else kind]), f"coalesce(if({GAZETTEER[kind]}, '1', '0'), '2')", f"if({cue}, '1', '2')", f"if({glued}, '0', '1')"])
    flags = [cue, glued, "x.before rlike '[\"\\'`(<\\\\[]$'", "x.m rlike '[A-Za-z]' AND x.m rlike '[0-9]'", "length(x.m) >= 24", f"length({_NUMBER}) * 2 >= length(x.m)"]
    feats = ", ".join(f"if({f}, '1', '0')" for f in flags)
    valid = VALID[kind] if base else "false"
    return f"coalesce(transform({_found(pattern, guard)}, x -> named_struct('kind', {order}, 'start', x.start, 'end', x.start + length(x.m), 'base', {valid}, 'votes', concat({votes}), 'feats', concat({feats}))), array())"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of candidates (kind as a number, start, end, base, votes, feats), written once."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return table(plain.select("doc_id", F.expr(f"concat({', '.join(_candidates(*k) for k in KINDS)})").alias("spans")), "spans")


def reliabilities(counts: dict[tuple[int, str], float], rounds: int = 30) -> dict[tuple[int, str], float]:
    """Posterior of each (kind, votes) by expectation maximisation: a prior for each kind, and each labeler's chance of each vote for right and for wrong spans."""
    post = {p: (1 + p[1].count("1")) / (2 + p[1].count("1") + p[1].count("0")) for p in counts}
    kinds = {k for k, _ in counts}
    for _ in range(rounds):
        prior, chance = {}, {}
        for kind in kinds:
            own = [(v, n, post[kind, v]) for (k, v), n in counts.items() if k == kind]
            right, wrong = sum(n * p for _, n, p in own), sum(n * (1 - p) for _, n, p in own)
            prior[kind] = (right + 1) / (right + wrong + 2)
            for j in range(LABELERS):
                for vote in "012":
                    a, b = (2, 1) if vote == "1" else (1, 2) if vote == "0" else (1, 1)  # labelers are a little better than chance
                    chance[kind, j, vote] = ((sum(n * p for v, n, p in own if v[j] == vote) + a) / (right + 4), (sum(n * (1 - p) for v, n, p in own if v[j] == vote) + b) / (wrong + 4))
        for kind, v in counts:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(chance[kind, j, x][0] / chance[kind, j, x][1]) for j, x in enumerate(v))
            post[kind, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def _inputs(kind: int, feats: str) -> list[int]:
    """Numbers of the features that are on: the kind, and each flag within its kind."""
    width = 1 + len(FEATURES)
    return [kind * width, *(kind * width + 1 + j for j, f in enumerate(feats) if f == "1")]


def train(rows: list[tuple[int, str, float, float]], steps: int = 300, rate: float = 1.0) -> list[float]:
    """Weights of a logistic classifier from (kind, feats, count, posterior)."""
    w = [0.0] * ((max(ORDER.values()) + 1) * (1 + len(FEATURES)))
    total = {}
    for kind, _, n, _ in rows:
        total[kind] = total.get(kind, 0) + n
    for _ in range(steps):
        slope = [1e-3 * x for x in w]
        for kind, feats, n, p in rows:
            on = _inputs(kind, feats)
            gap = n / total[kind] * (1 / (1 + math.exp(-sum(w[i] for i in on))) - p)
            for i in on:
                slope[i] += gap
        w = [x - rate * s for x, s in zip(w, slope, strict=True)]
    return w


def fitted(spans: DataFrame) -> list[float]:
    """The span classifier for a table of candidates."""
    rows = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.feats").count().collect()  # at most votes x features x kinds
    counts: dict[tuple[int, str], float] = {}
    for r in rows:
        counts[r["kind"], r["votes"]] = counts.get((r["kind"], r["votes"]), 0) + r["count"]
    post = reliabilities(counts)
    return train([(r["kind"], r["feats"], r["count"], post[r["kind"], r["votes"]]) for r in sorted(rows)])


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in sorted(ORDER, key=ORDER.get)) + ")"
    return F.expr(f"array_join(transform(array_sort(transform({spans}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))), s -> "
        f"concat_ws(':', {names}[s.kind], s.start, s.end)), ',')")


def found(spans: DataFrame, weights: list[float], threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts and digest, all spans and their number."""
    width = 1 + len(FEATURES)
    z = " + ".join([f"w[s.kind * {width}]", *(f"if(substring(s.feats, {j + 1}, 1) = '1', w[s.kind * {width} + {j + 1}], 0D)" for j in range(len(FEATURES)))])
    w = "array(" + ", ".join(f"{x!r}D" for x in weights) + ")"
    # sorted by kind and place, a span can overlap none of its kind but the one before it: local numbers hold no plus, and base numbers have too few digits for two of them
    free = "NOT coalesce(get(spans, i - 1).base AND get(spans, i - 1).kind = s.kind AND get(spans, i - 1).end > s.start, false)"
    added = f"s.kind >= {ORDER['phone']} AND (s.kind > {ORDER['phone']} OR startswith(s.votes, '1')) AND {z} >= {math.log(threshold / (1 - threshold))!r}D AND {free}"
    kept = spans.withColumn("w", F.expr(w)).withColumn("spans", F.array_sort("spans")).withColumn("kept",
        F.expr(f"filter(spans, (s, i) -> s.base OR {added})")).withColumn("base", F.expr("filter(spans, s -> s.base)"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {order})) AS bigint)").alias(f"n_{kind}") for kind, _, _, order, base in KINDS if base]
    return kept.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("kept").alias("spans"), F.size("kept").cast("long").alias("n_spans"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = candidates(documents(spark, sf_dir))
    return found(spans, fitted(spans))
