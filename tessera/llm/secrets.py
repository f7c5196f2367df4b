"""Secret scans: patterns, and a battery of randomness tests with control of false discoveries.

Base spans come from three patterns. Beside them, every run of 16 letters, digits or signs of base 64 is a candidate. Its encoding is
the smallest alphabet that has all its symbols (base 16, 32, 36, 62 or 64). Three tests ask whether its symbols look drawn evenly and
independently from that alphabet: chi-squared uniformity, runs above and below the alphabet's middle, and serial correlation. Fisher's
method puts them together; a candidate that fails at 0.001 is no secret.

What passes may still be short text, as the tests find little in 16 letters. So each candidate is also held against ordinary text of its
own length. Its evidence is how much likelier its symbols are when drawn evenly than when drawn as often as the corpus has them (one in
ten evenly, so that no rare symbol decides alone): a ratio that is 1 on average over ordinary text of any length, and so an e-value. Candidates
of an encoding and class of length are a family, in which the procedure of Benjamini and Hochberg for e-values keeps the expected share
of false discoveries at 0.01, however candidates depend on each other: of m candidates k are discoveries where the k-th largest ratio is at
least m / (0.01 k). Letters are counted over all documents; the procedure works on counts by family and fiftieth of a unit of log-ratio, which
are a fixed number, rounded down.

Cases: null and empty texts have no spans; base spans stay whatever the tests say, and a candidate that touches one is dropped; runs of
digits alone are numbers, not secrets; padding belongs to a span but not to its symbols; repeated rows are scanned each; other columns
are ignored; an empty table gives no rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, table, texts

#: The base patterns in their order, each with the group whose length counts and the least length.
BASE = [
    ("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", rb"AKIA[A-Z0-9]+", 0, 18),
    ("hex", rb"[0-9a-f]+", 0, 16),
]
#: Encodings with their alphabets in order, from the smallest, and whether either case will do (but not both in one run).
ENCODINGS = [
    ("base16", "0123456789abcdef", True),
    ("base32", "abcdefghijklmnopqrstuvwxyz234567", True),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", True),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", False),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", False),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", False),
]

CANDIDATE = re.compile(rb"[A-Za-z0-9+/_-]{16,}+={0,2}")
#: Where classes of length begin.
CLASSES = [16, 20, 24, 32, 48, 64]
NOT_RANDOM, FALSE, EVENLY = 0.001, 0.01, 0.1
STEPS, FAR = 50, 40

_PLACE = np.full((len(ENCODINGS), 256), -1)
for _e, (_, _symbols, _either) in enumerate(ENCODINGS):
    for _k, _c in enumerate(_symbols):
        _PLACE[_e, ord(_c)] = _k
        if _either:
            _PLACE[_e, ord(_c.upper())] = _k


def inferred(symbols: np.ndarray) -> int | None:
    """The number of the first encoding that has all symbols; none for digits alone, or where a one-case alphabet is written in both."""
    digit, upper, lower = (np.any((symbols >= a) & (symbols <= b)) for a, b in ((48, 57), (65, 90), (97, 122)))
    if not upper and not lower:
        return None
    for e, (_, _, either) in enumerate(ENCODINGS):
        if (_PLACE[e, symbols] >= 0).all() and not (either and upper and lower):
            return e
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(places: np.ndarray, size: int) -> tuple[float, float, float]:
    """Chances that symbols drawn evenly from an alphabet of so many are as uneven, come in runs as many or few, and follow each other as closely."""
    n = len(places)
    counts = np.bincount(places, minlength=size)
    chi, free = size / n * float((counts.astype(float) ** 2).sum()) - n, size - 1
    free *= n / (n - 1)  # the exact variance is 2 (size - 1) (n - 1) / n
    chi *= n / (n - 1)
    uneven = math.erfc(((chi / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)) / math.sqrt(2)) / 2  # Wilson and Hilferty
    high = places * 2 >= size
    a, b = int(high.sum()), int(n - high.sum())
    runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 2 * a * b / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    in_runs = _two_sided((runs - mean) / math.sqrt(spread)) if spread > 0 else 2.0 ** (1 - n)
    x = places - places.mean()
    square = float((x * x).sum())
    serial = _two_sided((float((x[1:] * x[:-1]).sum()) / square + 1 / n) * math.sqrt(n)) if square > 0 else 2.0 ** (1 - n)
    return max(uneven, 1e-300), max(in_runs, 1e-300), max(serial, 1e-300)


def combined(chances: tuple[float, ...]) -> float:
    """Fisher's method: the upper tail of chi-squared with twice as many degrees of freedom, in closed form."""
    x = -sum(math.log(p) for p in chances)
    return math.exp(-x) * sum(x**k / math.factorial(k) for k in range(len(chances)))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans of a text, in bytes, in order."""
    out = []
    for kind, (_, pattern, group, least) in enumerate(_BASE):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


# the same spans, found faster: a run of 16 begins where no symbol stands before it
_BASE = [(BASE[0][0], re.compile(BASE[0][1]), 2, 12), ("access", re.compile(rb"AKIA[A-Z0-9]{14,}+"), 0, 18), ("hex", re.compile(rb"(?<![0-9a-f])[0-9a-f]{16,}+"), 0, 16)]


def candidates(text: bytes, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, list[int], float]]:
    """(start, end, encoding, symbols, counts of the alphabet's, chance of the battery) of each candidate that touches no base span."""
    k, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach = max(reach, taken[k][2])
            k += 1
        if reach > m.start():
            continue
        symbols = np.frombuffer(text[m.start() : m.end()].rstrip(b"="), np.uint8)
        e = inferred(symbols)
        if e is None:
            continue
        places = _PLACE[e, symbols]
        size = len(ENCODINGS[e][1])
        yield m.start(), m.end(), e, len(symbols), np.bincount(places, minlength=size).tolist(), combined(battery(places, size))


_SCAN = "doc_id long, base array<struct<start: bigint, kind: int, end: bigint>>, found array<struct<start: bigint, end: bigint, encoding: int, n: bigint, counts: array<bigint>, chance: double>>, letters array<bigint>"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text) with its base spans and candidates, by code points, and one with the counts of all bytes for each partition."""
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("n", pa.int64()), ("counts", pa.list_(pa.int64())), ("chance", pa.float64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", base_type), ("found", found_type), ("letters", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(256, np.int64)
        for part, data, offsets in texts(batches):
            letters += np.bincount(data, minlength=256)
            base, found = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                text = data[a:b].tobytes()
                spans = base_spans(text)
                more = list(candidates(text, spans))
                point = lambda k: k
                if (spans or more) and not text.isascii():
                    points = np.append(0, np.cumsum((data[a:b] & 0xC0) != 0x80))
                    point = lambda k, points=points: int(points[k])
                base.append([{"start": point(x), "kind": k, "end": point(y)} for x, k, y in spans])
                found.append([{"start": point(x), "end": point(y), "encoding": e, "n": n, "counts": q, "chance": p} for x, y, e, n, q, p in more])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, base_type), pa.array(found, found_type), pa.nulls(len(base), pa.list_(pa.int64()))], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], base_type), pa.array([None], found_type), pa.array([letters.tolist()], pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), _SCAN)


def letters(scanned: DataFrame) -> np.ndarray:
    """How often the corpus has each of the 256 bytes."""
    out = np.zeros(256)
    for r in scanned.where("letters IS NOT NULL").select(F.posexplode("letters").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def ratios(counts: np.ndarray) -> list[list[float]]:
    """For each encoding and symbol, the logarithm of its even share over its share in text, in which one symbol in ten counts as drawn evenly."""
    out = []
    for e, (_, symbols, _) in enumerate(ENCODINGS):
        n = np.bincount(_PLACE[e][_PLACE[e] >= 0], counts[_PLACE[e] >= 0], len(symbols))
        even = 1 / len(symbols)
        text = (1 - EVENLY) * n / max(n.sum(), 1) + (EVENLY if n.sum() else 1) * even
        out.append(np.log(even / text).tolist())
    return out


def evidence(logs: list[list[float]]) -> str:
    """SQL for the log-ratio of a candidate s, in steps, rounded down."""
    table_ = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in row) + ")" for row in logs) + ")"
    total = f"aggregate(zip_with(s.counts, element_at({table_}, s.encoding + 1), (c, l) -> c * l), 0D, (a, x) -> a + x)"
    return f"cast(greatest(least(floor({STEPS} * {total}), {STEPS * FAR}), {-STEPS * FAR}) AS int)"


_CLASS = f"size(filter(array({', '.join(map(str, CLASSES))}), c -> c <= s.n))"


def cutoffs(found: DataFrame, logs: list[list[float]], false: float = FALSE) -> dict[tuple[int, int], int]:
    """The least step that counts as a discovery, by encoding and class of length, after Benjamini and Hochberg for e-values."""
    one = found.where("found IS NOT NULL").select(F.explode("found").alias("s"))
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for r in one.select("s.encoding", F.expr(_CLASS).alias("class"), F.expr(evidence(logs)).alias("step")).groupBy("encoding", "class",
        "step").count().collect():  # 6 encodings, 6 classes, 4,001 steps at most
        counts.setdefault((r["encoding"], r["class"]), {})[r["step"]] = r["count"]
    out = {}
    for family, steps in counts.items():
        total, seen = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            seen += steps[step]
            if math.exp(step / STEPS) * false * seen >= total:
                out[family] = step
    return out


def reported(scanned: DataFrame, logs: list[list[float]], least: dict[tuple[int, int], int]) -> DataFrame:
    """doc_id, base counts and digest, all spans, and their number."""
    if least:
        pick = "CASE " + " ".join(f"WHEN s.encoding = {e} AND {_CLASS} = {c} THEN {step}" for (e, c), step in sorted(least.items())) + " END"
        secret = f"s.chance >= {NOT_RANDOM} AND coalesce({evidence(logs)} >= {pick}, false)"
    else:
        secret = "false"
    kinds = [k for k, *_ in BASE] + [e for e, *_ in ENCODINGS]
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    joined = lambda spans: F.expr(f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')")
    added = f"transform(filter(found, s -> {secret}), s -> named_struct('start', s.start, 'kind', s.encoding + {len(BASE)}, 'end', s.end))"
    rows = scanned.where("base IS NOT NULL").withColumn("all", F.expr(f"array_sort(concat(base, {added}))"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)").alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"), F.size("all").cast("long").alias("n_spans"))


def secrets(docs: DataFrame, false: float = FALSE) -> DataFrame:
    """Secrets of docs (doc_id, text)."""
    scanned = table(scan(docs), "scanned")
    logs = ratios(letters(scanned))
    return reported(scanned, logs, cutoffs(scanned, logs, false))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))
