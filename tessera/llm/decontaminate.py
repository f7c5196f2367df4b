"""Benchmark decontamination by a prefix-filtered set join.

The shingles of every item window are ordered by how often they occur in the whole corpus. A window must be contained whole, so its
necessary prefix is its rarest shingle alone: documents are joined with the windows on that token. A join row fixes where the window
would start (the positional bound) and how many words must follow (the length bound); what passes is verified word by word. Items of
fewer words than a window are one window of their own length.

The benchmark is taken in blocks of about BLOCK bytes of windows and item ids, dealt by a hash of both, so that a window of a great many items is spread over blocks, too; only one block is
collected and broadcast at a time, and every block meets all documents. What blocks find for a document adds up.

Cases: null and wordless texts have no words and no hits; null or wordless items have no windows; windows of items without
item_id count for n_hit and contaminated, and not for the items; repeated rows and repeated items are
kept as they are (equal windows of several items count for each); empty tables give empty results or documents without hits; other
columns are ignored. Ties in rarity go to the earlier shingle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, LOWER, discard, documents, grams, lean, table, texts, words

WINDOW, SHINGLE, BLOCK = 10, 3, 32 << 20
PAIRS = 2_000_000  # candidates looked at together
STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("ranges", pa.binary()), ("items", pa.list_(pa.string())),
    ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_SPACED = bytes(int(LOWER[i]) if ALNUM[LOWER[i]] else 32 for i in range(256))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPACED).split()


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (a string), place and words of each window of the items: columns item_id, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = [x.decode() for x in split(text)]
                out = [(item, k, " ".join(w[k : k + window])) for k in range(max(1, len(w) - window + 1))] if w else []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["item_id", "place", "words"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).mapInArrow(lean(run), "item_id string, place long, words string")


class Index:
    """The windows of a block: distinct texts with their items, word hashes and shingles."""

    def __init__(self, rows: list[tuple[str | None, str]]) -> None:
        by: dict[str, set[str]] = {}
        for item, text in rows:
            by.setdefault(text, set()).update([] if item is None else [item])
        self.texts = [t.encode() for t in sorted(by)]
        self.items = [sorted(by[t.decode()]) for t in self.texts]
        self.length = np.array([t.count(b" ") + 1 for t in self.texts])
        data = np.frombuffer(b" ".join(self.texts), np.uint8)
        sizes = np.cumsum([0, *(len(t) + 1 for t in self.texts)])
        sizes[-1] -= 1
        _, _, h, first = words(data, sizes, ALNUM)
        self.tokens = [[], []]  # of each shingle of each window: window, offset
        self.hash, kinds = [], []
        for w, n in enumerate(self.length):
            g = grams(h[first[w] : first[w] + n], k := min(SHINGLE, int(n)))
            self.tokens[0] += [w] * len(g)
            self.tokens[1] += range(len(g))
            self.hash += list(g)
            kinds += [k] * len(g)
        self.tokens = np.array(self.tokens, np.int64).reshape(2, -1)
        self.hash, self.kinds = np.array(self.hash, np.uint64), np.array(kinds, np.int64)
        self.shingles, self.which = np.unique(self.hash, return_inverse=True)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.shingles >> np.uint64(44)).astype(np.int64)] = True

    def choose(self, counts: np.ndarray) -> None:
        """Keep the rarest shingle of each window as its prefix."""
        w, at = self.tokens
        order = np.lexsort((at, counts[self.which], w))
        first = order[np.append(True, w[order][1:] != w[order][:-1])] if len(order) else order
        self.prefix, by = self.hash[first], np.argsort(self.hash[first], kind="stable")
        self.prefix, self.window, self.offset, self.kind = self.prefix[by], w[first][by], at[first][by], self.kinds[first][by]
        self.sieve[:] = False
        self.sieve[(self.prefix >> np.uint64(44)).astype(np.int64)] = True
        del self.hash, self.tokens, self.kinds, self.which, self.shingles

    def seen(self, h: np.ndarray, k: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the k-word shingles that are in a sorted array, and their hashes."""
        g = grams(h, k)
        at = np.flatnonzero(self.sieve[(g >> np.uint64(44)).astype(np.int64)])
        g = g[at]
        if len(at):
            ok = among[np.minimum(np.searchsorted(among, g), len(among) - 1)] == g
            at, g = at[ok], g[ok]
        return at, g


def frequencies(docs: DataFrame, index) -> DataFrame:
    """How often each shingle of a block occurs in all documents (of those that do)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        counts = np.zeros(len(x.shingles), np.int64)
        for _, data, offsets in texts(batches):
            _, _, h, first = words(data, offsets, ALNUM)
            for k in np.unique(x.kinds):
                at, g = x.seen(h, int(k), x.shingles)
                inside = at + k <= first[np.searchsorted(first, at, "right")] if len(at) else at > 0
                counts += np.bincount(np.searchsorted(x.shingles, g[inside]), minlength=len(counts))
        k = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(counts[k])], ["shingle", "n"])

    return docs.select("text").mapInArrow(lean(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _match(state: DataFrame, index, fields: pa.Schema = STATE) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        lengths = np.array(x.length)
        for part, data, offsets in texts(batches):
            starts, ends, h, first = words(data, offsets, ALNUM)
            low = LOWER[data].tobytes()
            pairs: list[np.ndarray] = []
            for k in np.unique(x.kind):
                at, g = x.seen(h, int(k), x.prefix)
                lo, hi = np.searchsorted(x.prefix, g, "left"), np.searchsorted(x.prefix, g, "right")
                which = np.cumsum(hi - lo) // PAIRS
                for some in np.split(np.arange(len(at)), np.flatnonzero(which[1:] != which[:-1]) + 1):
                    n = hi[some] - lo[some]
                    rows = np.repeat(some, n)
                    p = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + lo[rows]
                    p, rows = p[ok := x.kind[p] == k], rows[ok]
                    doc = np.searchsorted(first, at[rows], "right") - 1
                    begin = at[rows] - x.offset[p]
                    ok = (begin >= first[doc]) & (begin + lengths[x.window[p]] <= first[np.minimum(doc + 1, len(first) - 1)])
                    pairs.append(np.stack([doc[ok], begin[ok], x.window[p][ok]], 1))
            pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 3), np.int64)
            found: dict[int, list[tuple[int, int, int]]] = {}
            for doc, begin, w in pairs.tolist():
                n = int(lengths[w])
                if b" ".join(low[starts[j] : ends[j]] for j in range(begin, begin + n)) == x.texts[w]:
                    found.setdefault(doc, []).append((begin - int(first[doc]), n, w))
            ranges, items = part.column(3).to_pylist(), part.column(4).to_pylist()
            for doc, hits in found.items():
                ranges[doc] = (ranges[doc] or b"") + np.array([y[:2] for y in hits], np.int64).tobytes()
                items[doc] = sorted({*(items[doc] or ()), *(i for y in hits for i in x.items[y[2]])}) or None
            n = np.diff(first)
            hit = [int(covered(int(k), r).sum()) if r else 0 for k, r in zip(n, ranges, strict=True)]
            sha = [hashlib.sha256(",".join(i or ()).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(ranges, pa.binary()), pa.array(items, pa.list_(pa.string())),
                pa.array(hit, pa.int64()), pa.array([len(i or ()) for i in items], pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())],
                schema=fields)

    return state.mapInArrow(lean(run), "doc_id long, text string, n_words long, ranges binary, items array<string>, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) with n_words, ranges (pairs of 64-bit first word and length of each hit, words from 0), items (sorted ids, null for none) and counts of these."""
    spark = docs.sparkSession
    grid = table(windows(items, window).select("words", F.col("item_id").alias("item")).distinct(), "windows")
    total = grid.agg(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-total // block))
    grid = grid.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(blocks)))
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("binary").alias("ranges"), F.lit(None).cast("array<string>").alias("items"))
    previous = None
    for k in range(blocks):
        x = Index([(r.item, r.words) for r in grid.where(F.col("block") == k).collect()])  # about `block` bytes
        shared = spark.sparkContext.broadcast(x)
        counts = np.zeros(len(x.shingles), np.int64)
        if len(counts):
            for r in frequencies(docs, shared).collect():  # at most the shingles of the block
                counts[r.shingle] = r.n
        x.choose(counts)
        state = _match(state, spark.sparkContext.broadcast(x))
        if k < blocks - 1:  # one block's index in memory at a time
            state = table(state, "contamination")
            if previous is not None:
                discard(previous)
            previous = state
    return state


def report(state: DataFrame) -> DataFrame:
    """The counts of each document."""
    return state.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items")


def covered(n: int, ranges: bytes | None) -> np.ndarray:
    """Which of n words lie in a range."""
    depth = np.zeros(n + 1, np.int64)
    if ranges:
        r = np.frombuffer(ranges, np.int64).reshape(-1, 2)
        np.add.at(depth, r[:, 0], 1)
        np.add.at(depth, r[:, 0] + r[:, 1], -1)
    return np.cumsum(depth)[:n] > 0


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))).drop("items")
