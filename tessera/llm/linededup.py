"""Line dedup by winnowing: repeated lines and runs of words that stood earlier in the corpus go.

Two units are fingerprinted. A line (what stands between line feeds) of LINE to WORDS - 1 words is one fingerprint by its own hash. Longer stretches are covered by runs of WORDS successive
words, within lines or across them: the fingerprint of a run is its window minimum, the least hash of the GRAM-word grams in it, so equal runs are sure to have the same one, and
successive runs mostly share it. A stretch of runs with one fingerprint travels as one entry: the fingerprint, its place and length, and 40 bits of the hash of each of its runs.

Positions are joined on the fingerprint. A match is extended both ways from it, word by word, to the first that differs: by the runs' hashes within the entry, by the entries that adjoin it
beyond; each run is compared with all earlier places of its fingerprint, not with the first only. All but the first place give ranges of words, which add up to the passages that are deleted. So of any
line of at least LINE words, and any passage of at least WORDS, the first place keeps its text, by (doc_id, place), and all others lose theirs. A repeated line of fewer words than LINE stays: so
short a line is often equal by chance.

Entries are first joined within each slice of a task, and only those that have a run new to the slice go on, so a hot line or passage makes few entries for a slice.

Cases: null and empty texts have no words and stay; rows that repeat doc_id and text are one document and keep the same text; rows without doc_id come first; ties go to
the smaller checksum of the text; case (A-Z) doesn't matter, nor the kind of white space within a line; runs may overlap the place they repeat (of one word over and over, the first stays);
empty tables give no rows; other columns stay as they are, whatever their names (columns named n_words, n_removed or n_runs are replaced by the operator's own)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BLOBS, MIXERS, NONSPACE, blob_row, blobs, bucket_keys, bucket_of, by_key, documents, gc, grams, lean, mix, named, powers, shuffle_partitions, table, texts, unblob, words

GRAM, WORDS, LINE = 6, 16, 5
FLUSH = 2_500_000  # runs
MOST = 4_000_000  # runs compared at once
LENGTH = 255
NO_ID = -(1 << 63)
TEXT = ["i8", "u4", "u4"]  # doc_id, checksum of the text, number of entries
ENTRY = ["u8", "u4", "u1"]  # fingerprint (odd for a line), first run, number of runs
RUN = ["u4", "u1"]  # 40 bits of the hash; of a line its number of words
RANGE = ["i8", "u4", "u4", "u4"]  # doc_id, checksum, first word, end


def lowest(g: np.ndarray, n: int) -> np.ndarray:
    """The least of each n successive values."""
    if len(g) < n:
        return g[:0]
    span = 1
    while 2 * span <= n:
        g, span = np.minimum(g[:-span], g[span:]), 2 * span
    return np.minimum(g[: len(g) - n + span], g[n - span :]) if span < n else g


def runs(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of runs of n words with the same least hash in some texts' words: the hash, the first run's word, the number of runs; and the hashes of all the runs."""
    if len(h) < n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    gram = min(GRAM, n)
    least = lowest(grams(h, gram), n - gram + 1)
    power, inverse = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    own = mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1])
    room = np.repeat(first[1:], np.diff(first))[: len(own)] - np.arange(len(own))  # words up to the text's end
    at = np.flatnonzero(room >= n)
    new = np.append(True, (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]))[: len(at)]
    begin = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    begin = np.flatnonzero(place % LENGTH == 0)
    return least[at[begin]] & ~np.uint64(1), at[begin], np.diff(np.append(begin, len(at))), own[at]


def lines(data: np.ndarray, starts: np.ndarray, h: np.ndarray, first: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of least to most words of some texts: the hash (odd), the first word and the number of words."""
    cuts = np.unique(np.concatenate([first, np.searchsorted(starts, np.flatnonzero(data == 10))]))
    begin, n = cuts[:-1], np.diff(cuts)
    ok = (n >= least) & (n <= most)
    begin, n = begin[ok], n[ok]
    power, inverse = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[begin + n] - total[begin]) * inverse[begin] + n.astype(np.uint64) * MIXERS[60]) | np.uint64(1), begin, n


def spread(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, as many as sizes says, of each."""
    return np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)


def _sorted(e: list[np.ndarray], own: list[np.ndarray], order: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Some entries and their runs in an order."""
    sizes = e[4].astype(np.int64)
    at = spread((np.cumsum(sizes) - sizes)[order], sizes[order])
    return [c[order] for c in e], [c[at] for c in own]


def _later(e: list[np.ndarray], own: list[np.ndarray], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which entries (sorted by place) have a run that is the first of its hash, and the ranges of words of the runs at later places."""
    least, doc, tag, start, sizes = e
    sizes = sizes.astype(np.int64)
    entry, at = np.repeat(np.arange(len(sizes)), sizes), spread(start.astype(np.int64), sizes)
    key = mix(least[entry] + (own[0].astype(np.uint64) | (own[1].astype(np.uint64) << np.uint64(32))) * MIXERS[61])
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    lead = np.empty(len(key), np.int64)
    lead[order] = np.repeat(np.minimum.reduceat(order, begin), np.diff(np.append(begin, len(key)))) if len(key) else 0
    new = lead == np.arange(len(lead))
    fresh = np.bincount(entry[new], minlength=len(sizes)) > 0
    k = np.flatnonzero(~new)
    x, y = entry[k], entry[lead[k]]
    k = k[~((doc[x] == doc[y]) & (tag[x] == tag[y]) & (at[k] == at[lead[k]]))]  # a repeated row is no later place
    x = entry[k]
    cuts = np.flatnonzero(np.append(True, (k[1:] != k[:-1] + 1) | (x[1:] != x[:-1]))[: len(k)])
    ends = k[np.append(cuts[1:], len(k))[: len(cuts)] - 1]
    length = np.where(least[x[cuts]] & np.uint64(1), own[0][k[cuts]].astype(np.int64), n)
    return fresh, [doc[x[cuts]], tag[x[cuts]], at[k[cuts]], at[ends] + length]


def _pack(e: list[np.ndarray], own: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
    """One row of kind 0 for each bucket: the number of its texts, these, their entries and the entries' runs (entries are sorted by place)."""
    buckets = bucket_of(mix(e[0]), len(keys))
    e, own = _sorted(e, own, order := np.argsort(buckets, kind="stable"))
    cuts = np.searchsorted(buckets[order], np.arange(len(keys) + 1))
    at = np.append(0, np.cumsum(e[4].astype(np.int64)))[cuts]
    for b in np.flatnonzero(np.diff(cuts)):
        least, doc, tag, start, sizes = (c[cuts[b] : cuts[b + 1]] for c in e)
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
        columns = [doc[first], tag[first], np.diff(np.append(first, len(doc))), least, start, sizes, *(c[at[b] : at[b + 1]] for c in own)]
        yield blob_row(keys[b], len(doc), b"".join([len(first).to_bytes(8, "little"), *(c.astype(t).tobytes() for c, t in zip(columns, TEXT + ENTRY + RUN, strict=True))]), 0)


def _unpack(rows: list[tuple[int, bytes]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    width = lambda kinds: sum(np.dtype(t).itemsize for t in kinds)
    heads, bodies, tails = [], [], []
    for n, blob in rows:
        k = int.from_bytes(blob[:8], "little")
        a = 8 + k * width(TEXT)
        b = a + n * width(ENTRY)
        heads.append((k, memoryview(blob)[8:a]))
        bodies.append((n, memoryview(blob)[a:b]))
        tails.append(((len(blob) - b) // width(RUN), memoryview(blob)[b:]))
    doc, tag, n = unblob(heads, TEXT)
    least, start, sizes = unblob(bodies, ENTRY)
    return [least, np.repeat(doc, n), np.repeat(tag, n), start, sizes], unblob(tails, RUN)


def ranges(docs: DataFrame, least: int = WORDS, line: int = LINE) -> DataFrame:
    """doc_id, tag and ranges (pairs of 32-bit first word and end) of documents with runs that came earlier."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    keys = bucket_keys(spark, n)

    def later(found: list[np.ndarray]) -> pa.RecordBatch:
        return blobs(bucket_of(mix(found[0].astype(np.uint64)), n), [c.astype(t) for c, t in zip(found, RANGE, strict=True)], keys, 1)

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            c = [np.concatenate(x) for x in zip(*held, strict=True)]
            e, own = _sorted(c[:5], c[5:], np.lexsort((c[3], c[2], c[1])))
            fresh, again = _later(e, own, least)
            if len(again[0]):
                yield later(again)
            yield from _pack(*_sorted(e, own, np.flatnonzero(fresh)), keys)

        for part, data, offsets in texts(batches):
            starts, _, h, first = words(data, offsets, NONSPACE)
            low, at, sizes, own = runs(h, first, least)
            short, place, n_ = lines(data, starts, h, first, line, least - 1)
            low, at, sizes, own = np.append(low, short), np.append(at, place), np.append(sizes, np.ones(len(short), np.int64)), np.append(own, n_.astype(np.uint64))
            if not len(at):
                continue
            doc = np.searchsorted(first, at, "right") - 1
            ids = part.column(0).fill_null(NO_ID).to_numpy()
            tags = np.array([zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint32)
            held.append([low, ids[doc], tags[doc], (at - first[doc]).astype(np.uint32), sizes.astype(np.uint8), own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint8)])
            size += len(own)
            if size >= FLUSH:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_key(batches):
            for kind, r, b in rows:
                if kind == 1:  # found within a slice: on to the document
                    yield blob_row(key, r, b)
            e, own = _unpack([(r, b) for k, r, b in rows if k == 0])
            parts = -(-len(own[0]) // MOST)
            which = mix(e[0] + MIXERS[62]) % np.uint64(max(1, parts))
            for p in range(parts):
                some = np.flatnonzero(which == p)
                found = _later(*_sorted(e, own, some[np.lexsort((e[3][some], e[2][some], e[1][some]))]), least)[1]
                if len(found[0]):
                    yield later(found)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches):
            doc, tag, lo, hi = unblob([(r, b) for _, r, b in rows], RANGE)
            order = np.lexsort((lo, tag, doc))
            doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
            text = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))[: len(doc)]
            reach = np.maximum.accumulate((text << 32) | hi)
            new = np.flatnonzero(np.append(True, ((text[1:] << 32) | lo[1:]) > reach[:-1])[: len(doc)])  # ranges that touch are one
            hi = (reach[np.append(new[1:], len(doc))[: len(new)] - 1] & 0xFFFFFFFF).astype(np.uint32)
            doc, tag, lo = doc[new], tag[new], lo[new]
            cut = np.append(np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))), len(doc))
            pair = np.stack([lo, hi], 1).astype("u4")
            for k in range(0, len(cut) - 1, 10_000):
                some = cut[k : k + 10_001]
                yield pa.RecordBatch.from_arrays([pa.array(doc[some[:-1]]), pa.array(tag[some[:-1]].astype(np.int64)),
                    pa.array([pair[a:b].tobytes() for a, b in zip(some[:-1], some[1:], strict=True)], pa.binary())], ["doc_id", "tag", "ranges"])

    meet = lambda df, f, schema: df.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(f), schema)
    entries = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lean(select), BLOBS)
    found = table(meet(entries, join, BLOBS), "ranges")
    spark.range(1).count()  # until the next event, the listener bus holds the last execution
    gc(spark)  # Spark may drop the entries' shuffle
    return meet(found, gather, "doc_id long, tag long, ranges binary")


def cut(text: str, ranges_: bytes) -> tuple[str, int, int, int]:
    """A text without the words in its ranges; its number of words, of words deleted, and of passages these make. White space before a passage at the end goes with it."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, _, _, _ = words(data, np.array([0, len(data)]), NONSPACE)
    depth = np.zeros(len(starts) + 1, np.int64)
    r = np.frombuffer(ranges_, "u4").reshape(-1, 2).astype(np.int64)
    np.add.at(depth, r[:, 0], 1)
    np.add.at(depth, r[:, 1], -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])))
    out, last, gone = [], 0, 0
    for a, b in zip(edge[0::2], edge[1::2], strict=True):
        out.append(raw[last : starts[a]])
        last = int(starts[b]) if b < len(starts) else len(raw)
        gone += int(b - a)
    left = b"".join([*out, raw[last:]])
    return (left.rstrip(b" \t\n\v\f\r") if last == len(raw) else left).decode(), len(starts), gone, len(edge) // 2


def dedup(docs: DataFrame, words: int = WORDS, line: int = LINE) -> DataFrame:
    """docs (doc_id, text and others) with text less its repeated runs of at least `words` words and lines of at least `line`, and n_words, n_removed (words) and n_runs of the text as it was."""
    keep = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "n_runs")]
    found = ranges(docs, words, line)
    left = docs.select(F.struct(*(named(c).alias(f"c{k}") for k, c in enumerate(keep))).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
        F.col("text").cast("string").alias("text"), F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("_tag"))
    right = found.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "ranges")
    joined = left.join(right, ["_id", "_tag"], "left").select("row", "text", "ranges")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            done = [cut(t, r) if r and t else (t, len((t or "").encode().split()), 0, 0) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0),
                *(pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True))],
                ["row", "text", "n_words", "n_removed", "n_runs"])

    row = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(lean(run), f"row {row}, text string, n_words long, n_removed long, n_runs long")
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.c{keep.index(c)}").alias(c) for c in docs.columns if c not in ("n_words", "n_removed", "n_runs")),
        "n_words", "n_removed", "n_runs")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, words of the text, words deleted, runs deleted, and the SHA-256 of the text that stays."""
    out = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
