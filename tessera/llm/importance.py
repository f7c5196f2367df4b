"""Importance resampling towards a target distribution of hashed word n-grams.

The texts are read once. Each task keeps an integer dictionary of the words it met: a text is a row of word ids, an n-gram a tuple of
ids, and each distinct tuple's words are put together and hashed once for as long as the dictionary lives; its counts are joined back by
the tuple's number. What leaves a task is, for each document, its distinct buckets with their counts, and for each partition one vector
of bucket counts. Gains of the buckets (a fixed number of them) are computed from the sums over all documents and all target texts, a
document's weight is the mean gain of its features, and a document's chance is a Gumbel noise made from its id, so that the highest
scores are a draw without replacement that comes out alike in every run.

The draw needs no global window: the cut-off is found in a histogram of the integer scores, only documents at or above it are sorted,
by ranges, and a rank is the number of rows in earlier ranges and the place within the range.

Cases: null and empty texts have no features and weight 0; a null doc_id is the empty text in the noise; scores tie towards smaller
doc_ids, null ones last; repeated rows are documents of their own; other columns are ignored; an empty table gives no rows, an empty
target leaves every gain at what the counts of the documents alone make it."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ALNUM, LOWER, documents, lean, table, texts, words

BUCKETS = 10_000
N_GRAM = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: A task's dictionary starts anew beyond this number of tuples: memory is bounded and results are the same.
KEPT = 1 << 20

_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary()), ("totals", pa.list_(pa.int64()))])


class Dictionary:
    """Integer ids of words and, for each distinct tuple of ids, the bucket of its bytes."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.ids, self.names, self.known = buckets, {}, [], {}

    def word_ids(self, distinct: list[bytes]) -> np.ndarray:
        if len(self.known) > KEPT or len(self.ids) > KEPT:
            self.ids, self.names, self.known = {}, [], {}
        out = np.empty(len(distinct), np.int64)
        for k, w in enumerate(distinct):
            n = self.ids.setdefault(w, len(self.names))
            if n == len(self.names):
                self.names.append(w)
            out[k] = n
        return out

    def bucket(self, ids: tuple[int, ...]) -> int:
        b = self.known.get(ids)
        if b is None:
            b = self.known[ids] = zlib.crc32(b" ".join([self.names[i] for i in ids])) % self.buckets
        return b


def tuples(ids: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of n consecutive ids within a text: the distinct tuples, the number of each run's tuple, and the place where each run starts."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(ids))  # words from here to the text's end
    at = np.flatnonzero(left >= n)
    number, distinct = ids[at], None
    for j in range(1, n):  # tuples of j + 1 words are pairs of a tuple of j and a word
        base = int(ids.max(initial=0)) + 1
        number = np.unique(number, return_inverse=True)[1] * base + ids[at + j]
    _, where, number = np.unique(number, return_index=True, return_inverse=True)
    distinct = np.stack([ids[at[where] + j] for j in range(n)], axis=1) if len(at) else np.zeros((0, n), np.int64)
    return distinct, number, at


def features(docs: DataFrame, n_gram: int = N_GRAM, buckets: int = BUCKETS) -> DataFrame:
    """A row for each document (doc_id, n_words, n_features, and buckets: two rows of unsigned 32-bit numbers, the distinct buckets and their counts), and one with totals for each partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Dictionary(buckets), np.zeros(buckets, np.int64)
        for part, data, offsets in texts(batches):
            starts, ends, _, first = words(data, offsets, ALNUM)
            low = LOWER[data]
            inside = np.zeros(len(low) + 1, np.int32)
            inside[starts] += 1
            np.subtract.at(inside, ends, 1)
            letters = low[np.cumsum(inside[:-1]) > 0]
            sizes = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(ends - starts, out=sizes[1:])
            coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode()
            ids = known.word_ids(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
            docs_, which = [], []
            for n in range(1, n_gram + 1):
                distinct, number, at = tuples(ids, first, n)
                hashed = np.fromiter(map(known.bucket, map(tuple, distinct.tolist())), np.int64, len(distinct))
                which.append(hashed[number])
                docs_.append(np.searchsorted(first, at, "right") - 1)
            doc, bucket = np.concatenate(docs_), np.concatenate(which)
            total += np.bincount(bucket, minlength=buckets)
            rows = len(offsets) - 1
            pairs, counts = np.unique(doc * buckets + bucket, return_counts=True)
            cuts = np.searchsorted(pairs, np.arange(rows + 1) * buckets)
            b, c = (pairs % buckets).astype("<u4"), counts.astype("<u4")
            packed = [b[x:y].tobytes() + c[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pc.cast(part.column(0), pa.int64()), pa.array(np.diff(first), pa.int64()),
                pa.array(np.bincount(doc, minlength=rows), pa.int64()), pa.array(packed, pa.binary()), pa.nulls(rows, pa.list_(pa.int64()))], schema=_FEATURES)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()),
            pa.array([total.tolist()], pa.list_(pa.int64()))], schema=_FEATURES)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lean(run), "doc_id long, n_words long, n_features long, buckets binary, totals array<bigint>")


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of all buckets: one number for each of a fixed number of buckets."""
    out = np.zeros(buckets, np.int64)
    for r in found.where("totals IS NOT NULL").select(F.posexplode("totals").alias("b", "n")).groupBy("b").agg(F.sum("n").alias("n")).where("n > 0").collect():
        out[r.b] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, where B is the number of buckets."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of the gains of a document's features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column(3).to_pylist():
                x = np.frombuffer(blob, "<u4").reshape(2, -1).astype(np.int64)
                n = int(x[1].sum())
                out.append(int((gain[x[0]] * x[1]).sum()) // n if n else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return found.where("buckets IS NOT NULL").select("doc_id", "n_words", "n_features", "buckets").mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def noised(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """The weights with score: weight and a Gumbel noise of the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def draw(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """All rows of a written table of scores with rank, from 1, of the drawn ones: the highest scores of so many per cent of the documents with enough words."""
    spark = scored.sparkSession
    able = F.col("n_words") >= least
    histogram = sorted(((r.score, r.n) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)  # integer scores: their number is bounded by the formula
    take = percent * sum(n for _, n in histogram) // 100
    cut, seen = None, 0
    for score, n in histogram:
        if seen >= take:
            break
        cut, seen = score, seen + n
    high = able & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), seen // 10_000 + 1))
    top = table(scored.where(high).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "top")
    before, sizes = 0, {r.p: r.n for r in top.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # a number for each partition
    starts = {}
    for p in sorted(sizes):
        starts[p], before = before, before + sizes[p]
    offsets = spark.createDataFrame(sorted(starts.items()), "p long, before long")
    rank = (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    ranked = top.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(offsets), "p", "left").withColumn("rank", F.when(rank <= take, rank)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~F.coalesce(high, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, n_gram: int = N_GRAM, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of docs (doc_id, text), drawn towards the texts of target."""
    found = table(features(docs, n_gram, buckets), "features")
    aim = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n_gram, buckets)
    gain = gains(totals(found, buckets), totals(aim, buckets))
    return draw(table(noised(weighed(found, gain), seed), "scores"), percent, least)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
