"""Quality classifier: supervised subword embeddings.

A document's features are hashed words, hashed pairs of successive words and hashed character (byte) 3- and 4-grams. Each feature has a learned vector; a document is the average of
the vectors of all its features, and a softmax layer gives the classes. All is trained by plain stochastic gradient descent in numpy on a bounded sample of labelled documents: the first `rows`
by a hash of doc_id, and of these as many as have at most `size` bytes of features. As the layer is linear, vectors and softmax weights fold into one table of class scores for each
feature, which is all that the driver and the scoring tasks get (its size is fixed): one task trains on the sample. A pair's hash is that of the difference of its words' hashes.

Cases: null and empty texts, which have no features, get the score of the bias alone; labels that are null are left out; a doc_id with several labels or texts is
taken with each; ties in the hash go by doc_id, label and text; without any label of a class the score is that of the prior; repeated rows are scored each and count once in the sample; an
empty table gives no rows; other columns stay as they are, but for those that have the names of the outputs, which are replaced."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import NONSPACE, discard, documents, lean, mix, named, table, texts, words

BITS, DIM, ROWS, EPOCHS, BATCH, RATE, SEED = 16, 12, 4000, 6, 16, 4.0, 7
SAMPLE_BYTES, STEPS = 128 << 20, 600
KINDS = 4  # words, pairs of words, 3-grams, 4-grams
SIZE = KINDS * (1 << BITS)
THRESHOLD, FOLDS = 0.3, 5


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the feature at each place, and each text's first place and end (two rows)."""
    _, _, h, first = words(data, offsets, NONSPACE)
    out = [((h >> np.uint64(64 - BITS)).astype(np.int32), np.stack([first[:-1], first[1:]]))]
    pair = mix(h[1:] - h[:-1]) >> np.uint64(64 - BITS)
    out.append((pair.astype(np.int32) + (1 << BITS), np.stack([first[:-1], np.maximum(first[:-1], first[1:] - 1)])))
    wide = np.zeros(len(data) + 4, np.uint32)
    wide[: len(data)] = data
    code = wide[:-4] | wide[1:-3] << np.uint32(8) | wide[2:-2] << np.uint32(16)
    for k in (3, 4):
        if k == 4:
            code |= wide[3:-1] << np.uint32(24)
        g = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out.append((g.astype(np.int32) + (k - 1 << BITS), np.stack([offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - k + 1)])))
    return out


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct features of each text and their weights: the share among all its features."""
    kinds = features(data, offsets)
    for d in range(len(offsets) - 1):
        u, n = np.unique(np.concatenate([f[at[0, d] : at[1, d]] for f, at in kinds]), return_counts=True)
        yield u.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int = 2, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Folded class scores of each feature, and the bias. Labels that are no class are an error."""
    if len(y) and not 0 <= y.min() <= y.max() < classes:
        raise ValueError(f"labels must be 0 to {classes - 1}, but some are {sorted({int(v) for v in y if not 0 <= v < classes})[:5]}")
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5 / DIM, 0.5 / DIM, (SIZE, DIM)).astype(np.float32)
    out = np.zeros((DIM, classes), np.float32)
    share = np.bincount(y, minlength=classes) + 1.0
    bias = np.log(share / share.sum()).astype(np.float32)
    out += rng.normal(0, 0.5, out.shape).astype(np.float32)
    epochs = max(epochs, -(-STEPS * BATCH // max(1, len(y)))) if len(y) else 0  # small samples are seen more often
    steps, done = epochs * max(1, -(-len(y) // BATCH)), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some, lr = order[at : at + BATCH], rate * (1 - done / steps)
            done += 1
            ids, w = (np.concatenate([x[i][k] for i in some]) for k in (0, 1))
            sizes = np.array([len(x[i][0]) for i in some])
            rows = np.repeat(np.arange(len(some)), sizes)
            u, inverse = np.unique(ids, return_inverse=True)
            grid = np.zeros((len(some), len(u)), np.float32)  # documents by features of the batch
            grid[rows, inverse] = w
            hidden = grid @ vectors[u]
            z = hidden @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ out.T
            out -= lr * 0.25 * (hidden.T @ p)
            bias -= lr * 0.05 * p.sum(0)
            vectors[u] -= lr * 8 * (grid.T @ back)
    return vectors @ out, bias


def _sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The sample's rows (doc_id, label, hash, ids, w) in no order, and the table that they are read from: labelled documents outside the held-out fold in the order of a hash of doc_id,
    at most `rows` of them and `size` bytes of their features."""
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"),
        F.col(label).cast("int").alias("label")).distinct()
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)  # no more labels can be used

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in texts(batches):
            for d, (ids, w) in enumerate(counted(data, offsets)):
                yield pa.RecordBatch.from_arrays([*(part.column(k).slice(d, 1) for k in (0, 1, 3)), pa.array([ids.tobytes()]), pa.array([w.tobytes()]),
                    pa.array([ids.nbytes + w.nbytes])], ["doc_id", "label", "hash", "ids", "w", "size"])

    # at most `rows` rows are broadcast
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), "doc_id").select("doc_id",
        "label", "text", F.xxhash64("text").alias("hash"))
    made = table(joined.mapInArrow(lean(run), "doc_id long, label int, hash long, ids binary, w binary, size long"), "sample")
    order = [F.xxhash64("doc_id"), "doc_id", "label", "hash"]
    keys = made.groupBy("doc_id", "label", "hash").agg(F.first("size").alias("size")).orderBy(*order).limit(rows)
    keys = keys.withColumn("total", F.sum("size").over(Window.orderBy(*order)))  # over at most `rows` small rows
    chosen = keys.where(F.col("total") <= size).select("doc_id", "label", "hash")
    got = made.join(F.broadcast(chosen), ["doc_id", "label", "hash"]).dropDuplicates(["doc_id", "label", "hash"]).select("doc_id", "label", "hash", "ids", "w")
    return got, made


def _examples(rows: Iterable[tuple]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and labels of the sample's rows, in the order of doc_id, label and hash."""
    rows = sorted(rows, key=lambda r: r[:3])
    return [(np.frombuffer(r[3], np.int32), np.frombuffer(r[4], np.float32)) for r in rows], np.array([r[1] for r in rows], np.int64)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS, size: int = SAMPLE_BYTES) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Features and labels of the sample."""
    got, made = _sampled(docs, labels, label, rows, size)
    out = _examples(got.collect())
    discard(made)
    return out


def fitted(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS, size: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """train() on the sample, in a task: the driver gets the model, whose size is fixed, and none of the sample's features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = _examples(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        try:
            (table_, bias), wrong = train(x, y), None
        except ValueError as e:  # for the caller
            table_, bias, wrong = np.zeros(0, np.float32), np.zeros(0, np.float32), str(e)
        yield pa.RecordBatch.from_arrays([pa.array([table_.astype(np.float32).tobytes()]), pa.array([bias.astype(np.float32).tobytes()]), pa.array([wrong], pa.string())], ["scores", "bias", "wrong"])

    got, made = _sampled(docs, labels, label, rows, size)
    model = got.coalesce(1).mapInArrow(lean(run), "scores binary, bias binary, wrong string").first()  # of at most `size` bytes
    discard(made)
    if model is None:  # no row, no task
        return train([], np.zeros(0, np.int64))
    if model.wrong:
        raise ValueError(model.wrong)
    bias = np.frombuffer(model.bias, np.float32)
    return np.frombuffer(model.scores, np.float32).reshape(SIZE, len(bias)), bias


def held_out(key):
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == 0


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], positive: int = 1, output: str = "score") -> DataFrame:
    """All columns of docs (with text) and the probability of a class."""
    table_, bias = model
    rest = np.delete(table_, positive, 1)
    if rest.shape[1] == 1:  # two classes: one number for each feature
        table_, bias = (table_[:, [positive]] - rest), np.array([bias[positive] - bias[1 - positive]])
    shared = docs.sparkSession.sparkContext.broadcast((table_.astype(np.float32), bias))
    keep = [c for c in docs.columns if c != output]
    inner = docs.select(F.col("text").cast("string").alias("text"), *(named(c).alias(f"c{k}") for k, c in enumerate(keep)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, bias = shared.value
        for part, data, offsets in texts(batches):
            kinds = features(data, offsets)
            z = np.zeros((len(offsets) - 1, table_.shape[1]))
            n = np.maximum(1, sum(at[1] - at[0] for _, at in kinds))
            for k in range(table_.shape[1]):
                column = table_[:, k]
                for f, at in kinds:
                    total = np.concatenate([[0.0], np.cumsum(column[f], dtype=np.float64)])
                    z[:, k] += total[at[1]] - total[at[0]]
            z = z / n[:, None] + bias
            if table_.shape[1] == 1:
                p = 1 / (1 + np.exp(-np.clip(z[:, 0], -500, 500)))
            else:
                e = np.exp(z - z.max(1, keepdims=True))
                p = e[:, positive] / e.sum(1)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(p)], [*part.schema.names[1:], "score"])

    schema = StructType(inner.schema.fields[1:]).add("score", "double")
    out = inner.mapInArrow(lean(run), schema)
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), F.col("score").alias(output))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 from the threshold up)."""
    return scored(docs, fitted(docs, labels, label, rows)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = classify(docs, documents(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
