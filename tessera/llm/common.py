"""Helpers shared by the corpus operators: scratch tables, text chunks, vectorised word hashing and balanced blob shuffles."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names. Where none is set, a session on one machine gets a folder of its own; a cluster has no such folder, so that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(base)  # the setting itself can't be changed while a session runs
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex[:12]}/{name}"


def named(column: str):
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores before it until no column has it (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def table(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tessera_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables made by table() that nothing reads any more, and let Spark drop the shuffles behind them."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, getattr(df, "_tessera_path", None)
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p.getParent(), True)
    if frames:
        gc(frames[0].sparkSession)


def gc(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of frames that are gone."""
    import gc as python

    python.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers of which hash partitioning into n partitions puts one into each, so that buckets of equal size make tasks of equal size."""
    found: dict[int, int] = {}
    step, at = 8 * n + 64, 0
    while len(found) < n:
        for r in spark.range(at, at + step).select(F.col("id").cast("int").alias("k"), F.expr(f"pmod(hash(cast(id AS int)), {n})").alias("p")).collect():
            found.setdefault(r.p, r.k)
        at += step
    return [found[p] for p in range(n)]


def texts(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most so many bytes of text (one row at least): the slice, its bytes, the offsets of its texts.

    The column is named text; nulls are empty texts."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("text"))
        if col.null_count:
            col = col.fill_null("")
        col = col.cast(pa.large_string())
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, len(col))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_STEP = (_RNG.integers(0, 2**64, 1, np.uint64)[0] & ~np.uint64(7)) | np.uint64(5)
_STEP_INVERSE = np.uint64(pow(int(_STEP), -1, 2**64))
MIXERS = _RNG.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower case
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NONSPACE = np.ones(256, bool)  # [^\x20\x09-\x0D]
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, step in enumerate((_STEP, _STEP_INVERSE)):
            full = np.full(max(n, 1 << 16), step, np.uint64)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0][:n], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of lower-cased texts that lie one after another in data: start, end, 64-bit hash of each, and each text's first word (with an end)."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = kind[low]
    edge = inside[1:] != inside[:-1]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(low))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # two texts touch within words
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(cuts):
        starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
    power, inverse = powers(len(low))
    total = np.empty(len(low) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low] * power, out=total[1:])
    powers(len(low) + 1)
    h = mix((total[ends] - total[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64))
    return starts, ends, h, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, from each word that has n - 1 after it."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out += h[j : len(h) - n + 1 + j] * MIXERS[j]
    return mix(out)


def lean(f):
    """A function for mapInArrow that gives memory back when its task ends: workers live on, and several may wait in an executor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: large arrays go back to the system as soon as they are freed
        except (OSError, AttributeError):  # another C library
            libc = None
        try:
            yield from f(batches)
        finally:
            if len(_POWERS[0]) > 1 << 21:
                _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
            pa.default_memory_pool().release_unused()
            if libc:
                libc.malloc_trim(0)

    return run


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each hash, by its upper half."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


BLOBS = "key int, kind int, rows long, blob binary"
_BLOBS = pa.schema([("key", pa.int32()), ("kind", pa.int32()), ("rows", pa.int64()), ("blob", pa.binary())])


def blobs(buckets: np.ndarray, columns: list[np.ndarray], keys: list[int], kind: int = 0) -> pa.RecordBatch:
    """One row for each bucket with entries: its key and the bytes of its part of each column, one column after another."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.searchsorted(buckets[order], np.arange(len(keys) + 1))
    columns = [c[order] for c in columns]
    full = np.flatnonzero(np.diff(cuts))
    data = [b"".join(np.ascontiguousarray(c[cuts[b] : cuts[b + 1]]).tobytes() for c in columns) for b in full]
    return pa.RecordBatch.from_arrays([pa.array([keys[b] for b in full], pa.int32()), pa.array([kind] * len(full), pa.int32()), pa.array(np.diff(cuts)[full]),
        pa.array(data, pa.binary())], schema=_BLOBS)


def blob_row(key: int, rows: int, blob: bytes, kind: int = 1) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([kind], pa.int32()), pa.array([rows], pa.int64()), pa.array([blob], pa.binary())], schema=_BLOBS)


def unblob(rows: list[tuple[int, bytes]], kinds: list[str]) -> list[np.ndarray]:
    """The columns of some rows of blobs(), put together."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, blob in rows:
        at = 0
        for k, kind in enumerate(kinds):
            parts[k].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) if p else np.zeros(0, kind) for p, kind in zip(parts, kinds, strict=True)]


def by_key(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows of blobs sorted by key: each key with its (kind, rows, blob)."""
    key, held = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(tuple(row))
    if held:
        yield key, held
