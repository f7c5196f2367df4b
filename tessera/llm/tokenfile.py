"""Token-id output by bit-plane shuffling.

A file part holds whole documents in ascending doc_id order: a header, an index of documents, an index of chunks, and the chunks. A chunk is a block of
BLOCK ids, taken as 32-bit words and transposed into planes (4 byte planes, or 32 bit planes), each compressed by zstandard on its own; planes
that are all zero take no bytes. Parts are rows of a table in the shared folder, so any store that Spark writes will do.

Documents are dealt by ranges of doc_id, never gathered; a part closes once it has PART ids, so only a single long document makes a longer one.

Cases: null and empty texts are the end id alone; repeated doc_ids keep all their rows, in order of text; rows without doc_id come first; an empty table
makes no parts and no rows; other columns are ignored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, shuffle_partitions, table
from tessera.llm.encode import WORD, encoder, slices

BLOCK, PART, END, LEVEL = 1 << 16, 1 << 20, 1, 1
MAGIC = b"TBPS"
_HEAD = struct.Struct("<4sBBHIQQI")  # magic, version, bits of a plane's unit, -, block, documents, ids, bytes of the document index


def planes(ids: np.ndarray, bits: int) -> np.ndarray:
    """ids as rows of bytes, one row for each plane."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return np.ascontiguousarray(raw.T)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")


def unplanes(rows: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.ascontiguousarray(rows.T).view("<u4").ravel()
    raw = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def pack(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, bits: int = 8, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """A file part."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    chunks, index = [], []
    for at in range(0, len(ids), block):
        for row in planes(ids[at : at + block], bits):
            data = squeeze(row.tobytes()) if row.any() else b""
            index.append(len(data))
            chunks.append(data)
    docs = squeeze(np.array([k is None for k in keys], np.uint8).tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + np.asarray(sizes, "<i8").tobytes())
    return b"".join([_HEAD.pack(MAGIC, 1, bits, 0, block, len(keys), len(ids), len(docs)), docs, np.array(index, "<u4").tobytes(), *chunks])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, numbers of ids and ids of a file part."""
    magic, version, bits, _, block, n_docs, n_ids, n_index = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token file")
    expand = zstandard.ZstdDecompressor().decompress
    at = _HEAD.size
    docs = expand(data[at : at + n_index])
    keys = np.frombuffer(docs, "<i8", n_docs, n_docs).tolist()
    sizes = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
    keys = [None if gone else k for gone, k in zip(docs[:n_docs], keys, strict=True)]
    at += n_index
    each = 32 // bits
    index = np.frombuffer(data, "<u4", -(-n_ids // block) * each, at)
    at += 4 * len(index)
    ids = np.empty(n_ids, "<u4")
    for k in range(0, len(index), each):
        first = k // each * block
        n = min(block, n_ids - first)
        rows = np.zeros((each, n if bits == 8 else -(-n // 8)), np.uint8)
        for j in range(each):
            if size := int(index[k + j]):
                rows[j] = np.frombuffer(expand(data[at : at + size]), np.uint8)
                at += size
        ids[first : first + n] = unplanes(rows, n, bits)
    return keys, sizes, ids


def write(docs: DataFrame, path: str = WORD, end: int | None = END, bits: int = 8, block: int = BLOCK, part: int = PART) -> DataFrame:
    """File parts of docs (doc_id, text): columns section, part, before (ids of the section ahead of the part), n_ids, data. path: a tokenizers file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, section = encoder(path), TaskContext.get().partitionId()
        keys, sizes, flat, held, before, k = [], [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_pylist([{"section": section, "part": k, "before": before, "n_ids": len(ids), "data": pack(keys, np.array(sizes), ids, bits, block)}])

        tail = np.array([] if end is None else [end], np.uint32)
        for batch in batches:
            all_keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(values):
                ids, at = enc.encode(values[a:b])
                for j in range(b - a):
                    keys.append(all_keys[a + j])
                    flat += [ids[at[j] : at[j + 1]], tail]
                    sizes.append(int(at[j + 1] - at[j]) + len(tail))
                    held += sizes[-1]
                    if held >= part:
                        yield out()
                        keys, sizes, flat, held, before, k = [], [], [], 0, before + held, k + 1
        if keys:
            yield out()

    n = shuffle_partitions(docs.sparkSession)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return table(dealt.mapInArrow(lean(run), "section long, part long, before long, n_ids long, data binary"), "tokens")


def read(parts: DataFrame) -> DataFrame:
    """Documents of file parts: doc_id, start (ids of all documents before), n_tokens, ids (32-bit little-endian)."""
    ahead, total = {}, 0
    for r in parts.groupBy("section").agg(F.sum("n_ids").alias("n")).orderBy("section").collect():  # one row for each section
        ahead[r.section], total = total, total + r.n

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for section, before, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, sizes, ids = unpack(data)
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at[:-1] + ahead[section] + before), pa.array(sizes),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return parts.select("section", "before", "data").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(documents(spark, sf_dir))).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
