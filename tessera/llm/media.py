"""Media columns: ISO base media files as values of a table.

mux() wraps samples in a file of boxes (ftyp, mdat, moov and what moov holds), probe() walks the nested boxes of any such file and
decodes its sample tables: codec, duration and the byte ranges of sync samples come from there, payloads are never decoded.

Cases: a null or empty payload is stored as 64 zero bytes; bytes that are no ISO file, or boxes that end early, give a null codec and no
tracks; extra columns stay out of the result. Equal payloads make equal files."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, table

#: Fixed values of ISO/IEC 14496-12: boxes that hold boxes, with the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
TIMESCALE = 8000
CHUNK = 1 << 16
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    return (struct.pack(">I4s", n, kind) if n < 2**32 else struct.pack(">I4sQ", 1, kind, n + 8)) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """An audio track of 8-bit mono PCM (ISO/IEC 23003-5, ipcm) with a sample for each byte, in chunks of CHUNK samples."""
    n = len(payload)
    wide = n >= 2**32 - 64
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp42")
    head = len(ftyp) + (16 if wide else 8)
    chunks = range(head, head + n, CHUNK)
    full, rest = divmod(n, CHUNK)
    runs = [(1, CHUNK)] * (full > 0) + [(full + 1, rest)] * (rest > 0)
    v, num = (1, ">QQIQ") if wide else (0, ">IIII")
    entry = _box(b"ipcm", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16), _full(b"pcmC", b"\x01\x08"))
    stbl = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, c, 1) for a, c in runs)),
        _full(b"stsz", struct.pack(">II", 1, n)), _full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), np.asarray(chunks, ">u8" if wide else ">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(num, 0, 0, TIMESCALE, n), struct.pack(">HH", 0x55C4, 0), version=v), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ" if wide else ">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=v, flags=3)
    mvhd = _full(b"mvhd", struct.pack(num, 0, 0, TIMESCALE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=v)
    return ftyp + _box(b"mdat", payload) + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the body of each box in a range; stops where a size can't be right."""
    while start + 8 <= end:
        n, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if n == 1:
            if body + 8 > end:
                return
            n, body = struct.unpack_from(">Q", data, body)[0], body + 8
        n = n or end - start
        if n < body - start or start + n > end:
            return
        yield kind, body, start + n
        start += n


def _runs(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.repeat(values.astype(np.int64), counts.astype(np.int64))


def _track(data: memoryview, found: dict[bytes, tuple[int, int]]) -> dict:
    def ints(kind: bytes, skip: int, kind_of: str = ">u4") -> np.ndarray:
        a, b = found[kind]
        return np.frombuffer(data[a + skip : a + skip + (b - a - skip) // int(kind_of[2]) * int(kind_of[2])], kind_of)

    a, _ = found[b"mdhd"]
    timescale, duration = struct.unpack_from(*((">IQ", data, a + 20) if data[a] == 1 else (">II", data, a + 12)))
    codec = bytes(data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16]).decode("latin-1")
    fixed, count = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
    offsets = (ints(b"co64", 8, ">u8") if b"co64" in found else ints(b"stco", 8)).astype(np.int64)
    stsc = ints(b"stsc", 8).reshape(-1, 3).astype(np.int64)
    per = np.repeat(stsc[:, 1], np.diff(np.append(stsc[:, 0], len(offsets) + 1)))  # samples of each chunk
    first = np.cumsum(per) - per
    if fixed and b"stss" not in found:  # every sample is a sync sample and a chunk is one range
        ranges = np.stack([offsets, offsets + per * fixed], 1)
        syncs = count
    else:
        sizes = np.full(count, fixed, np.int64) if fixed else ints(b"stsz", 12)[:count].astype(np.int64)
        ends = np.cumsum(sizes)
        where = np.repeat(offsets - (ends - sizes)[np.minimum(first, max(0, count - 1))], per)[:count] + ends - sizes if count else np.zeros(0, np.int64)
        sync = ints(b"stss", 8).astype(np.int64) - 1 if b"stss" in found else np.arange(count)
        ranges, syncs = np.stack([where[sync], where[sync] + sizes[sync]], 1), len(sync)
    if len(ranges):  # ranges that touch are one
        new = np.append(True, ranges[1:, 0] != ranges[:-1, 1])
        ranges = np.stack([ranges[new, 0], ranges[np.append(np.flatnonzero(new)[1:] - 1, len(ranges) - 1), 1]], 1)
    stts = ints(b"stts", 8).reshape(-1, 2)
    return {"codec": codec, "timescale": timescale, "duration": duration, "samples": count, "chunks": len(offsets),
        "media_time": int((stts[:, 0].astype(np.int64) * stts[:, 1]).sum()), "keyframes": syncs, "ranges": ranges}


def probe(data: bytes) -> list[dict]:
    """The tracks of a file: codec, timescale, duration, samples, chunks, keyframes and the byte ranges of these (those that touch merged)."""
    view, tracks = memoryview(data), []

    def walk(start: int, end: int, found: dict | None) -> None:
        for kind, a, b in boxes(view, start, end):
            if kind == b"trak":
                walk(a, b, own := {})
                if {b"mdhd", b"stsd", b"stsz", b"stsc", b"stts"} <= own.keys() and (b"stco" in own or b"co64" in own):
                    tracks.append(_track(view, own))
            elif kind in CONTAINERS:
                walk(a + CONTAINERS[kind], b, found)
            elif found is not None:
                found[kind] = (a, b)

    walk(0, len(view), None)
    return tracks


def feature(tracks: list[dict]) -> str | None:
    return "|".join(f"codec={t['codec']};timescale={t['timescale']};duration={t['duration']};samples={t['samples']};chunks={t['chunks']};keyframes={t['keyframes']};ranges={','.join(f'{a}-{b}' for a, b in t['ranges'])}" for t in tracks) or None


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media: each text's bytes as an ISO file, written to the shared folder."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch.column(0), batch.column(1).to_pylist()
            at, held, sizes, files = 0, 0, [], []
            for k, value in enumerate(values):
                raw = (value or "").encode()
                sizes.append(len(raw))
                files.append(mux(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")))
                held += len(files[-1])
                if held > 1 << 22 or k == len(values) - 1:
                    yield pa.RecordBatch.from_arrays([keys[at : k + 1], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])
                    at, held, sizes, files = k + 1, 0, [], []

    return table(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary"), "media")


def describe(stored: DataFrame) -> DataFrame:
    """Columns read from stored files: sizes, hashes of file and payload, and what probe() finds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, media in zip(*(c for c in (batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))), strict=True):
                data = media.as_buffer()
                tracks = probe(data)
                view = memoryview(data)
                payload = [view[a:b] for t in tracks for a, b in t["ranges"]]
                sha = hashlib.sha256()
                for p in payload:
                    sha.update(p)
                tail = b"".join(bytes(p[-64:]) for p in payload[-1:])
                rows.append((key, n, sum(map(len, payload)), sha.hexdigest(), zlib.crc32(tail), len(view), hashlib.sha256(view).hexdigest(), feature(tracks)))
            yield pa.RecordBatch.from_pylist([dict(zip(FIELDS.names, r, strict=True)) for r in rows], FIELDS)

    return stored.mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


FIELDS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(documents(spark, sf_dir)))
