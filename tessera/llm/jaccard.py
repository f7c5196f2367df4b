"""N-gram Jaccard join by PartEnum signatures.

A document's set holds the hashes of its distinct 5-word shingles. Sizes fall into bands [l, 4l/3], so that sets with a Jaccard similarity of 3/4 lie in one band or in
neighbours; instance j covers bands j-1 and j, and two sets of one instance differ in at most d = (s + t) / 7 elements. Each instance partitions the feature domain by a
hash into n > d / 2 partitions, so similar sets differ in one element at most in some of them; each partition has PARTS parts, and every subset of all of its parts but one is
enumerated: a set's projection on the subset, salted with its place, is a signature. Sets that differ in one element of a partition agree in the subset without that
element's part, in none they agree in all. So similar sets share
one signature at least, and `need` = max(3n - 2d, 2n - d) of them in all: n has a margin so that this is more than one. Empty projections say nothing, so a set with fewer
than `need` projections that aren't empty also takes part under further partitionings.

Signatures meet in buckets by their hash. Groups of at most FEW sets give their pairs. Larger groups (common passages, large families of copies) give none, but count against
the `need` of their members: a set that has signatures to spare needs none of its frequent ones. The others meet again among themselves, first each with the
most central set of its groups only (that with the most frequent signatures). Once components are known, those sets
that lie outside the largest component of their family (sets that share signatures, directly or not) are searched for in the rest of it, block by block, with an index
of their features. So no large group gives all its pairs and no document is parted from its group. Candidate pairs are verified by their whole sets. Equal sets are one
class throughout and are never paired.

Cases: null, empty and wordless texts have no shingles and no links; a text of fewer than five words is one shingle; repeated rows are one class; the least doc_id names a
component, rows without doc_id take part but never name one; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BLOBS, MIXERS, NONSPACE, bucket_keys, bucket_of, by_key, discard, documents, gc, grams, lean, mix, shuffle_partitions, table, texts, words
from tessera.llm.graph import components

SHINGLE = 5
PARTS = 3
FEW = 8
SEEDS = 6
FLUSH = 1_000_000
BLOCK = 2000
BLOCK_BYTES = 64 << 20  # of the queries of a block, which a task holds
FAR = 1 << 40
FILTER_BITS = 23
LOWS = [1]
while LOWS[-1] < 1 << 40:
    LOWS.append(LOWS[-1] * 4 // 3 + 1)
LOWS = np.array(LOWS, np.int64)
HIGHS = LOWS * 4 // 3


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of some texts one after another, and their number for each text."""
    _, _, h, first = words(data, offsets, NONSPACE)
    g = grams(h, n)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for d in range(len(offsets) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            x = x[np.append(True, x[1:] != x[:-1])]
        elif b > a:
            x = mix((h[a:b] * MIXERS[40 : 40 + b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            continue
        out.append(x)
        sizes[d] = len(x)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), sizes


def classes(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets * MIXERS[50]))])
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * MIXERS[51]) | np.uint64(1), np.uint64(0))


def partitions(high: np.ndarray) -> np.ndarray:
    """Partitions of an instance, by the largest size in it: as many as make similar sets share about a seventh of the differences they can have, and two more, as a margin for empty and frequent projections."""
    d = 2 * high // 7
    return np.where(d > 0, (d + 3 + d * 15 // 100) // 2, 1)


def needed(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Signatures that two sets share at least which differ in d elements: of n partitions each without a difference gives three and each with one gives one."""
    return np.maximum(3 * n - 2 * d, 2 * n - d)


def signatures(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sets: signature hashes, the set of each, whether it belongs to the set's own band (else the next one), and what each set can spare in both (two rows)."""
    band = np.searchsorted(LOWS, np.maximum(sizes, 1), "right") - 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    spare = np.zeros((2, len(sizes)), np.int64)
    value = mix(sets * MIXERS[52])
    for role in (0, 1):  # the own band, then the next
        instance = band + role
        n = partitions(HIGHS[instance])
        need = needed(n, (sizes + np.minimum(sizes * 4 // 3, HIGHS[instance])) // 7)
        todo = sizes > 0
        for seed in range(SEEDS + 1):
            some = np.where(todo, n * PARTS, 0)
            base = np.cumsum(some) - some
            pick = todo[doc]
            d, x = doc[pick], sets[pick]
            at = base[d] + (((mix(x ^ MIXERS[10 + seed]) >> np.uint64(32)) * (n[d] * PARTS).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            count = int(some.sum())
            part = np.zeros(count, np.uint64)
            np.add.at(part, at, value[pick])
            held = np.bincount(at, minlength=count)
            whole, held_in = (np.repeat(c.reshape(-1, PARTS).sum(1), PARTS) for c in (part, held))
            total, full = whole - part, held_in > held  # of each subset: all parts of the partition but one
            owner = np.repeat(np.arange(len(sizes)), some)
            place = np.arange(count) - base[owner]
            empty = np.bincount(owner[~full], minlength=len(sizes))
            if seed == 0:
                spare[role] = need - empty
            show = full if seed < SEEDS else np.ones(count, bool)  # at last, empty projections too
            salt = (instance[owner].astype(np.uint64) * MIXERS[53] + place.astype(np.uint64)) * MIXERS[54] + np.uint64(seed)
            out.append((mix(total + mix(salt))[show], owner[show], np.full(int(show.sum()), role == 0)))
            todo = todo & (empty >= need)
            if not todo.any():
                break
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), spare)


#: A blob: number of sets; their classes, sizes, spares (own, next) and components; then for each entry the lower half of its signature and its set, doubled, plus 1 for the next band.
_SETS = [("u8", 8), ("u4", 4), ("i4", 4), ("i4", 4), ("i8", 8)]


def _pack(sig: np.ndarray, owner: np.ndarray, own: np.ndarray, info: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
    bucket = bucket_of(sig, len(keys))
    order = np.lexsort((owner, bucket))
    bucket, owner, own, low = bucket[order], owner[order], own[order], sig[order].astype(np.uint32)
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])) if len(bucket) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    cuts = np.searchsorted(bucket, np.arange(len(keys) + 1))
    full = np.flatnonzero(np.diff(cuts))
    data = []
    for b in full:
        s, e = cuts[b], cuts[b + 1]
        sets = owner[s:e][new[s:e]]
        ref = ((number[s:e] - number[s]) * 2 + ~own[s:e]).astype("u4" if len(sets) > 32_000 else "u2")
        data.append(b"".join([np.array([len(sets), ref.itemsize], "u4").tobytes(), *(c[sets].astype(t).tobytes() for c, (t, _) in zip(info, _SETS, strict=True)), low[s:e].tobytes(), ref.tobytes()]))
    return pa.RecordBatch.from_arrays([pa.array([keys[b] for b in full], pa.int32()), pa.array([0] * len(full), pa.int32()), pa.array(np.diff(cuts)[full]),
        pa.array(data, pa.binary())], ["key", "kind", "rows", "blob"])


def _unpack(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of all entries of a bucket: lower halves of the signatures, and their sets' numbers doubled, plus 1 for the next band; and of the sets: class, size, spares, component."""
    sigs, refs, infos, base = [], [], [], 0
    for _, n, blob in rows:
        m, width = np.frombuffer(blob, "u4", 2).tolist()
        at, info = 8, []
        for t, w in _SETS:
            info.append(np.frombuffer(blob, t, m, at))
            at += m * w
        sigs.append(np.frombuffer(blob, "u4", n, at))
        refs.append(np.frombuffer(blob, f"u{width}", n, at + 4 * n).astype(np.int64) + 2 * base)
        infos.append(info)
        base += m
    return np.concatenate(sigs), np.concatenate(refs), [np.concatenate(c) for c in zip(*infos, strict=True)]


def _groups(rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...] | None:
    """Entries of the signatures that several classes share, sorted by signature, own band first, each class once; and where each group begins (with an end)."""
    sig, ref, (cls, size, near, far, comp) = _unpack(rows)
    order = np.argsort(sig)
    s = sig[order]
    same = s[1:] == s[:-1]
    keep = order[np.append(False, same) | np.append(same, False)]
    if not len(keep):
        return None
    sig, ref = sig[keep], ref[keep]  # few of all
    sets, own = ref >> 1, ref & 1 == 0
    cls, size, near, far, comp = (c[sets] for c in (cls, size, near, far, comp))
    keep = np.lexsort((cls, ~own, sig))
    new = np.append(True, (sig[keep][1:] != sig[keep][:-1]) | (cls[keep][1:] != cls[keep][:-1]))
    keep = keep[new]
    cut = np.append(np.flatnonzero(np.append(True, sig[keep][1:] != sig[keep][:-1])), len(keep))
    sizes = np.diff(cut)
    own_in = np.add.reduceat(own[keep].astype(np.int64), cut[:-1])
    good = (sizes > 1) & (own_in > 0)  # pairs of two lower bands meet in another instance
    mask = np.repeat(good, sizes)
    keep = keep[mask]
    if not len(keep):
        return None
    return cls[keep], size[keep], np.where(own, near, far)[keep], comp[keep], own[keep], np.concatenate([[0], np.cumsum(sizes[good])])


def _alike(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(s, t).astype(np.int64) >= 3 * np.maximum(s, t).astype(np.int64)


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("need", pa.int64())])
_FOUND = "a long, b long, n long, need long"


def _rows(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs with their number and need; each once."""
    if not len(a):
        return
    order = np.lexsort((b, a))
    a, b, need = a[order], b[order], need[order]
    cut = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    times = np.diff(np.append(cut, len(a)))
    need = need[cut]
    for k in range(0, len(cut), 50_000):
        c = cut[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(a[c].view(np.int64)), pa.array(b[c].view(np.int64)), pa.array(times[k : k + 50_000]), pa.array(need[k : k + 50_000].astype(np.int64))], schema=FOUND)


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: pairs (a, b) of small groups with n, the signatures they share, and need, what they must share;
    and (a, null, n, need) of sets in frequent groups: n of these, need the signatures they can spare."""
    for _, rows in by_key(batches):
        got = _groups(rows)
        if got is None:
            continue
        cls, size, spare, _, own, cut = got
        sizes = np.diff(cut)
        start = np.repeat(cut[:-1], sizes)
        many = np.repeat(sizes > FEW, sizes)
        left, right, need = [], [], []
        at = np.flatnonzero(~many)
        for d in range(1, FEW):  # each with the d-th after it in its group
            ok = at[(at + d < len(cls))]
            ok = ok[(start[ok + d] == start[ok]) & (own[ok] | own[ok + d])]
            ok = ok[_alike(size[ok], size[ok + d])]
            left.append(ok)
            right.append(ok + d)
            need.append(np.maximum(spare[ok], spare[ok + d]))
        a, b = np.concatenate(left), np.concatenate(right)
        swap = cls[a] > cls[b]
        yield from _rows(np.where(swap, cls[b], cls[a]), np.where(swap, cls[a], cls[b]), np.concatenate(need))
        at = np.flatnonzero(many)
        for role in (True, False):  # how often each set is in frequent groups of an instance
            some = at[own[at] == role]
            if len(some):
                v, first, n = np.unique(cls[some], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array([None] * len(v), pa.int64()), pa.array(n * 2 + role),
                    pa.array(spare[some[first]].astype(np.int64))], schema=FOUND)


def _centres(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: links of all members of a group to the one with the largest weight (given in place of the component); need is FAR where sizes are too different."""
    for _, rows in by_key(batches):
        got = _groups(rows)
        if got is None:
            continue
        cls, size, spare, weight, own, cut = got
        sizes = np.diff(cut)
        w = (weight + 1) * own  # in the own band, else it couldn't meet those of the band below
        best = np.maximum.reduceat(w, cut[:-1])
        is_best = np.flatnonzero(w == np.repeat(best, sizes))
        c = np.repeat(is_best[np.searchsorted(is_best, cut[:-1])], sizes)
        ok = cls[c] != cls
        need = np.where(_alike(size[c], size), np.maximum(spare[c], spare), FAR)
        yield from _rows(np.minimum(cls[c], cls)[ok], np.maximum(cls[c], cls)[ok], need[ok])


def _search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components between blocks of a family: rows (family, i, j, side, cls, set, comp) sorted, the side of the queries (0) first in each block."""
    block, queries = None, []
    tokens = owner = sizes = names = comps = None
    for batch in batches:
        found: list[tuple[int, int]] = []
        for family, i, j, side, cls, raw, comp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != (family, i, j):
                block, queries, tokens = (family, i, j), [], None
            x = np.frombuffer(raw, np.uint64)
            if side == 0:
                queries.append((cls, comp, x))
                continue
            if not queries:
                continue
            if tokens is None:
                names, comps, sizes = (np.array(c, np.int64) for c in ([q[0] for q in queries], [q[1] for q in queries], [len(q[2]) for q in queries]))
                tokens, owner = np.concatenate([q[2] for q in queries]), np.repeat(np.arange(len(queries)), sizes)
                order = np.argsort(tokens)
                tokens, owner = tokens[order], owner[order]
            lo, hi = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(queries))
            for k in np.flatnonzero((100 * both >= 75 * (sizes + len(x) - both)) & (comps != comp)):
                found.append((min(cls, int(names[k])), max(cls, int(names[k]))))
        if found:
            pairs = np.array(sorted(set(found)), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _rest(marked: DataFrame, links: bool = False) -> DataFrame:
    """Links between the sets of a family (cls, set, comp, family) that are in different components; with links, all links of the family.

    Those outside the family's largest component are queries against all its sets, in blocks of at most about BLOCK sets on either side and BLOCK_BYTES of queries,
    so that neither pairs nor a family ever gather in one place. A task holds the queries of its block; the other side streams past them."""
    if links:  # each set is a component of its own, so all but one are queries
        marked = marked.withColumn("comp", F.col("cls"))
    count = marked.groupBy("family", "comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("set")).alias("bytes"))
    main = F.max(F.struct("n", "comp", "bytes"))
    total = count.groupBy("family").agg(main.alias("main"), F.sum("n").alias("sets"), (F.sum("n") - main["n"]).alias("queries"), (F.sum("bytes") - main["bytes"]).alias("bytes")).where("queries > 0")
    total = table(total.select("family", F.col("main.comp").alias("main"), F.ceil(F.col("sets") / BLOCK).alias("ni"),
        F.ceil(F.greatest(F.col("queries") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("nj")), "families")
    rows = marked.join(total, "family")
    h = F.xxhash64("cls")
    own = {"i": F.pmod(h, "ni"), "j": F.pmod(h, "nj")}
    asked = rows.where("comp <> main").withColumns({"j": own["j"], "side": F.lit(0), "i": F.explode(F.sequence(F.lit(0), F.col("ni") - 1))})
    all_ = rows.withColumns({"i": own["i"], "side": F.lit(1), "j": F.explode(F.sequence(F.lit(0), F.col("nj") - 1))})
    columns = ["family", F.col("i").cast("long"), F.col("j").cast("long"), "side", "cls", "set", "comp"]
    grid = asked.select(*columns).union(all_.select(*columns))
    n = shuffle_partitions(marked.sparkSession)
    out = table(grid.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j", "side").mapInArrow(lean(_search), "a long, b long"), "rest")
    discard(total)
    return out


def _enter(keys: list[int]):
    """Blobs of the signatures of sets, gathered over slices: a function of a stream of (sets, sizes, components)."""

    def run(stream) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        info: list[list[np.ndarray]] = []
        seen: set[int] = set()
        count = sets_ = 0

        def out() -> pa.RecordBatch:
            return _pack(*(np.concatenate(c) for c in zip(*held, strict=True)), [np.concatenate(c) for c in zip(*info, strict=True)], keys)

        for sets, sizes, comp in stream:
            cls = classes(sets, sizes)
            new = np.zeros(len(cls), bool)
            for k, c in enumerate(cls.tolist()):  # copies within a task's slice enter once
                if c and c not in seen:
                    seen.add(c)
                    new[k] = True
            sets, sizes, cls, comp = sets[np.repeat(new, sizes)], sizes[new], cls[new], comp[new]
            if not len(cls):
                continue
            sig, owner, own, spare = signatures(sets, sizes)
            held.append((sig, owner + sets_, own))
            info.append([cls, sizes, spare[0], spare[1], comp])
            count, sets_ = count + len(sig), sets_ + len(cls)
            if count >= FLUSH:
                yield out()
                held, info, count, sets_, seen = [], [], 0, 0, set()
        if held:
            yield out()

    return run


def _set_rows(batches: Iterable[pa.RecordBatch], wanted: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Classes and sets of the texts whose class may be wanted, each once in a task."""
    seen: set[int] = set()
    for _, data, offsets in texts(batches):
        sets, sizes = shingles(data, offsets, n)
        cls = classes(sets, sizes)
        ends = np.cumsum(sizes)
        bit = (cls >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        hit = np.flatnonzero((wanted[bit >> 3] >> (bit & 7)) & 1 & (cls > 0))
        rows = []
        for k in hit:
            c = int(cls[k])
            if c not in seen:
                seen.add(c)
                rows.append((c - (1 << 64) if c >> 63 else c, sets[ends[k] - sizes[k] : ends[k]].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["cls", "set"])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            ok[k] = 100 * both >= 75 * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], ["a", "b"])


def _wanted(classes_: DataFrame) -> np.ndarray:
    """A filter of 2**FILTER_BITS bits of the classes, whatever their number; what it lets through in vain is dropped by a join."""
    bit = F.shiftrightunsigned("cls", 64 - FILTER_BITS)
    rows = classes_.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, "
        f"cast(shiftrightunsigned(cls, {64 - FILTER_BITS}) % 64 AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows.collect():
        out[r.w] = r.b
    return out.view(np.uint8)


def _sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The sets of some classes."""
    nodes = table(nodes.distinct(), "nodes")
    shared = docs.sparkSession.sparkContext.broadcast(_wanted(nodes))
    found = docs.select("text").mapInArrow(lean(lambda b: _set_rows(b, shared.value, n)), "cls long, set binary").join(nodes, "cls", "left_semi")
    out = table(found.groupBy("cls").agg(F.first("set").alias("set")), "sets")
    shared.unpersist()
    discard(nodes)
    return out


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return table(two.mapInArrow(lean(_verify), "a long, b long"), "links")


def similar(docs: DataFrame, shingle: int = SHINGLE, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, class, component_id, text_hash and family (a class of the component, that of rows without doc_id, too; null without shingles) of docs (doc_id, text).

    With links, n_links too: the number of other classes (different sets) that are similar to the document's, all of them; large families then search each member in all the others."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    parts = shuffle_partitions(spark)
    keys = bucket_keys(spark, parts)

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in texts(batches):
            sets, sizes = shingles(data, offsets, shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(classes(sets, sizes).view(np.int64)), part.column(2)], ["doc_id", "n_shingles", "cls", "text_hash"])

    named = table(docs.mapInArrow(lean(name), "doc_id long, n_shingles long, cls long, text_hash long"), "named")
    reps = table(named.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("rep")), "reps")

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for _, data, offsets in texts(batches):
                sets, sizes = shingles(data, offsets, shingle)
                yield sets, sizes, np.zeros(len(sizes), np.int64)

        yield from _enter(keys)(stream())

    def meet(blobs_: DataFrame, f) -> DataFrame:
        return blobs_.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lean(f), _FOUND)

    found = meet(docs.mapInArrow(lean(enter), BLOBS), _meet)
    found = table(found, "found")
    gc(spark)  # Spark may drop the signatures' shuffle
    # a set that is in frequent groups may share these as well
    frequent = found.where("b IS NULL").select(F.col("a").alias("cls"), (F.col("n") % 2).alias("role"), F.expr("n div 2").alias("n"), "need").groupBy("cls",
        "role").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    frequent = table(frequent, "frequent")
    common = frequent.groupBy("cls").agg(F.max("n").alias("n"))
    tied = table(frequent.where("n >= need").groupBy("cls").agg(F.sum("n").alias("weight")), "tied")
    pairs_ = table(found.where("b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")), "pairs")
    likely = pairs_.where("n < need").join(common.withColumnsRenamed({"cls": "a", "n": "na"}), "a").join(common.withColumnsRenamed({"cls": "b", "n": "nb"}), "b").where("n + least(na, nb) >= need")
    pairs = table(pairs_.where("n >= need").select("a", "b").union(likely.select("a", "b")), "candidates")
    discard(found, pairs_)
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("cls")).union(tied.select("cls")), shingle)
    found_links = _verified(pairs, sets)
    if tied.limit(1).count():

        def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def stream():
                for batch in batches:
                    for at in range(0, batch.num_rows, 256):
                        part = batch.slice(at, 256)
                        raw = part.column(1).to_pylist()
                        yield np.frombuffer(b"".join(raw), np.uint64), np.array([len(r) // 8 for r in raw], np.int64), part.column(2).to_numpy()

            yield from _enter(keys)(stream())

        some = table(sets.join(tied, "cls").select("cls", "set", "weight"), "tied_sets")
        central = meet(some.mapInArrow(lean(again), BLOBS), _centres).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
        central = table(central, "centres")
        tried = table(central.where("2 * n >= need").select("a", "b").join(pairs, ["a", "b"], "left_anti"), "tried")  # a choice for speed only
        parts_ = [found_links, _verified(tried, sets)]
        found_links = table(parts_[0].union(parts_[1]), "links")
        known = lambda df, name: df.select(F.col("node").alias("cls"), F.col("label").alias(name))
        comps, families = components(found_links), components(central)
        marked = some.select("cls", "set").join(known(comps, "comp"), "cls", "left").join(known(families, "family"), "cls", "left")
        marked = table(marked.select("cls", "set", F.coalesce("comp", "cls").alias("comp"), F.coalesce("family", "cls").alias("family")), "marked")
        parts_ += [found_links, _rest(marked, links)]
        found_links = table(parts_[2].union(parts_[3]).distinct(), "links")
        discard(some, central, tried, comps, families, marked, *parts_)
    label = components(found_links)
    ids = label.join(reps.withColumnRenamed("cls", "node"), "node").select(F.col("label").alias("cls"), "rep").union(reps)
    least = ids.join(label.select("label").distinct().withColumnRenamed("label", "cls"), "cls", "left_semi").groupBy("cls").agg(F.min("rep").alias("component"))
    of = label.join(least.withColumnRenamed("cls", "label"), "label").select(F.col("node").alias("cls"), "component", "label").union(least.select("cls", "component", "cls"))
    info = reps.join(of, "cls", "left").select("cls", F.coalesce("component", "rep").alias("component"), F.coalesce("label", "cls").alias("family"))
    if links:
        degree = found_links.select(F.least("a", "b").alias("a"),
            F.greatest("a", "b").alias("b")).distinct().select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
        info = info.join(degree, "cls", "left")
    info = table(info, "info")
    discard(sets, pairs, frequent, tied, found_links, label, reps)  # only `named` and `info` are read from here on
    return named.join(info, "cls", "left").select("doc_id", "n_shingles", F.col("cls").alias("class"),
        *([F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if links else []), F.coalesce("component", "doc_id").alias("component_id"), "text_hash",
        "family")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
