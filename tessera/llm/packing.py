"""Best-fit packing by a grouping genetic algorithm.

Documents are encoded and cut into pieces of at most `size` ids, the first piece taking what is left over. A full piece is a sequence of its own. All
others are dealt evenly into shards of about SHARD pieces, so that a task holds a bounded group whatever the corpus. Each shard is packed by ISLANDS islands. An island keeps a population of
packings: crossover injects whole well-filled bins of one parent into another, drops the bins that hold the same pieces again, and best-fits the pieces that these leave over, swapping them
with pieces of open bins where that fills a bin better; mutation empties the worst-filled bins. Bins without free space are settled: they stay out of the search, but for
a sample of them, so an epoch works on the hard part of a
shard. After each epoch an island's best packing moves to the next island of its shard, and the best packing of all islands is kept. An island stops once it has as few
bins as the pieces' total allows.

Then the worst bins of all shards are emptied and their pieces, many times fewer, are dealt into shards and packed again, until they are one shard: what is lost in the end is lost
once for some thousands of shards, not in each.

Cases: null and empty texts are the end id alone; a document whose ids fill pieces exactly has only full ones; repeated rows are packed each and dealt evenly; rows
without doc_id are packed too; an empty table gives no pieces; other columns are ignored."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, table
from tessera.llm.encode import BYTE, encoder, slices
from tessera.llm.tokenfile import crc32

SIZE, END = 1024, 2
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 3, 2, 12, 6
CORE, WORST = 400, 16  # settled bins that stay in the search; bins of a shard that are packed again with those of others


class Room:
    """Open bins by free space, for best fit."""

    def __init__(self, size: int) -> None:
        self.by: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0

    def add(self, bin_: int, free: int) -> None:
        self.by[free].append(bin_)
        self.mask |= 1 << free

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least free space that is enough, and that space."""
        m = self.mask >> need
        if not m:
            return None
        free = need + (m & -m).bit_length() - 1
        bin_ = self.by[free].pop()
        if not self.by[free]:
            self.mask &= ~(1 << free)
        return bin_, free


def best_fit(bins: list[list[int]], free: list[int], items: Iterable[int], sizes: list[int], size: int) -> None:
    """Put items, in their order, where they leave the least space; bins and free are changed."""
    room = Room(size)
    for b, f in enumerate(free):
        if f:
            room.add(b, f)
    for i in items:
        n = sizes[i]
        got = room.take(n)
        if got:
            b, f = got
            bins[b].append(i)
            free[b] = f - n
            if f > n:
                room.add(b, f - n)
        else:
            bins.append([i])
            free.append(size - n)
            if size > n:
                room.add(len(bins) - 1, size - n)


Packing = tuple[list[list[int]], list[int]]


def fitness(packing: Packing) -> tuple[int, int]:
    """Fewer bins first, then free space gathered in few of them."""
    return len(packing[0]), -sum(f * f for f in packing[1])


def exchange(bins: list[list[int]], free: list[int], loose: list[int], sizes: list[int]) -> list[int]:
    """Swap loose pieces with one or two smaller ones of a bin that they fill better; what is loose then."""
    by_size: dict[int, list[int]] = {}
    for i in loose:
        by_size.setdefault(sizes[i], []).append(i)
    for b, items in enumerate(bins):
        if not free[b] or not by_size:
            continue
        pairs = [(j,) for j in items] + [(items[x], items[y]) for x in range(min(len(items), 8)) for y in range(x)]
        best = None
        for out in pairs:
            have = sum(sizes[j] for j in out)
            for gain in range(free[b], 0, -1):  # the larger the piece that fits, the better
                if best and gain <= best[0]:
                    break
                if by_size.get(have + gain):
                    best = (gain, out)
                    break
        if best:
            gain, out = best
            n = sum(sizes[j] for j in out) + gain
            items.append(by_size[n].pop())
            if not by_size[n]:
                del by_size[n]
            for j in out:
                items.remove(j)
                by_size.setdefault(sizes[j], []).append(j)
            free[b] -= gain
    return [i for x in by_size.values() for i in x]


def refill(bins: list[list[int]], free: list[int], loose: list[int], sizes: list[int], size: int) -> Packing:
    if bins and len(loose) <= 256:
        loose = exchange(bins, free, loose, sizes)
    best_fit(bins, free, sorted(loose, key=sizes.__getitem__, reverse=True), sizes, size)
    return bins, free


def tighten(a: Packing, sizes: list[int], size: int, rounds: int = 12) -> Packing:
    """a with its emptiest bins spread over the free space of the others by chains of swaps, as long as that saves a bin."""
    while len(a[0]) > 1:
        k = a[1].index(max(a[1]))
        bins, free = [list(x) for j, x in enumerate(a[0]) if j != k], [f for j, f in enumerate(a[1]) if j != k]
        loose = list(a[0][k])
        for _ in range(rounds):
            before = sum(sizes[i] for i in loose)
            loose = exchange(bins, free, loose, sizes)
            if not loose or sum(sizes[i] for i in loose) == before:
                break
        best_fit(bins, free, sorted(loose, key=sizes.__getitem__, reverse=True), sizes, size)
        if len(bins) >= len(a[0]):
            return min(a, (bins, free), key=fitness)
        a = bins, free
    return a


def crossover(a: Packing, b: Packing, sizes: list[int], size: int, rng: random.Random) -> Packing:
    """a with some well-filled bins of b."""
    well = sorted(range(len(b[0])), key=b[1].__getitem__)[: max(1, len(b[0]) // 2)]
    chosen = rng.sample(well, max(1, len(well) // 3))
    taken = {i for k in chosen for i in b[0][k]}
    bins, free, loose = [list(b[0][k]) for k in chosen], [b[1][k] for k in chosen], []
    for items, f in zip(*a, strict=True):
        if taken.isdisjoint(items):
            bins.append(list(items))
            free.append(f)
        else:
            loose += [i for i in items if i not in taken]
    return refill(bins, free, loose, sizes, size)


def mutate(a: Packing, sizes: list[int], size: int, rng: random.Random) -> Packing:
    worst = set(sorted(range(len(a[0])), key=a[1].__getitem__, reverse=True)[: max(1, len(a[0]) // 20)]) | set(rng.sample(range(len(a[0])), max(1, len(a[0]) // 50)))
    keep = [k for k in range(len(a[0])) if k not in worst]
    return refill([list(a[0][k]) for k in keep], [a[1][k] for k in keep], [i for k in worst for i in a[0][k]], sizes, size)


def evolve(sizes: list[int], size: int, seed: int, elites: list[Packing], generations: int = GENERATIONS, population: int = POPULATION, core: int = CORE) -> Packing:
    """An island's epoch: its best packing."""
    rng, least = random.Random(seed), max(1, -(-sum(sizes) // size))
    elites = elites or [refill([], [], list(range(len(sizes))), sizes, size)]
    start = min(elites, key=fitness)
    if len(start[0]) <= least or not sizes:
        return start
    full = [k for k, f in enumerate(start[1]) if not f]
    again = set(rng.sample(full, min(len(full), core)))
    settled = [k for k in full if k not in again]
    part = [k for k in range(len(start[0])) if start[1][k] or k in again]
    items = [i for k in part for i in start[0][k]]
    place = {i: j for j, i in enumerate(items)}
    own = [sizes[i] for i in items]  # the hard part is an instance of its own
    least = max(1, -(-sum(own) // size))
    pool: list[Packing] = [tighten(([[place[i] for i in start[0][k]] for k in part], [start[1][k] for k in part]), own, size)]
    for e in elites:
        if e is not start and all(i in place for x in e[0] for i in x):
            pool.append(([[place[i] for i in x] for x in e[0]], list(e[1])))
    while len(pool) < population:
        noisy = sorted(range(len(own)), key=lambda i: own[i] * rng.uniform(0.8, 1.2), reverse=True)
        bins: list[list[int]] = []
        best_fit(bins, free := [], noisy, own, size)
        pool.append((bins, free))
    for _ in range(generations):
        pool.sort(key=fitness)
        if len(pool[0][0]) <= least:
            break
        a, b = pool[0], pool[rng.randrange(1, len(pool))] if len(pool) > 1 else pool[0]
        pool += [crossover(a, b, own, size, rng), crossover(b, a, own, size, rng), mutate(a, own, size, rng), mutate(b, own, size, rng)]
        pool = sorted(pool, key=fitness)[:population]
    best = min(pool, key=fitness)
    if len(best[0]) > least:
        best = tighten(best, own, size)
    return [start[0][k] for k in settled] + [[items[j] for j in x] for x in best[0]], [0] * len(settled) + best[1]


def pieces(docs: DataFrame, path: str = BYTE, size: int = SIZE, end: int | None = END) -> DataFrame:
    """doc_id, piece, start, length and ids of each piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([] if end is None else [end], np.uint32)
        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(values):
                ids, at = enc.encode(values[a:b])
                rows = []
                for j in range(b - a):
                    own = np.concatenate([ids[at[j] : at[j + 1]], tail])
                    cuts = [0, *range(len(own) % size or min(size, len(own)), len(own) + 1, size)]
                    rows += [(keys[a + j], k, p, q - p, crc32(own[p:q]), np.ascontiguousarray(own[p:q], "<u4").tobytes()) for k, (p, q) in enumerate(zip(cuts, cuts[1:], strict=False)) if q > p]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c,
                    t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


_ISLAND = "shard long, island int, sizes array<int>, bins array<array<int>>"


def _epoch(seed: int, size: int, generations: int, population: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = r["sizes"]
                elites = [(e, [size - sum(sizes[i] for i in x) for x in e]) for e in (r["bins"], r["other"]) if e]
                best = evolve(sizes, size, hash((seed, r["shard"], r["island"])), elites, generations, population)
                yield pa.RecordBatch.from_pylist([{"shard": r["shard"], "island": r["island"], "sizes": sizes, "bins": best[0]}],
                    pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bins", pa.list_(pa.list_(pa.int32())))]))

    return run


def _world(grouped: DataFrame, parts: int, size: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """shard and its best bins, from shard and items."""
    world = grouped.select("shard", F.expr("transform(items, x -> cast(x.length AS int))").alias("sizes"))
    world = world.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))
    world = world.withColumn("bins", F.lit(None).cast("array<array<int>>")).withColumn("other", F.lit(None).cast("array<array<int>>"))
    for k in range(epochs):
        world = table(world.select("shard", "island", "sizes", "bins", "other").repartition(parts, "shard", "island").mapInArrow(lean(_epoch(k, size, generations, population)), _ISLAND), "islands")
        elite = world.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("other"))
        world = world.join(elite, ["shard", "island"])  # the elite of the island before
    return world.groupBy("shard").agg(F.min_by("bins", F.struct(F.size("bins"), "island")).alias("bins"))


def pack(cut: DataFrame, size: int = SIZE, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION,
    worst: int = WORST) -> DataFrame:
    """cut (doc_id, piece, length and more; a table that can be read again) with sequence_id and offset."""
    columns = cut.columns
    order = ["length", *[c for c in columns if c != "length"]]
    full = cut.where(F.col("length") == size).withColumn("sequence_id", F.monotonically_increasing_id() * 64).withColumn("offset", F.lit(0).cast("long"))
    level, todo, done = 1, cut.where(F.col("length") < size), [full]
    count = todo.count()
    while True:
        shards = max(1, -(-count // shard))
        # a row's number in its partition deals equal rows as evenly as others; each row is read once, so it may depend on the run
        dealt = todo.withColumn("shard", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33) * 7919, F.lit(shards)))
        grouped = table(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("items")), "shards")  # about `shard` pieces in a group
        best = _world(grouped, min(shards * islands, 20_000), size, islands, epochs, generations, population)
        packed = table(grouped.join(best, "shard").select("shard", "items", "bins").mapInArrow(lean(_place(columns, size, level, worst if shards > 1 else 0)), _placed(cut)), "packed")
        done.append(packed.where("sequence_id IS NOT NULL"))
        if shards == 1:
            break
        todo, level = packed.where("sequence_id IS NULL").drop("sequence_id", "offset"), level + 1
        left = todo.count()
        if left >= count:  # tiny shards: nothing is gained by packing again
            worst = 0
        count = left
        if not count:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _placed(cut: DataFrame) -> str:
    return f"{', '.join(f'{c} {t}' for c, t in cut.dtypes)}, sequence_id long, offset long"


def _place(columns: list[str], size: int, level: int, worst: int):
    """Rows of (shard, items, bins): every piece with its sequence and offset; those of a shard's worst bins without, to be packed again."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                items, bins = batch.column(1)[r].values, batch.column(2)[r].as_py()
                lengths = items.field("length").to_numpy()
                room = [size - int(lengths[b].sum()) for b in bins]
                again = set(sorted((k for k in range(len(bins))), key=room.__getitem__, reverse=True)[:worst]) if any(room) else set()
                flat = np.array([i for b in bins for i in b], np.int64)
                n = np.array([len(b) for b in bins], np.int64)
                taken = items.take(pa.array(flat))
                sizes, which = lengths[flat], np.repeat(np.arange(len(bins)), n)
                ends = np.cumsum(sizes)
                begin = (ends - sizes)[np.cumsum(n) - n] if len(n) else ends
                loose = np.isin(which, list(again))
                number = ((np.int64(batch.column(0)[r].as_py()) << np.int64(20)) + which) * 64 + level
                yield pa.RecordBatch.from_arrays([*(taken.field(c) for c in columns), pa.array(number, mask=loose),
                    pa.array(ends - sizes - np.repeat(begin, n), mask=loose)], [*columns, "sequence_id", "offset"])

    return place


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(pieces(documents(spark, sf_dir)).drop("ids"), "pieces"))
