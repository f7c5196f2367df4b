"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, lean, table


def forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task as links of each node to the least one it reaches among them."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    out = [(x, r) for x in up if (r := root(x)) != x]
    for at in range(0, len(out), 50_000):
        x = np.array(out[at : at + 50_000], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and label, the least node of its component, of all nodes but the least ones, from links (a, b)."""
    edges = table(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").mapInArrow(lean(forest), "a long, b long"), "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = table(edges.union(edges.select("b", "a")).toDF("u", "v"), "both")
        least = table(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
        large = table(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least2 = table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(least2.select("a", F.col("m").alias("b")))
        after = table(small.distinct(), "edges")
        discard(both, least, large, least2, edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out._tessera_path = edges._tessera_path  # for discard()
    return out
