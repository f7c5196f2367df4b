"""Vector expressions and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import spread


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


MOST_QUERIES = 10_000
#: Vectors of at most so many elements are laid out as columns, over which a dot product is compiled; longer ones stay arrays.
WIDEST = 1_024
#: One vector in so many tells first how similar the k best of a query are at least.
FIRST = 32


def search(vectors: DataFrame, queries: DataFrame, key: str, vector: str, query: str, k: int = 3, floor: float = 0.15) -> DataFrame:
    """The k most similar vectors of each query with at least a similarity of `floor`. Queries are taken in blocks of at most MOST_QUERIES rows (or the rows of one query, where
    these are more), each of which meets all vectors, dealt out evenly. A part of the vectors comes first: its k-th best similarity is a bound below which no other pair is kept."""
    few = queries.select(F.col(query), F.col(vector).alias("_q"))
    total, width = few.agg(F.count("*"), F.max(F.size("_q"))).first()
    width = max(width or 0, 0)
    if total <= MOST_QUERIES:
        return _best(vectors, few, key, vector, query, k, floor, width)
    sizes = few.groupBy(query).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    blocks = -(-total // MOST_QUERIES)
    block = lambda: F.pmod(F.xxhash64(query), F.lit(blocks))
    while sizes.groupBy(block()).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > max(MOST_QUERIES, largest):
        blocks *= 2
    found = [_best(vectors, few.where(block() == b), key, vector, query, k, floor, width) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _laid_out(df: DataFrame, vector: str, prefix: str, width: int, *more: str) -> DataFrame:
    """Rows whose vector has a direction, with its size, its norm and its elements as columns without nulls (or as one array of doubles, if it is wide)."""
    a = F.col(vector)
    flat = [F.coalesce(F.get(a, F.lit(i)).cast("double"), F.lit(0.0)).alias(f"{prefix}{i}") for i in range(width)] if width <= WIDEST else [a.cast("array<double>").alias(prefix)]
    usable = df.where(a.isNotNull() & F.forall(a, lambda x: x.isNotNull()))
    return usable.select(*more, F.size(a).alias(f"{prefix}_n"), F.coalesce(norm(a), F.lit(0.0)).alias(f"{prefix}_norm"), *flat).where(f"{prefix}_norm <> 0")


def _best(vectors: DataFrame, few: DataFrame, key: str, vector: str, query: str, k: int, floor: float, width: int) -> DataFrame:
    wanted = _laid_out(few, "_q", "_q", width, query)
    terms = [F.col(f"_q{i}") * F.col(f"_v{i}") for i in range(width)]
    parts = [reduce(Column.__add__, terms[i : i + 64]) for i in range(0, width, 64)]  # no deeper tree than the compiler takes
    product = (reduce(Column.__add__, parts) if parts else F.lit(0.0)) if width <= WIDEST else dot(F.col("_q"), F.col("_v"))
    score = product / F.nullif(F.col("_q_norm") * F.col("_v_norm"), F.lit(0.0))
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)

    def ranked(some: DataFrame, asked: DataFrame, least: Column) -> DataFrame:
        met = spread(some.select(key, vector), key).transform(_laid_out, vector, "_v", width, key)
        near = (F.col("_q_n") - F.col("_v_n") == 0) & (score >= least - 1e-6)  # no equality of columns: a hash join would have a single key
        scored = met.join(F.broadcast(asked), near).select(query, key, F.round(score, 6).alias("score"))
        ranks = scored.withColumn("rank", F.row_number().over(w))
        return ranks.where((F.col("rank") <= k) & (F.col("score") >= floor))  # after the ranks, or all pairs would be rounded within the join

    first = ranked(vectors.where(F.pmod(F.xxhash64(key), F.lit(FIRST)) == 0), wanted, F.lit(floor))
    bounds = first.where(F.col("rank") == k).select(query, F.col("score").alias("_bound"))
    return ranked(vectors, wanted.join(F.broadcast(bounds), query, "left"), F.coalesce("_bound", F.lit(floor)))
