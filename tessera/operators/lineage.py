"""What flows where: the nodes that personal data reaches, by which path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import Store, scratch


def reached(edges: DataFrame, seeds: DataFrame, most: int = 20) -> DataFrame:
    """origin, node, hops and path (an array of nodes) of all nodes that edges (source, target) lead to from seeds (node): of the shortest paths the first in order.

    Semi-naive: each round joins only what the last round found with the edges, and keeps what no earlier round found. So no node comes twice in a path, circles end, and
    a round that finds nothing is the last;
    each round is written, so lineage stays short and a lost executor costs one round. Paths of more than `most` edges are an error, not left out. Null nodes are none;
    edges from a node to itself lead nowhere."""
    spark = edges.sparkSession
    store = Store(spark, scratch(spark, "lineage"))
    run = store.begin()
    kept = lambda df, name: store.frame(store.write(df, name, run))
    e = kept(edges.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").select("source", "target").distinct(), "edges")
    start = seeds.where("node IS NOT NULL").select("node").distinct()
    last = kept(start.select(F.col("node").alias("origin"), "node", F.lit(0).alias("hops"), F.array("node").alias("path")), "hops-0")
    found = last
    for hop in range(1, most + 2):
        step = last.join(e, last["node"] == e["source"]).groupBy("origin", F.col("target").alias("node")).agg(F.min(F.concat("path", F.array("target"))).alias("path"))
        new = step.join(found.select("origin", "node"), ["origin", "node"], "left_anti").select("origin", "node", F.lit(hop).alias("hops"), "path")
        last = kept(new, f"hops-{hop}")
        if last.isEmpty():
            return found.where("hops > 0")
        found = found.unionByName(last)
    raise ValueError(f"paths of more than {most} edges")
