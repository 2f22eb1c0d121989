"""Connected components of a graph in Spark, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label`` (smallest node of its component) for the nodes of edges (``src``, ``dst``), long.

    Each round gives every node a random rank, joins it to the neighbour of lowest rank unless its own
    is lower, and rewrites the edges between what is left; stars and paths alike shrink by a constant
    factor, and each edge is read twice a round. Then the rounds' choices are followed from the first to the last.
    Aggregates are partial before each shuffle, and joins have one row per key on one side, so a node
    with very many edges is split like any skewed join. Rounds are written to the shared folder.
    """
    tidy = lambda e, a, b: e.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()
    left = staged(tidy(edges, "src", "dst"), "edges")
    chosen: list[DataFrame] = []
    while left.limit(1).count():
        rank = lambda c: F.xxhash64(c, F.lit(len(chosen)))  # noqa: B023, E731
        near = left.select(F.col("src").alias("node"), F.col("dst").alias("by")).union(left.select("dst", "src"))
        best = near.groupBy("node").agg(F.min_by("by", rank("by")).alias("by"))
        joined = staged(best.select("node", F.when(rank("by") < rank("node"), F.col("by")).otherwise(F.col("node")).alias("into")), "joined")
        chosen.append(joined)
        a, b = joined.select(F.col("node").alias("src"), F.col("into").alias("a")), joined.select(F.col("node").alias("dst"), F.col("into").alias("b"))
        left = staged(tidy(left.join(a, "src").join(b, "dst"), "a", "b"), "edges")
    if not chosen:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    root = chosen[0].select("node", F.col("into").alias("root"))
    for nxt in chosen[1:]:
        root = root.join(nxt.select(F.col("node").alias("root"), "into"), "root", "left").select("node", F.coalesce("into", "root").alias("root"))
    root = staged(root, "roots")
    least = staged(root.groupBy("root").agg(F.min("node").alias("label")), "labels")
    return root.join(least, "root").select("node", "label")
