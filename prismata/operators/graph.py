"""Graph operators over edge tables (src, dst[, w])."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder that spark.checkpoint.dir names, a local one where it is unset."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="prismata-"))
    return df.checkpoint()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex with an edge to another; the component is its smallest id.

    Each round sends every vertex to the first of itself and its neighbours, and from there once more, and draws the edges
    anew between where their ends went; what is left is smaller, and nothing is left of stars around their smallest id after
    one round. Odd rounds order vertices by hash, so that long paths lose a share of their vertices as well. Sums are made
    map-side before a vertex's rows meet, which keeps hubs cheap; each round is cut by checkpoints.
    """
    left = _cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct())
    labels: DataFrame | None = None
    for turn in range(max_rounds):
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))

        def rank(c: str, by_hash: bool = turn % 2 == 1, seed: int = turn):
            return F.struct((F.xxhash64(c, F.lit(seed)) if by_hash else F.col(c)).alias("h"), F.col(c).alias("v"))

        first = both.groupBy(F.col("src").alias("id")).agg(F.min(rank("dst")).alias("near")).select("id", F.least("near", rank("id"))["v"].alias("to"))
        moved = _cut(first.join(first.toDF("to", "further"), "to").select("id", F.col("further").alias("to")))
        labels = moved if labels is None else _cut(labels.withColumnRenamed("to", "at").join(moved.toDF("at", "to"), "at", "left").select("id", F.coalesce("to", "at").alias("to")))
        ends = left.join(moved.toDF("src", "a"), "src").join(moved.toDF("dst", "b"), "dst").filter("a <> b")
        left = _cut(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if left.isEmpty():
            if turn == 0:  # only smallest ids were followed
                return labels.withColumnRenamed("to", "component")
            return labels.join(labels.groupBy("to").agg(F.min("id").alias("component")), "to").select("id", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
