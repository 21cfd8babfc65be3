"""Label algebra: renumbering, offsets, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components


def _numbered(df: DataFrame, sizes: DataFrame, order: list, start: int = 0) -> DataFrame:
    """Joins a numbering of the distinct labels (one row each) back to the rows."""
    new = sizes.withColumn("new_label", (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long")).select("label", "new_label")
    return df.join(new, "label")


def by_frequency(df: DataFrame) -> DataFrame:
    """new_label 0 is the most frequent label; ties to the larger label. Negative labels stay."""
    sizes = df.filter("label >= 0").groupBy("label").count()
    return _numbered(df, sizes, [F.col("count").desc(), F.col("label").desc()]).unionByName(df.filter("label < 0").withColumn("new_label", F.col("label").cast("long")).select("label", *[c for c in df.columns if c != "label"], "new_label"))


def by_first_seen(df: DataFrame) -> DataFrame:
    """Labels numbered by the smallest id; rows without a label get numbers after them, by id."""
    sizes = df.filter("label is not null").groupBy("label").agg(F.min("id").alias("first"))
    known = _numbered(df, sizes, [F.col("first")])
    n = sizes.groupBy().count()
    loose = df.filter("label is null").withColumn("r", F.row_number().over(Window.orderBy("id")) - 1).join(F.broadcast(n)).select("label", *[c for c in df.columns if c != "label"], (F.col("r") + F.col("count")).cast("long").alias("new_label"))
    return known.unionByName(loose)


def dense(df: DataFrame, keep_least: bool = True) -> DataFrame:
    """Gaps closed; numbering starts at the least label, or at 0."""
    sizes = df.select("label").distinct()
    least = sizes.agg(F.min("label").alias("least"))
    out = _numbered(df, sizes, [F.col("label")])
    return out.join(F.broadcast(least)).withColumn("new_label", F.col("new_label") + F.col("least")).drop("least") if keep_least else out


def offset_concat(df: DataFrame, part: str = "part") -> DataFrame:
    """Labels of ordered parts made distinct: each part starts after the largest label of those before."""
    tops = df.groupBy(part).agg((F.max("label") + 1).alias("top"))
    shift = tops.withColumn("shift", F.coalesce(F.sum("top").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(part, "shift")
    return df.join(F.broadcast(shift), part).withColumn("new_label", (F.col("label") + F.col("shift")).cast("long")).drop("shift")


def negate_infrequent(df: DataFrame, least: int, keep_zero: bool = True) -> DataFrame:
    """Labels from 0 on of fewer than `least` rows are negated; with keep_zero False they become -(label + 1). Noise stays."""
    sizes = df.groupBy("label").count()
    rare = (F.col("count") < least) & (F.col("label") >= 0)
    return df.join(sizes, "label").withColumn("new_label", F.when(rare, -F.col("label") if keep_zero else -(F.col("label") + 1)).otherwise(F.col("label")).cast("long")).drop("count")


def merge_labels(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Labels joined by pairs (src, dst) take the smallest label of their component, gaps are closed."""
    joined = components(pairs).withColumnRenamed("id", "label")
    merged = df.join(joined, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    return dense(merged)


def update_annotations(df: DataFrame, decisions: DataFrame, final: bool = False) -> DataFrame:
    """Review decisions (old_label, new_label): -1 is noise, other pairs merge; finally gaps are closed and labels sorted by size."""
    noise = decisions.filter("new_label = -1").select(F.col("old_label").alias("label")).distinct().withColumn("noise", F.lit(True))
    pairs = decisions.filter("new_label >= 0").select(F.col("old_label").alias("src"), F.col("new_label").alias("dst"))
    joined = components(pairs).withColumnRenamed("id", "label")
    out = df.join(noise, "label", "left").join(joined, "label", "left").withColumn("label", F.coalesce(F.col("component"), F.when(F.col("noise"), F.lit(-1)), F.col("label")).cast("long")).drop("noise", "component")
    return by_frequency(out).drop("label").withColumnRenamed("new_label", "label") if final else out


def majority(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """(group, label, n): the most frequent label, the smallest on ties."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.max(F.struct(F.col("n"), (-F.col(label)).alias("l"))).alias("b"))
    return best.select(group, (-F.col("b.l")).alias(label), F.col("b.n").alias("n"))


def auto_merge(df: DataFrame, matches: DataFrame, threshold: float) -> DataFrame:
    """df (id, vec, label), matches (src, dst) of ids: labels that a match links merge if their mean cross distance is below the threshold.

    The mean of 1 - cosine over all cross pairs is 1 - the inner product of the mean unit vectors, so no pairs are made.
    """
    from ..functions import vectors as V
    from .similarity import centroids

    ends = df.select("id", "label")
    links = matches.join(ends.toDF("src", "a"), "src").join(ends.toDF("dst", "b"), "dst").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    means = centroids(df.withColumn("vec", V.normalise(F.col("vec")))).select("label", "vec")
    scored = links.join(means.toDF("a", "va"), "a").join(means.toDF("b", "vb"), "b").filter(1 - V.inner_product(F.col("va"), F.col("vb")) < threshold)
    return merge_labels(df, scored.select(F.col("a").alias("src"), F.col("b").alias("dst")))
