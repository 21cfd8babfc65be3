"""Histograms, calendars, splits and other table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Edges of the membership histogram and of the label-value histogram.
MEMBERSHIP = [1, 2, 6, *range(10, 100, 10), *range(100, 1000, 100), *range(1000, 10000, 1000), *range(10000, 100001, 10000)]
LABEL_VALUES = [*range(0, 100, 10), *range(100, 1000, 100), *range(1000, 10001, 1000)]


def zero_filled(counts: DataFrame, bins: DataFrame, key: str = "bin") -> DataFrame:
    """Counts of all bins, 0 where none."""
    return F.broadcast(bins).join(counts, key, "left").fillna(0, ["n"])


def bincount(df: DataFrame, column: str) -> DataFrame:
    """(bin, n) for 0 to the largest value."""
    counts = df.filter(F.col(column) >= 0).groupBy(F.col(column).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max("bin").alias("top"))
    return zero_filled(counts, top.select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bin")))


def count_of_counts(df: DataFrame, column: str, most: int = 40) -> DataFrame:
    """(bin, n): how many classes have `bin` rows, for 0 to most - 1."""
    return bincount(df.groupBy(column).count(), "count").filter(F.col("bin") < most)


def edge_histogram(df: DataFrame, value: Column, edges: list[float], closed: bool = True) -> DataFrame:
    """(bin, lo, hi, n): half-open bins, the last one closed; values beyond are dropped."""
    spark = df.sparkSession
    inside = df.select(value.cast("double").alias("v")).filter((F.col("v") >= edges[0]) & ((F.col("v") <= edges[-1]) if closed else (F.col("v") < edges[-1])))
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("v"))) - 1
    counts = inside.select(F.least(at, F.lit(len(edges) - 2)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)], "bin int, lo double, hi double")
    return zero_filled(counts, bins)


def even_histogram(df: DataFrame, value: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n, share, density) of equal bins over [lo, hi], the last one closed, by arithmetic instead of a search."""
    width = (hi - lo) / bins
    inside = df.select(value.cast("double").alias("v")).filter(F.col("v").between(lo, hi))
    counts = inside.select(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = zero_filled(counts, all_bins)
    total = filled.agg(F.sum("n").alias("total"))
    return filled.join(F.broadcast(total)).select("bin", "n", F.try_divide(F.col("n"), F.col("total")).alias("share"), F.try_divide(F.col("n"), F.col("total") * width).alias("density"))


def angle_histogram(df: DataFrame, value: Column) -> DataFrame:
    return even_histogram(df, value, -90, 90, 180).select((F.col("bin") - 90).alias("angle"), "n")


def membership_histogram(df: DataFrame, column: str) -> DataFrame:
    """(lo, n): class sizes by the fixed edges up to the largest size, each bin up to the next edge; the largest size is an edge of its own, with nothing beyond it."""
    sizes = df.groupBy(column).agg(F.count("*").alias("size"))
    lo = F.array_max(F.filter(F.array(*[F.lit(e) for e in MEMBERSHIP]), lambda e: e <= F.col("size")))
    counts = sizes.groupBy(lo.alias("lo")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.createDataFrame([(e,) for e in MEMBERSHIP], "lo int")
    top = sizes.agg(F.max("size").alias("top"))
    found = zero_filled(counts, bins.join(F.broadcast(top), F.col("lo") <= F.col("top")).select("lo"), "lo")
    return found.unionByName(top.filter("top IS NOT NULL").select(F.col("top").cast("int").alias("lo"), F.lit(0).cast("long").alias("n")))


def label_value_histogram(df: DataFrame, column: str) -> DataFrame:
    """(name, n): label ids by the fixed edges, names 'lo - hi-1'."""
    h = edge_histogram(df, F.col(column), LABEL_VALUES)
    return h.select(F.format_string("%d - %d", F.col("lo").cast("int"), (F.col("hi") - 1).cast("int")).alias("name"), "n")


def calendar_counts(df: DataFrame, ts: str, unit: str) -> DataFrame:
    """(bucket, n) by calendar unit."""
    return df.groupBy(F.date_trunc(unit, F.col(ts)).alias("bucket")).agg(F.count("*").alias("n"))


def tumbling_counts(df: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.window(F.col(ts), width).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("bucket"), "n")


def calendar_align(df: DataFrame, ts: str, key: str) -> DataFrame:
    """(day, key, n) for every day of any key and every key, 0 where none."""
    counts = df.groupBy(F.to_date(ts).alias("day"), key).agg(F.count("*").alias("n"))
    return counts.select("day").distinct().crossJoin(F.broadcast(counts.select(key).distinct())).join(counts, ["day", key], "left").fillna(0, ["n"])


def overview(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows, labelled rows, distinct labels and distinct labels >= 0 by key, and a total whose labels are told apart by key."""
    return (
        df.rollup(key)
        .agg(F.count("*").alias("n_rows"), F.count_if(F.col(label) >= 0).alias("n_labelled"), F.count_distinct(F.struct(key, label)).alias("n_clusters"), F.count_distinct(F.when(F.col(label) >= 0, F.struct(key, label))).alias("n_classes"))
        .withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("total")))
    )


def running_share(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Running sum within a key, and the key's share of the whole."""
    run = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(key).agg(F.sum(value).alias("key_total"))
    grand = totals.agg(F.sum("key_total").alias("total"))
    shares = totals.join(F.broadcast(grand)).select(key, (F.col("key_total") / F.col("total")).alias("share"))
    return df.withColumn("running", F.sum(value).over(run)).join(F.broadcast(shares), key)


def last_two_match(df: DataFrame, key: str, order: list[str], value: str, tolerance: float) -> DataFrame:
    """`match`: 1 if like the row before, 2 if like the one before that, else 0."""
    w = Window.partitionBy(key).orderBy(*order)
    near = lambda k: F.abs(F.col(value) - F.lag(value, k).over(w)) < tolerance
    return df.withColumn("match", F.when(near(1), 1).when(near(2), 2).otherwise(0))


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by `order`; taken map-side, so a key of any size costs a row a task."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def hashed(column: Column, seed: int = 0) -> Column:
    """A portable pseudo-random order of integers."""
    return ((column + seed) * 2654435761) % 1000003


def stratified_split(df: DataFrame, by: str, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """`test`: the first int(n * fraction) rows of each class in hashed order."""
    w = Window.partitionBy(by).orderBy(hashed(F.col(key), seed), key)
    n = df.groupBy(by).agg(F.count("*").alias("__n"))
    return df.withColumn("__r", F.row_number().over(w)).join(F.broadcast(n), by).withColumn("test", F.col("__r") <= F.floor(F.col("__n") * fraction)).drop("__r", "__n")


def class_disjoint_split(df: DataFrame, by: str, train: float, seed: int = 0) -> DataFrame:
    """`train`: whole classes, the first ceil(train * classes) in hashed order."""
    classes = df.select(by).distinct()
    ranked = classes.withColumn("__r", F.row_number().over(Window.orderBy(hashed(F.col(by), seed), by)))
    n = classes.groupBy().agg(F.count("*").alias("__n"))
    marked = ranked.join(F.broadcast(n)).select(by, (F.col("__r") <= F.ceil(F.col("__n") * train)).alias("train"))
    return df.join(marked, by)


def savitzky_golay(df: DataFrame, order: str, value: str, width: int = 201, degree: int = 3, key: str | None = None) -> DataFrame:
    """`smooth`: the centre of a least-squares polynomial over the window; null where the window is cut."""
    import numpy as np

    half = width // 2
    weights = np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))[0]
    w = Window.partitionBy(*([key] if key else [])).orderBy(order).rowsBetween(-half, half)
    table = F.array(*[F.lit(float(x)) for x in weights])
    near = F.collect_list(value).over(w)
    return df.withColumn("smooth", F.when(F.size(near) == width, F.aggregate(F.zip_with(near, table, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))
