"""Clustering and verification metrics from contingency tables, sums and pairs of embeddings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .similarity import centroids


def contingency(df: DataFrame) -> DataFrame:
    """(y_true, y_pred, n)."""
    return df.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def _marginals(df: DataFrame) -> DataFrame:
    """The table with a (row sum), b (column sum) and total; its size is that of the labels, not of the rows."""
    c = contingency(df)
    return c.withColumn("a", F.sum("n").over(Window.partitionBy("y_true"))).withColumn("b", F.sum("n").over(Window.partitionBy("y_pred")))


def pairwise(df: DataFrame) -> DataFrame:
    c = contingency(df)
    squares = lambda key: c.groupBy(key).agg(F.sum("n").alias("m")).agg((F.sum(F.col("m") * F.col("m")) - F.sum("m")).alias("q"))
    t = c.agg((F.sum(F.col("n") * F.col("n")) - F.sum("n")).alias("t"))
    one = t.join(F.broadcast(squares("y_pred").withColumnRenamed("q", "p"))).join(F.broadcast(squares("y_true")))
    return one.select(F.try_divide(F.col("t").cast("double"), "p").alias("precision"), F.try_divide(F.col("t").cast("double"), "q").alias("recall")).withColumn("fscore", _f())


def _f() -> Column:
    return F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))


def bcubed(df: DataFrame) -> DataFrame:
    m = _marginals(df)
    return m.agg((F.sum(F.col("n") * F.col("n") / F.col("b")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("a")) / F.sum("n")).alias("recall")).withColumn("fscore", _f())


def nmi(df: DataFrame) -> DataFrame:
    """Mutual information over the mean of both entropies; 1 if both have one label."""
    m = _marginals(df).crossJoin(F.broadcast(df.groupBy().agg(F.count("*").cast("double").alias("t"))))
    e = m.agg(
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"),
        F.sum(-F.col("n") / F.col("t") * F.log(F.col("a") / F.col("t"))).alias("ha"),
        F.sum(-F.col("n") / F.col("t") * F.log(F.col("b") / F.col("t"))).alias("hb"),
    )
    return e.select(F.when(F.col("ha") + F.col("hb") == 0, F.lit(1.0)).otherwise(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb"))).alias("nmi"))


def adjusted_rand(df: DataFrame) -> DataFrame:
    c = contingency(df)
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    s = c.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("t"))
    a = c.groupBy("y_true").agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("a"))
    b = c.groupBy("y_pred").agg(F.sum("n").alias("m")).agg(F.sum(two("m")).alias("b"))
    one = s.join(F.broadcast(a)).join(F.broadcast(b)).withColumn("e", F.try_divide(F.col("a") * F.col("b"), two("t")))
    return one.select(F.coalesce(F.try_divide(F.col("s") - F.col("e"), (F.col("a") + F.col("b")) / 2 - F.col("e")), F.lit(1.0)).alias("ari"))


def purity(df: DataFrame) -> DataFrame:
    best = contingency(df).groupBy("y_pred").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.agg((F.sum("best") / F.sum("n")).alias("purity"))


def by_label(df: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support; an undefined ratio is 0."""
    true = df.groupBy(F.col("y_true").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("hit"))
    pred = df.groupBy(F.col("y_pred").alias("label")).agg(F.count("*").alias("predicted"))
    j = true.join(pred, "label", "full").fillna(0)
    out = j.select("label", "support", F.coalesce(F.try_divide(F.col("hit"), F.col("predicted")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0)).alias("recall"))
    return out.withColumn("f1", F.coalesce(_f(), F.lit(0.0)))


def weighted(df: DataFrame) -> DataFrame:
    p = by_label(df)
    return p.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")])


def macro(df: DataFrame) -> DataFrame:
    return by_label(df).agg(*[(F.avg(c) * 100).alias(c) for c in ("precision", "recall", "f1")])


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))


METRICS = {"pairwise": pairwise, "bcubed": bcubed, "nmi": nmi, "ari": adjusted_rand, "purity": purity, "weighted": weighted, "macro": macro, "accuracy": accuracy}


def report(df: DataFrame) -> DataFrame:
    """All scores in one row, names prefixed by their metric; df is read once for the contingency of each."""
    parts = [f(df).select([F.col(c).alias(f"{name}_{c}" if c != name else c) for c in f(df).columns]) for name, f in METRICS.items()]
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), parts)


def evaluate(df: DataFrame, metric: str = "pairwise") -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric](df)


def silhouette_distances(df: DataFrame) -> DataFrame:
    """id, label, n, mean distance to the label's other members (null for one alone), least mean distance to another label.

    Cosine is linear in the unit vectors, so means over a label's members come from its vector sum: rows times labels, no pairs.
    """
    unit = df.select("id", "label", V.normalise(F.col("vec")).alias("vec"))
    means = centroids(unit).select(F.col("label").alias("other"), F.col("vec").alias("mean"), F.col("n").alias("m"))
    d = unit.crossJoin(F.broadcast(means)).withColumn("far", 1 - V.inner_product(F.col("vec"), F.col("mean")))
    own = F.col("label") == F.col("other")
    # A label's sum holds the row itself at distance 0.
    return d.groupBy("id", "label").agg(F.max(F.when(own, F.col("m"))).alias("n"), F.max(F.when(own & (F.col("m") > 1), F.col("far") * F.col("m") / (F.col("m") - 1))).alias("intra"), F.min(F.when(~own, F.col("far"))).alias("nearest"))


def silhouette_samples(df: DataFrame) -> DataFrame:
    """id, label, silhouette; 0 for a label of one."""
    d = silhouette_distances(df)
    return d.select("id", "label", F.coalesce(F.try_divide(F.col("nearest") - F.col("intra"), F.greatest("nearest", "intra")), F.lit(0.0)).alias("silhouette"))


def davies_bouldin(df: DataFrame) -> DataFrame:
    c = centroids(df).select("label", "vec")
    scatter = df.select("label", F.col("vec").alias("v")).join(F.broadcast(c), "label").groupBy("label").agg(F.avg(V.euclidean(F.col("v"), F.col("vec"))).alias("s"))
    full = c.join(scatter, "label")
    pairs = full.toDF("a", "va", "sa").join(full.toDF("b", "vb", "sb"), F.col("a") != F.col("b"))
    worst = pairs.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / V.euclidean(F.col("va"), F.col("vb"))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame) -> DataFrame:
    c = centroids(df).select("label", F.col("vec").alias("c"), "n")
    total = centroids(df.withColumn("label", F.lit(0))).select(F.col("vec").alias("t"))
    within = df.join(F.broadcast(c), "label").agg(F.sum(F.pow(V.euclidean(F.col("vec"), F.col("c")), 2)).alias("w"))
    between = c.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") * F.pow(V.euclidean(F.col("c"), F.col("t")), 2)).alias("b"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return between.crossJoin(within).select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def roc_sweep(pairs: DataFrame, step: float = 0.01, folds: int = 10) -> DataFrame:
    """threshold, tpr, fpr (means over contiguous folds, 0 where undefined); pairs: pair_id, dist, is_same; a pair is called same if dist < threshold.

    A pair counts for every threshold above its distance, so pairs are first counted by their bin and summed up along the bins.
    """
    return _fold_counts(pairs, step, folds).groupBy("threshold").agg(F.avg(F.coalesce(F.try_divide(F.col("tp"), F.col("pos")), F.lit(0.0))).alias("tpr"), F.avg(F.coalesce(F.try_divide(F.col("fp"), F.col("neg")), F.lit(0.0))).alias("fpr"))


def _fold_counts(pairs: DataFrame, step: float, folds: int) -> DataFrame:
    steps = round(1 / step)
    dealt = pairs.withColumn("fold", F.ntile(folds).over(Window.orderBy("pair_id")) - 1)
    # The first grid point above the distance; grid points are i * step as doubles.
    bin_of = F.greatest(F.floor(F.col("dist") / step).cast("int"), F.lit(0))
    bins = dealt.withColumn("bin", F.when(F.col("dist") < bin_of * F.lit(step), bin_of).when(F.col("dist") < (bin_of + 1) * F.lit(step), bin_of + 1).otherwise(bin_of + 2))
    counts = bins.groupBy("fold", "bin").agg(F.count_if("is_same").alias("s"), F.count_if(~F.col("is_same")).alias("d"))
    grid = pairs.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold")).select("fold", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("bin"))
    sums = F.broadcast(dealt.groupBy("fold").agg(F.count_if("is_same").alias("pos"), F.count_if(~F.col("is_same")).alias("neg")))
    upto = Window.partitionBy("fold").orderBy("bin")
    run = grid.join(counts, ["fold", "bin"], "left").fillna(0).withColumn("tp", F.sum("s").over(upto)).withColumn("fp", F.sum("d").over(upto))
    return run.join(sums, "fold").select("fold", "bin", (F.col("bin") * F.lit(step)).alias("threshold"), "tp", "fp", "pos", "neg")


def kfold_accuracy(pairs: DataFrame, step: float = 0.01, folds: int = 10) -> DataFrame:
    """fold, threshold (the first that is best on the other folds), accuracy on the fold."""
    c = _fold_counts(pairs, step, folds).withColumn("right", F.col("tp") + F.col("neg") - F.col("fp")).withColumn("n", F.col("pos") + F.col("neg"))
    total = c.groupBy("bin").agg(F.sum("right").alias("all_right"), F.sum("n").alias("all_n"))
    train = c.join(total, "bin").withColumn("train", (F.col("all_right") - F.col("right")) / (F.col("all_n") - F.col("n")))
    best = train.groupBy("fold").agg(F.max(F.struct("train", (-F.col("bin")).alias("b"), "threshold", (F.col("right") / F.col("n")).alias("accuracy"))).alias("m"))
    return best.select("fold", "m.threshold", "m.accuracy")


def tar_at_far(pairs: DataFrame, far_target: float = 1e-3, step: float = 0.001, folds: int = 10) -> DataFrame:
    """tar, tar_std, far: the threshold where the other folds' FAR reaches the target (linear between grid points, 0 if it never does), tried on each fold."""
    c = _fold_counts(pairs, step, folds)
    total = c.groupBy("bin").agg(F.sum("fp").alias("all_fp"), F.sum("neg").alias("all_neg"))
    train = c.join(total, "bin").withColumn("far", F.try_divide(F.col("all_fp") - F.col("fp"), F.col("all_neg") - F.col("neg")))
    order = Window.partitionBy("fold").orderBy("bin")
    steps = train.withColumn("last", F.lag("far").over(order))
    reached = (F.col("last") < far_target) & (F.col("far") >= far_target)
    at = steps.groupBy("fold").agg(F.coalesce(F.min(F.when(reached, F.col("threshold") - (F.col("far") - far_target) / (F.col("far") - F.col("last")) * step)), F.lit(0.0)).alias("t"))
    dealt = pairs.withColumn("fold", F.ntile(folds).over(Window.orderBy("pair_id")) - 1).join(F.broadcast(at), "fold")
    hit = F.col("dist") < F.col("t")
    each = dealt.groupBy("fold").agg(F.try_divide(F.count_if(hit & F.col("is_same")), F.count_if("is_same")).alias("tar"), F.try_divide(F.count_if(hit & ~F.col("is_same")), F.count_if(~F.col("is_same"))).alias("far"))
    return each.agg(F.avg("tar").alias("tar"), F.stddev_pop("tar").alias("tar_std"), F.avg("far").alias("far"))
