"""Clusterings over neighbour graphs, hierarchical cuts, matching of clusters, proposals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .graph import _cut, components
from .labels import dense
from .similarity import centroids, knn_join, threshold_join


def with_singletons(ids: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, component) of all ids: those in no edge are their own."""
    return ids.join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def single_linkage(df: DataFrame, t: float, closed: bool = True) -> DataFrame:
    """Flat clusters of single linkage cut at t: components of the pairs within t."""
    return with_singletons(df.select("id"), components(threshold_join(df, t, closed)))


# -- hierarchical clustering of one batch, in numpy -------------------------------------------------------------


def cut_tree(x: np.ndarray, t: float, method: str = "complete", metric: str = "cosine") -> np.ndarray:
    """Flat 0-based clusters of agglomerative clustering whose merges are at height <= t, by nearest-neighbour chains."""
    n = len(x)
    if n <= 1:
        return np.zeros(n, np.int64)
    if metric == "cosine":
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    size, alive, parent = np.ones(n), np.ones(n, np.bool_), np.arange(n)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        height = d[a, b]
        merges.append((height, a, b))
        if method == "single":
            row = np.minimum(d[a], d[b])
        elif method == "complete":
            row = np.maximum(np.where(np.isinf(d[a]), -np.inf, d[a]), np.where(np.isinf(d[b]), -np.inf, d[b]))
        elif method == "average":
            row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        else:
            raise ValueError(f"unknown linkage {method!r}")
        alive[b] = False
        size[a] += size[b]
        row = np.where(alive, row, np.inf)
        row[a] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for height, a, b in merges:
        if height <= t:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    roots = np.array([root(i) for i in range(n)])
    return np.unique(roots, return_inverse=True)[1]


def batched_hierarchical(df: DataFrame, threshold: float, batchsize: int, linkage: str = "complete", metric: str = "cosine", rounds: int = 2) -> DataFrame:
    """(id, label): batches in id order are cut alone, then the centroids of the clusters, `rounds` times.

    Only a batch of `batchsize` rows meets in a task; the centroids of a round are batched again while they are more than that.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"id": pdf["id"], "batch": pdf["batch"], "local": cut_tree(np.array(pdf["vec"].tolist(), float), threshold, linkage, metric)})

    def batched(rows: DataFrame) -> DataFrame:
        numbered = rows.select("id", F.col("vec").cast("array<double>").alias("vec"), _batch_of(rows, batchsize).alias("batch"))
        local = numbered.groupBy("batch").applyInPandas(one, "id long, batch long, local long")
        return local.select("id", (F.col("batch") * batchsize + F.col("local")).alias("label"))

    rows = df.select("id", "vec").withColumn("id", F.col("id").cast("long"))
    labels = _cut(batched(_positioned(rows)))
    for _ in range(rounds):
        means = centroids(rows.join(labels, "id")).select(F.col("label").alias("id"), "vec")
        upper = batched(_positioned(means)).toDF("label", "upper")
        labels = _cut(labels.join(upper, "label").select("id", F.col("upper").alias("label")))
    return dense(labels, keep_least=False).select("id", F.col("new_label").alias("label"))


def _positioned(rows: DataFrame) -> DataFrame:
    """Rows with their place in id order, counted by ranges so that no task sorts them all."""
    parted = rows.repartitionByRange("id").withColumn("p", F.spark_partition_id())
    parted = _cut(parted)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("p").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).select("p", "start")
    return parted.join(F.broadcast(sizes), "p").withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1 + F.col("start")).drop("p", "start")


def _batch_of(rows: DataFrame, batchsize: int):
    return F.floor(F.col("place") / batchsize).cast("long")


# -- matching of clusters ---------------------------------------------------------------------------------------


def match_clusters(df: DataFrame, mode: str = "average", topk: int | None = None, min_threshold: float = 0.5, max_threshold: float = 1.0, ignore: DataFrame | None = None) -> DataFrame:
    """(c1, c2, dist): distances of labels >= 0 (and <= topk) that are positive and at most max_threshold, of labels whose nearest is under min_threshold.

    Modes: average compares centroids, single the nearest members, triplet the nearest of centroid and two farthest members.
    """
    rows = df.filter("label >= 0" + (f" and label <= {topk}" if topk is not None else ""))
    if mode == "average":
        found = threshold_join(centroids(rows).select(F.col("label").alias("id"), "vec"), max_threshold).select(F.col("src").alias("c1"), F.col("dst").alias("c2"), "dist")
    elif mode == "single":
        found = _least_between(rows, max_threshold).filter("c1 < c2")
    elif mode == "triplet":
        found = _triplets(rows)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    kept = found.filter((F.col("dist") <= max_threshold) & (F.abs("dist") > 1e-12))
    near = kept.groupBy("c1").agg(F.min("dist").alias("nearest")).filter(F.col("nearest") < min_threshold).select("c1")
    out = kept.join(near, "c1", "left_semi").select("c1", "c2", F.round("dist", 4).alias("dist"))
    return out.join(ignore, ["c1", "c2"], "left_anti") if ignore is not None else out


def _least_between(rows: DataFrame, t: float) -> DataFrame:
    ends = rows.select("id", "label")
    pairs = threshold_join(rows, t)
    joined = pairs.join(ends.toDF("src", "a"), "src").join(ends.toDF("dst", "b"), "dst").filter("a <> b")
    return joined.groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).agg(F.min("dist").alias("dist"))


def _triplets(rows: DataFrame) -> DataFrame:
    """Both directions, over three vectors a label. The two farthest members are found by label in blocks."""

    def farthest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.array(pdf["vec"].tolist(), float)
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        best, at = -np.inf, (0, 0)
        for i in range(0, len(u), 2048):
            d = np.round(1 - u[i : i + 2048] @ u.T, 12)
            if d.max() > best:
                best, k = d.max(), int(d.argmax())
                at = (i + k // len(u), k % len(u))
        return pd.DataFrame({"label": pdf["label"].iloc[0], "vec": [x[at[0]], x[at[1]]]})

    ends = rows.select("id", "label", F.col("vec").cast("array<double>").alias("vec")).groupBy("label").applyInPandas(farthest, "label long, vec array<double>")
    three = centroids(rows).select(F.col("label").cast("long").alias("label"), "vec").unionByName(ends).select("label", V.normalise(F.col("vec")).alias("vec"))
    a, b = three.toDF("c1", "va"), three.toDF("c2", "vb")
    return a.join(b, F.col("c1") != F.col("c2")).groupBy("c1", "c2").agg(F.min(1 - V.inner_product(F.col("va"), F.col("vb"))).alias("dist"))


def remove_duplicate_classes(df: DataFrame, t: float = 0.2) -> DataFrame:
    """Rows of the most frequent class of each group of classes whose centroids are nearer than t; labels dense."""
    c = centroids(df)
    groups = with_singletons(c.select(F.col("label").cast("long").alias("id")), components(threshold_join(c.select(F.col("label").alias("id"), "vec"), t, closed=False)))
    best = groups.join(c.select(F.col("label").cast("long").alias("id"), "n"), "id").groupBy("component").agg(F.max(F.struct("n", (-F.col("id")).alias("l"))).alias("b")).select((-F.col("b.l")).alias("label"))
    return dense(df.join(best, "label", "left_semi"), keep_least=False)


# -- graph clusterings ------------------------------------------------------------------------------------------


def dbscan(df: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, label, core): label is the smallest core id of the cluster, -1 for noise; a border row goes to its smallest core neighbour's cluster."""
    near = _cut(threshold_join(df, eps))
    both = near.select("src", "dst").unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    cores = both.groupBy(F.col("src").alias("id")).count().filter(F.col("count") + 1 >= min_samples).select("id")
    if min_samples <= 1:
        cores = df.select("id")
    edges = near.join(cores.select(F.col("id").alias("src")), "src", "left_semi").join(cores.select(F.col("id").alias("dst")), "dst", "left_semi")
    groups = with_singletons(cores, components(edges))
    border = both.join(groups.select(F.col("id").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("id")).agg(F.min_by("component", "dst").alias("near"))
    out = df.select("id").join(groups, "id", "left").join(border, "id", "left")
    return out.select("id", F.coalesce("component", "near", F.lit(-1)).cast("long").alias("label"), F.col("component").isNotNull().alias("core"))


def rank_order(knn: DataFrame, th_sim: float) -> DataFrame:
    """Links of approximate rank order: (src, dst, dist), from neighbours (src, rank from 1, dst)."""
    lists = knn.select("src", "dst", "rank")
    mutual = lists.join(lists.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("rank").alias("back")), ["src", "dst"])
    half = lambda a, b, o: mutual.join(lists.select(F.col("src").alias(a), F.col("dst").alias("m"), F.col("rank").alias("r")), a).filter(F.col("r") < F.col(o)).filter(F.col("m") != F.col(b)).join(lists.select(F.col("src").alias(b), F.col("dst").alias("m"), F.lit(1).alias("in")), [b, "m"], "left").groupBy("src", "dst").agg(F.count_if(F.col("in").isNull()).alias("missing"))
    # A row is at place 0 of its own list; it counts as missing only if it is in no list of the other, and mutual rows are in both.
    one, two = half("src", "dst", "rank"), half("dst", "src", "back")
    scored = mutual.join(one.withColumnRenamed("missing", "m1"), ["src", "dst"], "left").join(two.withColumnRenamed("missing", "m2"), ["src", "dst"], "left")
    d = (F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0))) / F.least(F.col("rank"), F.col("back") + 1)  # places count the row itself, the first of its list
    return scored.select("src", "dst", d.alias("dist")).filter(F.col("dist") <= 1 - th_sim)


def two_threshold_links(knn: DataFrame, t1: float, t2: float) -> DataFrame:
    """Directed links with similarity over t1 whose ends share neighbours: max(share / degree) over t2."""
    a = _cut(knn.filter(1 - F.col("dist") > t1).select("src", "dst"))
    degree = a.groupBy("src").count()
    share = a.select("src", F.col("dst").alias("m")).join(a.select(F.col("src").alias("m"), "dst"), "m").join(a, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.count("*").alias("share"))
    ends = share.join(degree.withColumnRenamed("count", "di"), "src").join(degree.toDF("dst", "dj"), "dst")
    return ends.filter(F.greatest(F.col("share") / F.col("di"), F.col("share") / F.col("dj")) > t2).select("src", "dst", "share")


def peaks(knn: DataFrame, confidence: DataFrame, max_conn: int = 1) -> DataFrame:
    """(src, dst, dist): the nearest neighbours whose confidence is not below the row's own (by more than 1e-4)."""
    c = confidence.select("id", "confidence")
    joined = knn.join(c.toDF("src", "ci"), "src").join(c.toDF("dst", "cn"), "dst").filter((F.col("src") != F.col("dst")) & (F.col("cn") >= F.col("ci") - 1e-4))
    return joined.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("rank"))).filter(F.col("r") <= max_conn).select("src", "dst", "dist")


def peaks_labels(found: DataFrame, ids: DataFrame, tau: float) -> DataFrame:
    return with_singletons(ids, components(found.filter(F.col("dist") < 1 - tau)))


def pooled(edges: DataFrame, pool: str = "avg") -> DataFrame:
    """One score for each unordered edge."""
    how = {"avg": F.avg, "max": F.max, "min": F.min}[pool]
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(how("score").alias("score"))


def constrained_components(edges: DataFrame, max_sz: int, step: float = 0.05, pool: str = "avg", max_iter: int = 100) -> DataFrame:
    """(id, component): components of at most max_sz; larger ones are cut again at a threshold that rises by (1 - th) * step."""
    left = _cut(pooled(edges, pool))
    th = left.agg(F.min("score")).first()[0]
    done: DataFrame | None = None
    nodes = _cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct())
    for turn in range(max_iter + 1):
        comp = _cut(with_singletons(nodes, components(left)) if not left.isEmpty() else nodes.select("id", F.col("id").alias("component")))
        sizes = comp.groupBy("component").count()
        big = _cut(comp.join(sizes.filter(F.col("count") > max_sz), "component", "left_semi"))
        final = comp if turn == max_iter else comp.join(big, "id", "left_anti")
        done = _cut(final if done is None else done.unionByName(final))
        if turn == max_iter or big.isEmpty():
            return done
        th += (1 - th) * step
        nodes = _cut(big.select("id"))
        left = _cut(left.filter(F.col("score") >= th).join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi"))
    return done


def super_vertices(knn: DataFrame, th: float, step: float, max_sz: int) -> DataFrame:
    """Neighbour pairs with similarity th or more, cut to components of at most max_sz."""
    edges = knn.filter(1 - F.col("dist") >= th).select("src", "dst", (1 - F.col("dist")).alias("score"))
    return constrained_components(edges, max_sz, step, "max")


def proposal_edges(clusters: DataFrame, knn: DataFrame) -> DataFrame:
    """(proposal_id, src, dst, dist): neighbour pairs within one proposal, each once; clusters: (proposal_id, node)."""
    pairs = knn.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("dist").alias("dist")).filter("src <> dst")
    return pairs.join(clusters.toDF("proposal_id", "src"), "src").join(clusters.toDF("proposal_id", "dst"), ["proposal_id", "dst"]).select("proposal_id", "src", "dst", "dist")


def nms_first(members: DataFrame, scores: DataFrame) -> DataFrame:
    """(node, proposal_id): each node's proposal of highest score, the smaller id on ties."""
    return members.join(scores, "proposal_id").groupBy("node").agg(F.min(F.struct((-F.col("score")).alias("s"), "proposal_id")).alias("b")).select("node", "b.proposal_id")


def nms(members: DataFrame, scores: DataFrame, th: float = 1.0) -> DataFrame:
    """(node, proposal_id) after proposals that overlap a better one by an IoU over th are dropped.

    A proposal stays if no better one that stays suppresses it: rounds settle the proposals whose better rivals are all
    settled, so greedy order is kept without a sequential pass.
    """
    if th >= 1:
        return nms_first(members, scores)
    sizes = members.groupBy("proposal_id").agg(F.count("*").alias("n")).join(scores, "proposal_id")
    sized = _cut(members.join(sizes, "proposal_id").select("proposal_id", "node", "n", "score"))
    # Of two proposals with a node in common the better one comes first; each pair is formed once a node.
    better = (F.col("sa") > F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    common = sized.toDF("a", "node", "na", "sa").join(sized.toDF("b", "other", "nb", "sb"), (F.col("node") == F.col("other")) & better)
    pairs = common.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    rivals = _cut(pairs.filter(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) > th).select("a", "b"))
    state = _cut(sizes.select("proposal_id", F.lit(None).cast("boolean").alias("keep")))
    while True:
        seen = rivals.join(state.toDF("a", "keep"), "a").groupBy(F.col("b").alias("proposal_id")).agg(F.bool_or(F.coalesce("keep", F.lit(False))).alias("beaten"), F.bool_or(F.col("keep").isNull()).alias("waits"))
        state = _cut(state.join(seen, "proposal_id", "left").select("proposal_id", F.when(F.col("keep").isNotNull(), F.col("keep")).when(F.coalesce("beaten", F.lit(False)), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True)).alias("keep")))
        if state.filter("keep is null").isEmpty():
            break
    return nms_first(members.join(state.filter("keep"), "proposal_id", "left_semi"), scores)


def deoverlap(members: DataFrame, scores: DataFrame, ids: DataFrame, th_pos: float = -1, th_iou: float = 1.0) -> DataFrame:
    """(id, component): proposals with score th_pos or more after NMS; uncovered ids alone."""
    good = scores.filter(F.col("score") >= th_pos)
    chosen = nms(members.join(good, "proposal_id", "left_semi"), good, th_iou)
    least = chosen.join(chosen.groupBy("proposal_id").agg(F.min("node").alias("component")), "proposal_id").select(F.col("node").alias("id"), "component")
    return with_singletons(ids, least)


def cluster_statistics(members: DataFrame, labels: DataFrame) -> DataFrame:
    """proposal_id, majority label, size, and overlap of the proposal with that label's rows (iou, iop, iog)."""
    counts = members.join(labels.toDF("node", "label"), "node").groupBy("proposal_id", "label").agg(F.count("*").alias("n"))
    best = counts.groupBy("proposal_id").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"), F.sum("n").alias("size")).select("proposal_id", (-F.col("b.l")).alias("label"), F.col("b.n").alias("hit"), "size")
    full = labels.toDF("node", "label").groupBy("label").agg(F.count("*").alias("truth"))
    return best.join(full, "label").select("proposal_id", "label", "size", (F.col("hit") / (F.col("size") + F.col("truth") - F.col("hit"))).alias("iou"), (F.col("hit") / F.col("size")).alias("iop"), (F.col("hit") / F.col("truth")).alias("iog"))


def whispers(edges: DataFrame, ids: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, label): all nodes take at once the label with the largest summed weight around them, the smallest on ties; a node without edges keeps its own."""
    labels = _cut(ids.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        votes = edges.join(labels.toDF("dst", "label"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("label")).alias("l"))).alias("b")).select(F.col("src").alias("id"), (-F.col("b.l")).alias("new"))
        labels = _cut(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")))
    return labels


def kmeans(df: DataFrame, n_clusters: int, seed: int = 0) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select("id", array_to_vector("vec").alias("features"))
    return KMeans(k=n_clusters, seed=seed).fit(rows).transform(rows).select("id", F.col("prediction").cast("long").alias("label"))


def spectral(edges: DataFrame, n_clusters: int, rounds: int = 20) -> DataFrame:
    """Power iteration clustering of a weighted graph (src, dst, w)."""
    from pyspark.ml.clustering import PowerIterationClustering

    model = PowerIterationClustering(k=n_clusters, maxIter=rounds, weightCol="w")
    return model.assignClusters(edges.filter("src < dst")).select("id", F.col("cluster").cast("long").alias("label"))


#: Clusterings by name, each from (id, vec) to (id, label).
CLUSTERERS: dict[str, Callable[..., DataFrame]] = {
    "single_linkage": lambda df, distance=0.5: single_linkage(df, distance).withColumnRenamed("component", "label"),
    "hierarchy": lambda df, distance=0.5, batchsize=20_000, linkage="complete": batched_hierarchical(df, distance, batchsize, linkage),
    "dbscan": lambda df, eps=0.25, min_samples=1: dbscan(df, eps, min_samples).select("id", "label"),
    "kmeans": lambda df, n_clusters=2: kmeans(df, n_clusters),
    "aro": lambda df, k=80, th_sim=0.6: with_singletons(df.select("id"), components(rank_order(knn_join(df, k), th_sim))).withColumnRenamed("component", "label"),
    "chinese_whispers": lambda df, t=0.5, rounds=20: whispers(_weighted(df, t), df.select("id"), rounds),
}


def _weighted(df: DataFrame, t: float) -> DataFrame:
    near = threshold_join(df, t)
    return near.select("src", "dst", (1 - F.col("dist")).alias("w")).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (1 - F.col("dist")).alias("w")))


def cluster(df: DataFrame, method: str, **options) -> DataFrame:
    if method not in CLUSTERERS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(CLUSTERERS)}")
    return CLUSTERERS[method](df, **options)
