"""Distances between rows: kNN joins, threshold joins, graphs of neighbours.

All-pairs work is done block against block: vectors are packed to blocks of about BLOCK rows, a task multiplies one block
with others, in single precision as far as that decides, and only what passes the threshold or is among its rows' nearest
leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block; a task holds two blocks, and multiplies TILE rows with TILE columns at a time.
BLOCK = 8192
TILE = 1024
#: Pairs of blocks of a task; they reach Python as one batch.
PAIRS = 8
#: By how much a product of unit vectors in single precision may be off; what is closer to a bound is multiplied in double precision.
SLACK = 1e-5
#: Pairs that are multiplied in double precision at once.
CHECKED = 1 << 15


def packed(df: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(b, ids, vecs) of a frame (id, vec), vectors at length 1; the number of blocks. Null and zero vectors take no part."""
    rows = df.select(F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0))
    blocks = max(1, -(-rows.count() // block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            b, ids = (batch.column(c).to_numpy() for c in ("b", "id"))
            vec, ok = units(batch.column("vec"), len(ids))
            for k in np.unique(b[ok]):
                held.setdefault(int(k), []).append((ids[ok][b[ok] == k], vec[b[ok] == k]))
        for k, parts in held.items():
            yield blob([k], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), "b")

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(blocks, "b")
    return dealt.mapInArrow(pack, "b int, ids binary, vecs binary"), blocks


def units(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length 1 without those of length 0, and which are not."""
    vec = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    size = np.sqrt((vec * vec).sum(1))
    ok = size > 0
    return vec[ok] / size[ok, None], ok


def blob(key: list[int], ids: np.ndarray, vecs: np.ndarray, *names: str) -> pa.RecordBatch:
    """One row of a block."""
    return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int32()) for k in key], pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary())], [*names, "ids", "vecs"])


def block_pairs(df: DataFrame, kernel: Callable, schema: str, upper: bool, block: int = BLOCK) -> DataFrame:
    """kernel(pairs of blocks) -> columns, again and again; pairs are (x, ids, vecs, y, ids, vecs), x <= y if `upper`, all pairs else.

    The pairs of a block x come one after the other, so that a kernel can keep what it knows of x. Blocks are written once to
    the shared folder and read from there by the tasks: the product shuffles nothing.
    """
    from .graph import _cut

    blobs, n = packed(df, block)
    blobs = _cut(blobs)
    left, right = blobs.toDF("x", "xi", "xv"), blobs.toDF("y", "yi", "yv").hint("shuffle_replicate_nl")
    pairs = left.join(right, F.col("x") <= F.col("y")) if upper else left.crossJoin(right)
    pairs = pairs.coalesce(-(-n * n // PAIRS))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for i in range(batch.num_rows):
                    x, xi, xv, y, yi, yv = (batch.column(c)[i] for c in ("x", "xi", "xv", "y", "yi", "yv"))
                    xi, yi = np.frombuffer(xi.as_buffer(), np.int64), np.frombuffer(yi.as_buffer(), np.int64)
                    yield x.as_py(), xi, np.frombuffer(xv.as_buffer()).reshape(len(xi), -1), y.as_py(), yi, np.frombuffer(yv.as_buffer()).reshape(len(yi), -1)

        for columns in kernel(blocks()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return pairs.mapInArrow(run, schema)


def hits(xv: np.ndarray, yv: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of pairs whose distance may be at most t (one for each row of xv, read anew for each tile of columns)."""
    x, y = xv.astype(np.float32), yv.astype(np.float32)
    for a in range(0, len(x), TILE):
        for b in range(0, len(y), TILE):
            bound = (1 - SLACK - t[a : a + TILE]).astype(np.float32)
            i, j = np.divmod(np.flatnonzero(x[a : a + TILE] @ y[b : b + TILE].T >= bound[:, None]), len(y[b : b + TILE]))
            if len(i):
                for c in range(0, len(i), CHECKED):
                    k, m = i[c : c + CHECKED] + a, j[c : c + CHECKED] + b
                    yield k, m, 1.0 - np.einsum("ij,ij->i", xv[k], yv[m])


def threshold_join(df: DataFrame, t: float, closed: bool = True, block: int = BLOCK) -> DataFrame:
    """(src, dst, dist) of pairs src < dst with cosine distance <= t (< t unless closed)."""

    def near(pairs):
        for x, xi, xv, y, yi, yv in pairs:
            for i, j, d in hits(xv, yv, np.full(len(xi), t)):
                ok = d <= t if closed else d < t
                if x == y:
                    ok &= xi[i] < yi[j]
                yield np.minimum(xi[i], yi[j])[ok], np.maximum(xi[i], yi[j])[ok], d[ok]

    return block_pairs(df, near, "src long, dst long, dist double", True, block)


class Nearest:
    """The k nearest so far of each row of a block, by distance rounded to 12 places and id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.dist, self.dst = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        #: What a distance must not exceed; infinite until k are known.
        self.bound = np.full(len(ids), np.inf)

    def add(self, xv: np.ndarray, yi: np.ndarray, yv: np.ndarray) -> None:
        first = min(len(yi), max(TILE, 2 * self.k))
        if not np.isfinite(self.bound).all():  # the first rows as they are, so that there is a bound
            for a in range(0, len(xv), TILE) if first > self.k else ():
                d = np.partition(1.0 - xv[a : a + TILE] @ yv[:first].T, self.k, axis=1)[:, self.k]  # one of them may be the row itself
                self.bound[a : a + TILE] = np.minimum(self.bound[a : a + TILE], d)
            self.bound = np.where(np.isfinite(self.bound), self.bound + 1e-11, np.inf)
        open_rows = np.where(np.isfinite(self.bound), self.bound, 3.0)
        for b in range(0, len(yi), 8 * TILE):
            rows, cols, dist = [], [], []
            for i, j, d in hits(xv, yv[b : b + 8 * TILE], open_rows):
                ok = (d <= open_rows[i]) & (self.ids[i] != yi[b + j])
                rows.append(i[ok])
                cols.append(yi[b + j[ok]])
                dist.append(d[ok])
            if rows:
                self._merge(np.concatenate(rows), np.concatenate(cols), np.concatenate(dist))
                open_rows = np.where(np.isfinite(self.bound), self.bound, 3.0)

    def _merge(self, i: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> None:
        changed = np.unique(i)
        i = np.concatenate([i, np.repeat(changed, self.k)])
        dst, dist = np.concatenate([dst, self.dst[changed].ravel()]), np.concatenate([dist, self.dist[changed].ravel()])
        order = np.lexsort((dst, np.round(dist, 12), i))
        i, dst, dist = i[order], dst[order], dist[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < self.k
        self.dst[i[top], rank[top]], self.dist[i[top], rank[top]] = dst[top], dist[top]
        last = self.dist[changed, -1] + 1e-11
        self.bound[changed] = np.where(np.isfinite(last), np.minimum(self.bound[changed], last), self.bound[changed])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        real = np.isfinite(self.dist)
        return np.repeat(self.ids, real.sum(1)), self.dst[real], self.dist[real]


def knn_join(df: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(src, rank, dst, dist): the k nearest other rows by cosine distance, ties by id."""

    def nearest(pairs):
        at, best = None, None
        for x, xi, xv, _, yi, yv in pairs:
            if x != at:
                if best is not None:
                    yield best.rows()
                at, best = x, Nearest(xi, k)
            best.add(xv, yi, yv)
        if best is not None:
            yield best.rows()

    return ranked(block_pairs(df, nearest, "src long, dst long, dist double", False, block), k)


def ranked(partial: DataFrame, k: int) -> DataFrame:
    """(src, rank, dst, dist): the k first rows of each src."""
    order = Window.partitionBy("src").orderBy(F.round("dist", 12), "dst")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("src", "rank", "dst", "dist")


def filter_knn_pairs(knn: DataFrame, th: float) -> DataFrame:
    """Unordered pairs with similarity th or more, the nearest entry of each."""
    return knn.filter((F.col("src") != F.col("dst")) & (F.col("dst") >= 0) & (1 - F.col("dist") >= th)).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("dist").alias("dist"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Element-wise maximum of a weighted graph and its transpose."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").unionByName(back).groupBy("src", "dst").agg(F.max("w").alias("w"))


def row_normalised(edges: DataFrame) -> DataFrame:
    """w over the row's sum; rows that sum to 0 or less as they are. Sums are made before rows meet."""
    sums = edges.groupBy("src").agg(F.sum("w").alias("s"))
    return edges.join(sums, "src").select("src", "dst", F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(F.col("w")).alias("w"))


def propagate(features: DataFrame, edges: DataFrame, times: int = 1) -> DataFrame:
    """(id, i, x): long vectors multiplied by the graph."""
    for _ in range(times):
        features = edges.join(features.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "i").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return features


def centroids(df: DataFrame, by: str = "label") -> DataFrame:
    """(label, vec, n): the mean vector of each label, summed by component so that no group is gathered."""
    long = df.select(F.col(by).alias("label"), F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"), F.max("n").alias("n"))


def density(knn: DataFrame, radius: float = 0.3, use_weight: bool = True) -> DataFrame:
    near = F.col("dist") < radius
    value = F.sum(F.when(near, 1 - F.col("dist")).otherwise(0.0)) if use_weight else F.sum(near.cast("double"))
    return knn.groupBy("src").agg(value.alias("density"))


def label_agreement(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """knn with `same`: whether both ends have one label; labels: (id, label)."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return knn.join(a, "src").join(b, "dst").withColumn("same", F.col("a") == F.col("b"))


def distance_expression(name: str) -> Callable[[Column, Column], Column]:
    """Distances by name."""
    from ..functions import vectors

    known = {"cosine": vectors.cosine_distance, "euclidean": vectors.euclidean}
    if name not in known:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(known)}")
    return known[name]


# -- approximate joins ---------------------------------------------------------------------------------------------

#: Rows that centres of cells are fitted on; all rows are indexed.
SAMPLE = 50_000


def ivf_knn(df: DataFrame, k: int, cells: int | None = None, nprobe: int = 8, seed: int = 0, queries: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(src, rank, dst, dist) from an inverted file: k-means cells fitted on a bounded sample, every row in its nearest cell, each row that meets `queries` (all by default) asks its nprobe nearest cells.

    A cell's rows are packed to blocks, which its queries are multiplied with block by block, and ranked by exact distance;
    recall grows with nprobe and is 1 at nprobe = cells.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .graph import _cut

    asks = queries if queries is not None else F.lit(True)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, ok = units(batch.column(1), batch.num_rows)
            ends = np.arange(0, vec.size + 1, vec.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.ListArray.from_arrays(pa.array(ends), pa.array(vec.ravel()))], ["id", "vec"])

    known = df.select(F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = _cut(known.mapInArrow(scaled, "id long, vec array<double>"))
    n = rows.count()
    cells = cells or max(1, min(4096, int(8 * n**0.5) // 8))
    sample = rows.sample(min(1.0, SAMPLE / max(1, n)), seed).select(array_to_vector("vec").alias("features"))
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(sample).clusterCenters())
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            far = (c * c).sum(1)[None] - 2 * x @ c.T
            near = np.argsort(far, axis=1, kind="stable")[:, : min(nprobe, len(c))].astype(np.int32)
            ends = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel())), batch.column(2)], ["id", "vec", "cells", "asks"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            cell, ids = (batch.column(c).to_numpy() for c in ("cell", "id"))
            vec, ok = units(batch.column("vec"), len(ids))
            for c in np.unique(cell[ok]):
                held.setdefault(int(c), []).append((ids[ok][cell[ok] == c], vec[cell[ok] == c]))
                if sum(len(p[0]) for p in held[int(c)]) >= block:
                    parts = held.pop(int(c))
                    yield blob([int(c)], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), "cell")
        for c, parts in held.items():
            yield blob([c], np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), "cell")

    def blobs(part: DataFrame) -> DataFrame:
        """Cells as blocks; a cell's rows are dealt to as many parts as blocks hold them all, so that a large cell is no single task."""
        dealt = part.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, n // (4 * block)))))
        return dealt.repartition("cell", "part").select("cell", "id", "vec").mapInArrow(pack, "cell int, ids binary, vecs binary")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                xi, xv, yi, yv = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("xi", np.int64), ("xv", np.float64), ("yi", np.int64), ("yv", np.float64)))
                best = Nearest(xi, k)
                best.add(xv.reshape(len(xi), -1), yi, yv.reshape(len(yi), -1))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], ["src", "dst", "dist"])

    probed = rows.withColumn("asks", asks).mapInArrow(probe, "id long, vec array<double>, cells array<int>, asks boolean")
    index = blobs(probed.select(F.col("cells")[0].alias("cell"), "id", "vec")).toDF("cell", "yi", "yv")
    asked = blobs(probed.filter("asks").select(F.explode("cells").alias("cell"), "id", "vec")).toDF("cell", "xi", "xv")
    found = asked.join(index.hint("shuffle_hash"), "cell").select("xi", "xv", "yi", "yv")
    return ranked(found.mapInArrow(nearest, "src long, dst long, dist double"), k)


def lsh_join(df: DataFrame, t: float, bucket: float = 1.0, tables: int = 8, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(src, dst, dist): the pairs src < dst within cosine distance t, by random projections of unit vectors.

    Two unit vectors within t differ by at most sqrt(2 t) in each projection on a unit vector, so pairs of tiles whose
    buckets (of that width times `bucket`) are further apart in one of the projections are never multiplied, and no pair
    is lost.
    """

    def near(pairs):
        for x, xi, xv, y, yi, yv in pairs:
            for a, b in tiles(xv, yv, t, bucket, tables, seed):
                for i, j, d in hits(xv[a], yv[b], np.full(len(a), t)):
                    src, dst = xi[a][i], yi[b][j]
                    ok = (d <= t) & (src < dst) if x == y else d <= t
                    yield np.minimum(src, dst)[ok], np.maximum(src, dst)[ok], d[ok]

    return block_pairs(df, near, "src long, dst long, dist double", True, block)


def tiles(xv: np.ndarray, yv: np.ndarray, t: float, bucket: float, tables: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of either side that have pairs within t to each other, as far as their projections tell."""
    lines = np.random.default_rng(seed).normal(size=(xv.shape[1], max(1, tables)))
    lines /= np.sqrt((lines * lines).sum(0))
    reach = (2 * t) ** 0.5 + 1e-9

    def cut(vecs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        p = vecs @ lines
        order = np.lexsort(np.floor(p / max(bucket * reach, 1e-9)).T[::-1])
        parts = [order[at : at + TILE] for at in range(0, len(order), TILE)]
        return [(part, p[part].min(0), p[part].max(0)) for part in parts]

    others = cut(yv)
    for part, low, high in cut(xv):
        met = [other for other, lo, hi in others if (lo <= high + reach).all() and (low <= hi + reach).all()]
        if met:
            yield part, np.concatenate(met)


def lsh_groups(df: DataFrame, t: float, bucket: float = 1.0, tables: int = 8, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(id, component, n_links) of every row: the least id that links of `lsh_join` reach, and how many links the row has itself.

    Links are counted where blocks are multiplied, and only a forest that spans the same components leaves there.
    """
    from .graph import _cut, components

    def linked(pairs):
        for x, xi, xv, y, yi, yv in pairs:
            nodes = np.concatenate([xi, yi]) if x != y else xi
            shift = len(xi) if x != y else 0
            count, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
            for a, b in tiles(xv, yv, t, bucket, tables, seed):
                for i, j, d in hits(xv[a], yv[b], np.full(len(a), t)):
                    i, j = a[i], b[j]
                    ok = (d <= t) & ((xi[i] < yi[j]) if x == y else True)
                    i, j = i[ok], j[ok] + shift
                    count += np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
                    root = united(root, i, j)
            some = np.flatnonzero(count)
            yield nodes[some], nodes[root[some]], count[some]

    found = _cut(block_pairs(df, linked, "src long, dst long, n long", True, block))
    comp = components(found.select("src", "dst"))
    counts = found.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("n"))
    ids = df.select(F.col("id").cast("long").alias("id"))
    return ids.join(counts, "id", "left").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.coalesce("n", F.lit(0)).alias("n_links"))


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots (the least member of each set) after the sets of i and j have been united, pair by pair."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j = i[apart], j[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        root = root.copy()
        np.minimum.at(root, high, low)
        while True:  # every row to the root of its root
            further = root[root]
            if (further == root).all():
                break
            root = further


def template_means(df: DataFrame, most: int = 32, seed: int = 0) -> DataFrame:
    """(track, vec): the mean vector of at most `most` rows of a track, taken in hashed order; df: track, id, vec."""
    chosen = df.withColumn("r", F.row_number().over(Window.partitionBy("track").orderBy(F.xxhash64("id", F.lit(seed)), "id"))).filter(F.col("r") <= most)
    return centroids(chosen, "track").select(F.col("label").alias("track"), "vec")


def two_hop(edges: DataFrame, k1: int, k2: int) -> DataFrame:
    """(centre, node): the k1 nearest of a centre, the k2 nearest of those, and the centre; edges: src, rank, dst."""
    first = edges.filter(F.col("rank") <= k1).select(F.col("src").alias("centre"), F.col("dst").alias("node"))
    second = first.join(edges.filter(F.col("rank") <= k2).select(F.col("src").alias("node"), "dst"), "node").select("centre", F.col("dst").alias("node"))
    return first.unionByName(second).unionByName(edges.select(F.col("src").alias("centre"), F.col("src").alias("node"))).distinct()


def sub_graph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges within a set of ids, numbered 0, 1, ... in id order."""
    numbered = ids.select("id").distinct().withColumn("n", F.row_number().over(Window.orderBy("id")) - 1)
    return edges.join(numbered.toDF("src", "a"), "src").join(numbered.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])
