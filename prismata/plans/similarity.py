"""Queries over embeddings: distances, neighbours, graphs, clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clustering as C
from ..operators import labels as L
from ..operators import similarity as S
from ..operators.graph import _cut, components
from .registry import query, table

K = 10
#: A distance at which the test embeddings form groups.
T = 0.65


def _emb(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"))


def _knn(spark, sf_dir, k: int = K) -> DataFrame:
    return S.knn_join(_emb(spark, sf_dir), k)


# SQL parts
E = "e AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
U = E + ", u AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"
P = U + ", p AS (SELECT a.id AS src, b.id AS dst, a.label AS la, b.label AS lb, 1 - list_dot_product(a.v, b.v) AS dist FROM u a JOIN u b ON a.id <> b.id)"
N = P + f", k AS (SELECT src, rank, dst, dist, la, lb FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(dist, 12), dst) AS rank FROM p) WHERE rank <= {K})"
M = E + ", m AS (SELECT label, list(x ORDER BY i) AS v, max(n) AS n FROM (SELECT label, i, avg(v[i]) AS x, count(*) AS n FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY label, i) GROUP BY label)"
COS = "1 - list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"


def _closure(edges: str, ids: str = "SELECT id FROM e") -> str:
    """CTEs from edges (x, y) to c (id, component)."""
    return f"b AS ({edges}), w AS (SELECT x, y FROM b UNION SELECT y, x FROM b), r AS (WITH RECURSIVE t AS (SELECT id AS x, id AS y FROM ({ids}) UNION SELECT t.x, w.y FROM t JOIN w ON t.y = w.x) SELECT * FROM t), c AS (SELECT x AS id, min(y) AS component FROM r GROUP BY x)"


@query(f"WITH {M} SELECT label, i - 1 AS i, round(v[i], 6) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM m)")
def centroid_components(spark, sf_dir):
    return S.centroids(_emb(spark, sf_dir)).select("label", F.posexplode("vec").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {M} SELECT a.label AS c1, b.label AS c2, round({COS}, 6) AS dist FROM m a JOIN m b ON a.label < b.label")
def centroid_distance_pairs(spark, sf_dir):
    c = S.centroids(_emb(spark, sf_dir)).select(F.col("label").alias("id"), "vec")
    return S.threshold_join(c, 2.0).select(F.col("src").alias("c1"), F.col("dst").alias("c2"), F.round("dist", 6).alias("dist"))


_MATCH = "SELECT c1, c2, round(dist, 4) AS dist FROM (SELECT *, min(dist) OVER (PARTITION BY c1) AS nearest FROM d WHERE dist <= {hi} AND abs(dist) > 1e-12) WHERE nearest < {lo}"


@query(f"WITH {M}, d AS (SELECT a.label AS c1, b.label AS c2, {COS} AS dist FROM m a JOIN m b ON a.label < b.label) " + _MATCH.format(lo=0.9, hi=1.1))
def cluster_match_average(spark, sf_dir):
    return C.match_clusters(_emb(spark, sf_dir), "average", None, 0.9, 1.1)


@query(f"WITH {P}, d AS (SELECT la AS c1, lb AS c2, min(dist) AS dist FROM p WHERE la < lb GROUP BY la, lb) " + _MATCH.format(lo=0.5, hi=0.7))
def cluster_match_single(spark, sf_dir):
    return C.match_clusters(_emb(spark, sf_dir), "single", None, 0.5, 0.7)


@query(
    f"""WITH {M}, u AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
g AS (SELECT label, s, t FROM (SELECT a.label, a.id AS s, b.id AS t, row_number() OVER (PARTITION BY a.label ORDER BY round(1 - list_dot_product(a.v, b.v), 12) DESC, a.id, b.id) AS r FROM u a JOIN u b ON a.label = b.label) WHERE r = 1),
f AS (SELECT label, v FROM m UNION ALL SELECT g.label, u.v FROM g JOIN u ON u.id = g.s UNION ALL SELECT g.label, u.v FROM g JOIN u ON u.id = g.t),
d AS (SELECT a.label AS c1, b.label AS c2, min({COS}) AS dist FROM f a JOIN f b ON a.label <> b.label GROUP BY 1, 2) """
    + _MATCH.format(lo=0.8, hi=1.0)
)
def cluster_match_triplet(spark, sf_dir):
    return C.match_clusters(_emb(spark, sf_dir), "triplet", None, 0.8, 1.0)


@query(f"WITH {N} SELECT src, CAST(rank AS INTEGER) AS rank, dst, round(dist, 6) AS dist FROM k")
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query(f"WITH {N}, s AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT round(avg(h / n), 6) AS recall, count_if(h = 0) AS isolated FROM (SELECT src, la, count_if(la = lb) AS h FROM k GROUP BY src, la) JOIN s ON s.label = la")
def knn_recall(spark, sf_dir):
    e = _emb(spark, sf_dir).select("id", "label")
    hits = S.label_agreement(_knn(spark, sf_dir), e).groupBy("src", F.col("a").alias("label")).agg(F.count_if("same").alias("h"))
    return hits.join(e.groupBy("label").count(), "label").agg(F.round(F.avg(F.col("h") / F.col("count")), 6).alias("recall"), F.count_if(F.col("h") == 0).alias("isolated"))


@query(f"WITH {N} SELECT src, round(min(dist), 6) AS least, round(avg(dist), 6) AS mean, round(max(dist), 6) AS most FROM k GROUP BY src")
def knn_distance_stats(spark, sf_dir):
    return _knn(spark, sf_dir).groupBy("src").agg(F.round(F.min("dist"), 6).alias("least"), F.round(F.avg("dist"), 6).alias("mean"), F.round(F.max("dist"), 6).alias("most"))


@query(f"WITH {N} SELECT src, round(coalesce(min(CASE WHEN dist <= 0.7 THEN dist END), 0.7), 6) AS below_min, round(coalesce(avg(CASE WHEN dist <= 0.7 THEN dist END), 0.7), 6) AS below_mean, round(coalesce(avg(CASE WHEN dist > 0.7 THEN dist END), 0.7), 6) AS above_mean, round(coalesce(max(CASE WHEN dist > 0.7 THEN dist END), 0.7), 6) AS above_max FROM k GROUP BY src")
def knn_threshold_stats(spark, sf_dir):
    t = 0.7
    lo, hi = F.when(F.col("dist") <= t, F.col("dist")), F.when(F.col("dist") > t, F.col("dist"))
    part = lambda f, x, name: F.round(F.coalesce(f(x), F.lit(t)), 6).alias(name)
    return _knn(spark, sf_dir).groupBy("src").agg(part(F.min, lo, "below_min"), part(F.avg, lo, "below_mean"), part(F.avg, hi, "above_mean"), part(F.max, hi, "above_max"))


@query(f"WITH {N} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(min(dist), 6) AS dist FROM k WHERE 1 - dist >= 0.3 GROUP BY 1, 2")
def filter_knn_pairs(spark, sf_dir):
    return S.filter_knn_pairs(_knn(spark, sf_dir), 0.3).withColumn("dist", F.round("dist", 6))


_SYM = f"{N}, s AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, 1 - dist AS w FROM k UNION ALL SELECT dst, src, 1 - dist FROM k) GROUP BY src, dst)"


@query(f"WITH {_SYM} SELECT src, dst, round(w, 6) AS w FROM s")
def sym_adj(spark, sf_dir):
    return S.symmetric(_knn(spark, sf_dir).select("src", "dst", (1 - F.col("dist")).alias("w"))).withColumn("w", F.round("w", 6))


@query(f"WITH {_SYM} SELECT src, dst, round(CASE WHEN t > 0 THEN w / t ELSE w END, 6) AS w FROM (SELECT *, sum(w) OVER (PARTITION BY src) AS t FROM s)")
def row_norm_adj(spark, sf_dir):
    return S.row_normalised(S.symmetric(_knn(spark, sf_dir).select("src", "dst", (1 - F.col("dist")).alias("w")))).withColumn("w", F.round("w", 6))


@query(f"WITH {_SYM}, a AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM s), f AS (SELECT id, i - 1 AS i, v[i] AS x FROM (SELECT id, v, unnest(range(1, len(v) + 1)) AS i FROM e)) SELECT a.src AS id, f.i, round(sum(a.w * f.x), 6) AS x FROM a JOIN f ON a.dst = f.id GROUP BY a.src, f.i")
def propagate(spark, sf_dir):
    adj = S.row_normalised(S.symmetric(_knn(spark, sf_dir).select("src", "dst", (1 - F.col("dist")).alias("w"))))
    long = _emb(spark, sf_dir).select("id", F.posexplode(V.doubles(F.col("vec"))).alias("i", "x")).withColumn("i", F.col("i").cast("long"))
    return S.propagate(long, adj).withColumn("x", F.round("x", 6))


@query(f"WITH {N} SELECT src, round(sum(CASE WHEN dist < 0.7 THEN 1 - dist ELSE 0 END), 6) AS density FROM k GROUP BY src")
def density(spark, sf_dir):
    return S.density(_knn(spark, sf_dir), 0.7).withColumn("density", F.round("density", 6))


_NBR = "sum(CASE WHEN la = lb THEN 1 - dist ELSE dist - 1 END)"


def _agreement(spark, sf_dir) -> DataFrame:
    j = S.label_agreement(_knn(spark, sf_dir), _emb(spark, sf_dir).select("id", "label"))
    return j.groupBy("src", F.col("a").alias("label")).agg(F.sum(F.when(F.col("same"), 1 - F.col("dist")).otherwise(F.col("dist") - 1)).alias("s"))


@query(f"WITH {N}, s AS (SELECT src, {_NBR} AS s FROM k GROUP BY src) SELECT src, round(s / max(abs(s)) OVER (), 6) AS confidence FROM s")
def conf_s_nbr(spark, sf_dir):
    s = _agreement(spark, sf_dir)
    top = s.agg(F.max(F.abs("s")).alias("top"))
    return s.join(F.broadcast(top)).select("src", F.round(F.col("s") / F.col("top"), 6).alias("confidence"))


@query(f"WITH {N}, s AS (SELECT src, {_NBR} AS s, count(*) AS n FROM k GROUP BY src) SELECT src, round(s / max(n) OVER (), 6) AS confidence FROM s")
def conf_s_nbr_size_norm(spark, sf_dir):
    """Over the largest number of neighbours of any row."""
    most = _knn(spark, sf_dir).groupBy("src").count().agg(F.max("count").alias("most"))
    return _agreement(spark, sf_dir).join(F.broadcast(most)).select("src", F.round(F.col("s") / F.col("most"), 6).alias("confidence"))


def _unit_means(spark, sf_dir) -> DataFrame:
    unit = _emb(spark, sf_dir).withColumn("vec", V.normalise(F.col("vec")))
    return unit.join(S.centroids(unit).select("label", F.col("vec").alias("c"), "n"), "label")


@query(f"WITH {P} SELECT e.id, round((coalesce(sum(1 - dist), 0) + 1) / (count(p.src) + 1), 6) AS confidence FROM e LEFT JOIN p ON p.src = e.id AND la = lb GROUP BY e.id")
def conf_s_center(spark, sf_dir):
    """Inner product of a unit vector with the mean of its label's unit vectors, which is not normalised again."""
    return _unit_means(spark, sf_dir).select("id", F.round(V.inner_product(F.col("vec"), F.col("c")), 6).alias("confidence"))


@query(f"WITH {P} SELECT e.id, round(coalesce(avg(1 - dist), 0), 6) AS confidence FROM e LEFT JOIN p ON p.src = e.id AND la = lb GROUP BY e.id")
def conf_s_avg(spark, sf_dir):
    """Mean similarity to the label's other members, from the label's vector sum; 0 for a row alone in its label."""
    others = (V.inner_product(F.col("vec"), F.col("c")) * F.col("n") - 1) / (F.col("n") - 1)
    return _unit_means(spark, sf_dir).select("id", F.round(F.when(F.col("n") > 1, others).otherwise(0.0), 6).alias("confidence"))


@query(f"WITH {P}, {_closure(f'SELECT src AS x, dst AS y FROM p WHERE src < dst AND dist <= {T}')} SELECT id, component FROM c")
def single_linkage_cut(spark, sf_dir):
    return C.single_linkage(_emb(spark, sf_dir), T)


@query(
    """WITH l AS (SELECT l_orderkey AS o, l_partkey AS id FROM lineitem WHERE l_partkey IS NOT NULL), h AS (SELECT o, min(id) AS h FROM l WHERE o IS NOT NULL GROUP BY o),
w AS (SELECT id AS x, h AS y FROM l JOIN h USING (o) WHERE id <> h UNION SELECT h, id FROM l JOIN h USING (o) WHERE id <> h),
r AS (WITH RECURSIVE t(id, component) USING KEY (id) AS (SELECT DISTINCT id, id AS component FROM l UNION SELECT w.x, min(t.component) FROM t JOIN w ON w.y = t.id JOIN recurring.t c ON c.id = w.x WHERE t.component < c.component GROUP BY w.x) SELECT * FROM t)
SELECT id, component FROM r"""
)
def connected_components(spark, sf_dir):
    """Parts that occur in one order, over all orders and parts; each order is a star at its least part."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src")).filter(F.col("src").isNotNull())
    hub = l.filter(F.col("l_orderkey").isNotNull()).groupBy("l_orderkey").agg(F.min("src").alias("dst"))
    return C.with_singletons(l.select(F.col("src").alias("id")).distinct(), components(l.join(hub, "l_orderkey").select("src", "dst")))


_CONF = f"{N}, f AS (SELECT src AS id, avg(1 - dist) AS c FROM k GROUP BY src), q AS (SELECT src, dst, dist FROM (SELECT k.src, k.dst, k.dist, row_number() OVER (PARTITION BY k.src ORDER BY k.rank) AS r FROM k JOIN f a ON a.id = k.src JOIN f b ON b.id = k.dst WHERE round(b.c, 9) >= round(a.c, 9) - 1e-4) WHERE r <= 1)"


def _confidence(knn: DataFrame) -> DataFrame:
    return knn.groupBy(F.col("src").alias("id")).agg(F.round(F.avg(1 - F.col("dist")), 9).alias("confidence"))


@query(f"WITH {_CONF}, {_closure('SELECT src AS x, dst AS y FROM q WHERE dist < 0.7')} SELECT id, component FROM c")
def peaks_labels(spark, sf_dir):
    knn = _knn(spark, sf_dir)
    return C.peaks_labels(C.peaks(knn, _confidence(knn)), _emb(spark, sf_dir).select("id"), 0.3)


@query(f"WITH {_CONF} SELECT src, dst, round(dist, 6) AS dist FROM q")
def confidence_peaks(spark, sf_dir):
    knn = _knn(spark, sf_dir)
    return C.peaks(knn, _confidence(knn)).withColumn("dist", F.round("dist", 6))


@query(
    f"WITH {P}, h AS (SELECT src, dst FROM p WHERE dist <= {T}), o AS (SELECT src AS id FROM h GROUP BY src HAVING count(*) + 1 >= 3), "
    + _closure("SELECT src AS x, dst AS y FROM h WHERE src IN (FROM o) AND dst IN (FROM o)", "SELECT id FROM o")
    + ", g AS (SELECT h.src AS id, arg_min(c.component, h.dst) AS near FROM h JOIN c ON c.id = h.dst GROUP BY h.src) SELECT e.id, coalesce(c.component, g.near, -1) AS label, c.component IS NOT NULL AS core FROM e LEFT JOIN c ON c.id = e.id LEFT JOIN g ON g.id = e.id"
)
def dbscan(spark, sf_dir):
    return C.dbscan(_emb(spark, sf_dir), T, 3)


@query(
    f"""WITH {N}, x AS (SELECT a.src, a.dst, a.rank AS o, b.rank AS q FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src),
y AS (SELECT x.src, x.dst, x.o, x.q, (SELECT count(*) FROM k WHERE k.src = x.src AND k.rank < x.o AND k.dst NOT IN (SELECT z.dst FROM k z WHERE z.src = x.dst)) + (SELECT count(*) FROM k WHERE k.src = x.dst AND k.rank < x.q AND k.dst NOT IN (SELECT z.dst FROM k z WHERE z.src = x.src)) AS m FROM x),
"""
    + _closure("SELECT src AS x, dst AS y FROM y WHERE m / least(o, q + 1) <= 0.5")
    + " SELECT id, component FROM c"
)
def aro(spark, sf_dir):
    return C.with_singletons(_emb(spark, sf_dir).select("id"), components(C.rank_order(_knn(spark, sf_dir), 0.5)))


@query(
    f"WITH {N}, a AS (SELECT src, dst FROM k WHERE 1 - dist > 0.3), g AS (SELECT src, count(*) AS n FROM a GROUP BY src), s AS (SELECT i.src, j.dst, count(*) AS n FROM a i JOIN a j ON i.dst = j.src JOIN a t ON t.src = i.src AND t.dst = j.dst GROUP BY 1, 2), "
    + _closure("SELECT s.src AS x, s.dst AS y FROM s JOIN g p ON p.src = s.src JOIN g q ON q.src = s.dst WHERE greatest(s.n / p.n, s.n / q.n) > 0.3")
    + " SELECT id, component FROM c"
)
def star_two_threshold(spark, sf_dir):
    links = C.two_threshold_links(_knn(spark, sf_dir), 0.3, 0.3)
    return C.with_singletons(_emb(spark, sf_dir).select("id"), components(links))


@query(
    f"WITH {M}, d AS (SELECT a.label AS x, b.label AS y, {COS} AS dist FROM m a JOIN m b ON a.label < b.label), "
    + _closure("SELECT x, y FROM d WHERE dist < 0.95", "SELECT label AS id FROM m")
    + ", k AS (SELECT arg_max(c.id, struct_pack(n := m.n, l := -c.id)) AS label FROM c JOIN m ON m.label = c.id GROUP BY c.component), z AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS new_label FROM k) SELECT e.id, e.label, z.new_label FROM e JOIN z USING (label)"
)
def dup_class_removal(spark, sf_dir):
    return C.remove_duplicate_classes(_emb(spark, sf_dir), 0.95).select("id", "label", "new_label")


@query()
def constrained_components(spark, sf_dir):
    near = S.threshold_join(_emb(spark, sf_dir), 0.68)
    return C.constrained_components(near.select("src", "dst", (1 - F.col("dist")).alias("score")), 30)


@query()
def super_vertex(spark, sf_dir):
    return C.super_vertices(_knn(spark, sf_dir), 0.3, 0.05, 20)


def _proposals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Overlapping groups: the neighbourhoods of all rows, scored by their mean similarity; neighbours are searched once."""
    knn = _cut(_knn(spark, sf_dir))
    members = knn.select(F.col("src").alias("proposal_id"), F.col("dst").alias("node")).unionByName(knn.select(F.col("src").alias("proposal_id"), F.col("src").alias("node")).distinct())
    return members, knn.groupBy(F.col("src").alias("proposal_id")).agg(F.round(F.avg(1 - F.col("dist")), 9).alias("score"))


_PROP = f"{N}, o AS (SELECT src AS proposal_id, dst AS node FROM k UNION SELECT src, src FROM k), z AS (SELECT src AS proposal_id, round(avg(1 - dist), 9) AS score FROM k GROUP BY src)"


@query(f"WITH {_PROP}, t AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, min(dist) AS dist FROM k GROUP BY 1, 2) SELECT a.proposal_id, t.src, t.dst, round(t.dist, 6) AS dist FROM t JOIN o a ON a.node = t.src JOIN o b ON b.node = t.dst AND a.proposal_id = b.proposal_id")
def proposals_edges(spark, sf_dir):
    return C.proposal_edges(_proposals(spark, sf_dir)[0], _knn(spark, sf_dir)).withColumn("dist", F.round("dist", 6))


@query(f"WITH {_PROP} SELECT node, arg_min(proposal_id, struct_pack(s := -score, p := proposal_id)) AS proposal_id FROM o JOIN z USING (proposal_id) GROUP BY node")
def nms_first(spark, sf_dir):
    return C.nms_first(*_proposals(spark, sf_dir))


@query()
def nms_iou(spark, sf_dir):
    return C.nms(*_proposals(spark, sf_dir), 0.1)


@query(
    f"WITH {_PROP}, g AS (SELECT * FROM z WHERE score >= 0.3), h AS (SELECT node, arg_min(proposal_id, struct_pack(s := -score, p := proposal_id)) AS proposal_id FROM o JOIN g USING (proposal_id) GROUP BY node), y AS (SELECT node, min(node) OVER (PARTITION BY proposal_id) AS component FROM h) SELECT e.id, coalesce(y.component, e.id) AS component FROM e LEFT JOIN y ON y.node = e.id"
)
def deoverlap(spark, sf_dir):
    members, scores = _proposals(spark, sf_dir)
    return C.deoverlap(members, scores, _emb(spark, sf_dir).select("id"), 0.3)


@query(
    f"WITH {_PROP}, n AS (SELECT proposal_id, label, count(*) AS n FROM o JOIN e ON e.id = o.node GROUP BY 1, 2), b AS (SELECT proposal_id, arg_max(label, struct_pack(n := n, l := -label)) AS label, max(n) AS hit, CAST(sum(n) AS BIGINT) AS size FROM n GROUP BY 1), t AS (SELECT label, count(*) AS truth FROM e GROUP BY 1) SELECT proposal_id, label, size, round(hit / (size + truth - hit), 6) AS iou, round(hit / size, 6) AS iop, round(hit / truth, 6) AS iog FROM b JOIN t USING (label)"
)
def stat_cluster(spark, sf_dir):
    found = C.cluster_statistics(_proposals(spark, sf_dir)[0], _emb(spark, sf_dir).select("id", "label"))
    return found.select("proposal_id", "label", "size", *[F.round(c, 6).alias(c) for c in ("iou", "iop", "iog")])


@query(
    f"WITH {P}, h AS (SELECT DISTINCT least(la, lb) AS x, greatest(la, lb) AS y FROM p WHERE src = dst + 1 AND la <> lb), d AS (SELECT la AS x, lb AS y, avg(dist) AS dist FROM p WHERE la < lb GROUP BY 1, 2), "
    + _closure("SELECT x, y FROM h JOIN d USING (x, y) WHERE dist < 0.99", "SELECT DISTINCT label AS id FROM e")
    + ", z AS (SELECT component, dense_rank() OVER (ORDER BY component) - 1 + min(component) OVER () AS new_label FROM (SELECT DISTINCT component FROM c)) SELECT e.id, c.component AS label, z.new_label FROM e JOIN c ON c.id = e.label JOIN z USING (component)"
)
def merge_auto(spark, sf_dir):
    e = _emb(spark, sf_dir)
    matches = e.select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    return L.auto_merge(e, matches, 0.99).select("id", "label", "new_label")


@query()
def hac_batched(spark, sf_dir):
    return C.batched_hierarchical(_emb(spark, sf_dir), 0.8, 200)


@query()
def kmeans(spark, sf_dir):
    return C.kmeans(_emb(spark, sf_dir), 8)


@query()
def spectral(spark, sf_dir):
    return C.spectral(S.symmetric(_knn(spark, sf_dir).select("src", "dst", (1 - F.col("dist")).alias("w"))), 5)


@query()
def whispers(spark, sf_dir):
    return C.cluster(_emb(spark, sf_dir), "chinese_whispers", t=T, rounds=10)


@query()
def ivf_knn(spark, sf_dir):
    """The nearest rows of every twentieth row among all rows."""
    return S.ivf_knn(_emb(spark, sf_dir), K, cells=16, nprobe=12, queries=F.pmod("id", F.lit(20)) == 0)


@query(f"WITH {P}, {_closure(f'SELECT src AS x, dst AS y FROM p WHERE src < dst AND dist <= {T}')}, n AS (SELECT src AS id, count(*) AS n FROM p WHERE dist <= {T} GROUP BY src) SELECT c.id, component, coalesce(n, 0) AS n_links FROM c LEFT JOIN n USING (id)")
def lsh_join(spark, sf_dir):
    """The group of every row and the number of its links."""
    return S.lsh_groups(_emb(spark, sf_dir), T)


@query(f"WITH {N}, a AS (SELECT src AS centre, dst AS node FROM k WHERE rank <= 5), b AS (SELECT a.centre, k.dst AS node FROM a JOIN k ON k.src = a.node WHERE k.rank <= 2) SELECT centre, node FROM a UNION SELECT centre, node FROM b UNION SELECT src, src FROM k")
def two_hop(spark, sf_dir):
    return S.two_hop(_knn(spark, sf_dir), 5, 2)


@query(f"WITH {N}, z AS (SELECT label, count(*) AS m FROM e WHERE label IS NOT NULL GROUP BY label), n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM e JOIN z USING (label) WHERE m >= (SELECT avg(m) FROM z)) SELECT CAST(a.n AS INTEGER) AS src, CAST(b.n AS INTEGER) AS dst, round(dist, 6) AS dist FROM k JOIN n a ON a.id = k.src JOIN n b ON b.id = k.dst")
def sub_graph(spark, sf_dir):
    """The graph of the rows whose labels are at least as frequent as the average label."""
    e = _emb(spark, sf_dir)
    sizes = e.filter("label IS NOT NULL").groupBy("label").count()
    ids = e.join(sizes, "label").join(F.broadcast(sizes.agg(F.avg("count").alias("mean"))), F.expr("count >= mean")).select("id")
    return S.sub_graph(_knn(spark, sf_dir).select("src", "dst", F.round("dist", 6).alias("dist")), ids)
