"""Queries over tables: metrics, labels, histograms, calendars, keys, splits, streams."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import adapters, keys
from ..functions import vectors as V
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import tables as T
from ..streaming import suppress
from .registry import query, table
from .similarity import E as EMB
from .similarity import P as PAIRS
from .similarity import M as MEANS
from .similarity import _emb

# -- metrics -----------------------------------------------------------------------------------------------------


def _annotated(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("y_true"), F.pmod("vec_id", F.lit(7)).cast("int").alias("y_pred"))


A = "y AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS y_true, CAST(vec_id % 7 AS INTEGER) AS y_pred FROM embeddings), c AS (SELECT y_true, y_pred, count(*) AS n FROM y GROUP BY 1, 2), g AS (SELECT *, sum(n) OVER (PARTITION BY y_true) AS a, sum(n) OVER (PARTITION BY y_pred) AS b, sum(n) OVER () AS t FROM c)"
_F = "2 * precision * recall / (precision + recall)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(f"WITH {A} SELECT y_true, y_pred, n FROM c")
def contingency(spark, sf_dir):
    return M.contingency(_annotated(spark, sf_dir))


@query(f"WITH {A}, p AS (SELECT (SELECT sum(n * n) - sum(n) FROM c) / (SELECT sum(m * m) - sum(m) FROM (SELECT sum(n) AS m FROM c GROUP BY y_pred)) AS precision, (SELECT sum(n * n) - sum(n) FROM c) / (SELECT sum(m * m) - sum(m) FROM (SELECT sum(n) AS m FROM c GROUP BY y_true)) AS recall) SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F}, 6) AS fscore FROM p")
def metrics_pairwise(spark, sf_dir):
    return _rounded(M.pairwise(_annotated(spark, sf_dir)))


@query(f"WITH {A}, p AS (SELECT sum(n * n / b) / sum(n) AS precision, sum(n * n / a) / sum(n) AS recall FROM g) SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F}, 6) AS fscore FROM p")
def metrics_bcubed(spark, sf_dir):
    return _rounded(M.bcubed(_annotated(spark, sf_dir)))


@query(f"WITH {A} SELECT round(2 * sum(n / t * ln(n * t / (a * b))) / (sum(-n / t * ln(a / t)) + sum(-n / t * ln(b / t))), 6) AS nmi FROM g")
def metrics_nmi(spark, sf_dir):
    return _rounded(M.nmi(_annotated(spark, sf_dir)))


@query(f"WITH {A}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY y_true)) AS a, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM c GROUP BY y_pred)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t) SELECT round((s - a * b / t) / ((a + b) / 2 - a * b / t), 6) AS ari FROM s")
def metrics_ari(spark, sf_dir):
    return _rounded(M.adjusted_rand(_annotated(spark, sf_dir)))


@query(f"WITH {A} SELECT round(sum(m) / sum(n), 6) AS purity FROM (SELECT y_pred, max(n) AS m, sum(n) AS n FROM c GROUP BY 1)")
def metrics_purity(spark, sf_dir):
    return _rounded(M.purity(_annotated(spark, sf_dir)))


_BY = f"""{A}, l AS (SELECT DISTINCT y_true AS label FROM y UNION SELECT y_pred FROM y), z AS (SELECT label, (SELECT count(*) FROM y WHERE y_true = label) AS support, (SELECT count(*) FROM y WHERE y_pred = label) AS predicted, (SELECT count(*) FROM y WHERE y_true = label AND y_pred = label) AS hit FROM l),
q AS (SELECT label, support, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM z), h AS (SELECT *, CASE WHEN precision + recall > 0 THEN {_F} ELSE 0 END AS f1 FROM q)"""


@query(f"WITH {_BY} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM h")
def metrics_by_label(spark, sf_dir):
    return _rounded(M.by_label(_annotated(spark, sf_dir)))


@query(f"WITH {_BY} SELECT round(sum(precision * support) / sum(support), 6) AS precision, round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM h")
def metrics_weighted_pr(spark, sf_dir):
    return _rounded(M.weighted(_annotated(spark, sf_dir)))


@query(f"WITH {_BY} SELECT round(100 * avg(precision), 6) AS precision, round(100 * avg(recall), 6) AS recall, round(100 * avg(f1), 6) AS f1 FROM h")
def metrics_macro(spark, sf_dir):
    return _rounded(M.macro(_annotated(spark, sf_dir)))


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels")
def metrics_accuracy(spark, sf_dir):
    return _rounded(M.accuracy(table(spark, sf_dir, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))))


@query(f"WITH {PAIRS}, i AS (SELECT src, avg(dist) AS intra FROM p WHERE la = lb GROUP BY src), o AS (SELECT src, min(d) AS nearest FROM (SELECT src, lb, avg(dist) AS d FROM p WHERE la <> lb GROUP BY src, lb) GROUP BY src) SELECT e.id, e.label, round(i.intra, 6) AS intra, round(o.nearest, 6) AS nearest FROM e LEFT JOIN i ON i.src = e.id LEFT JOIN o ON o.src = e.id")
def silhouette_distances(spark, sf_dir):
    return _rounded(M.silhouette_distances(_emb(spark, sf_dir)).drop("n"))


@query(f"WITH {PAIRS}, i AS (SELECT src, avg(dist) AS intra FROM p WHERE la = lb GROUP BY src), o AS (SELECT src, min(d) AS nearest FROM (SELECT src, lb, avg(dist) AS d FROM p WHERE la <> lb GROUP BY src, lb) GROUP BY src) SELECT e.id, e.label, round(coalesce((nearest - intra) / greatest(nearest, intra), 0), 5) AS silhouette FROM e LEFT JOIN i ON i.src = e.id LEFT JOIN o ON o.src = e.id")
def silhouette_samples(spark, sf_dir):
    return M.silhouette_samples(_emb(spark, sf_dir)).withColumn("silhouette", F.round("silhouette", 5))


_EU = "sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.v[i] - b.v[i], 2))))"


@query(f"WITH {MEANS}, s AS (SELECT a.label, avg({_EU}) AS s FROM e a JOIN m b ON a.label = b.label GROUP BY a.label), r AS (SELECT a.label, max((s.s + t.s) / {_EU}) AS r FROM m a JOIN m b ON a.label <> b.label JOIN s ON s.label = a.label JOIN s t ON t.label = b.label GROUP BY a.label) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark, sf_dir):
    return _rounded(M.davies_bouldin(_emb(spark, sf_dir)))


@query(f"WITH {MEANS}, a AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(v[i]) AS x FROM (SELECT v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY i)), w AS (SELECT sum(pow({_EU}, 2)) AS w FROM e a JOIN m b ON a.label = b.label), o AS (SELECT sum(b.n * pow({_EU}, 2)) AS b, count(*) AS k, sum(b.n) AS n FROM m b, a) SELECT round(b / (k - 1) / (w / (n - k)), 6) AS calinski_harabasz FROM w, o")
def calinski_harabasz(spark, sf_dir):
    return _rounded(M.calinski_harabasz(_emb(spark, sf_dir)))


def _verification(spark, sf_dir) -> DataFrame:
    """Even and odd rows side by side; labels of a modulus make enough equal pairs."""
    e = _emb(spark, sf_dir)
    a = e.filter("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("pair_id"), F.col("vec").alias("x"), F.col("label").alias("la"))
    b = e.filter("id % 2 = 1").select(F.floor(F.col("id") / 2).alias("pair_id"), F.col("vec").alias("y"), F.col("label").alias("lb"))
    return a.join(b, "pair_id").select("pair_id", F.round(V.cosine_distance(F.col("x"), F.col("y")) / 2, 9).alias("dist"), (F.col("la") % 2 == F.col("lb") % 2).alias("is_same"))


_V = f"{EMB}, v AS (SELECT a.id // 2 AS pair_id, round((1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) / 2, 9) AS dist, a.label % 2 = b.label % 2 AS is_same FROM e a JOIN e b ON b.id = a.id + 1 WHERE a.id % 2 = 0), f AS (SELECT *, ntile(10) OVER (ORDER BY pair_id) - 1 AS fold FROM v), t AS (SELECT i AS bin, i * CAST(0.01 AS DOUBLE) AS threshold FROM range(0, 100) r(i)), q AS (SELECT fold, bin, threshold, count_if(is_same AND dist < threshold) AS tp, count_if(NOT is_same AND dist < threshold) AS fp, count_if(is_same) AS pos, count_if(NOT is_same) AS neg FROM f, t GROUP BY 1, 2, 3)"


@query(f"WITH {_V} SELECT round(threshold, 6) AS threshold, round(avg(CASE WHEN pos > 0 THEN tp / pos ELSE 0 END), 6) AS tpr, round(avg(CASE WHEN neg > 0 THEN fp / neg ELSE 0 END), 6) AS fpr FROM q GROUP BY threshold")
def roc_sweep(spark, sf_dir):
    return _rounded(M.roc_sweep(_verification(spark, sf_dir)))


@query(f"WITH {_V}, r AS (SELECT *, tp + neg - fp AS right_, pos + neg AS n FROM q), s AS (SELECT fold, bin, threshold, right_ / n AS accuracy, (sum(right_) OVER (PARTITION BY bin) - right_) / (sum(n) OVER (PARTITION BY bin) - n) AS train FROM r) SELECT CAST(fold AS INTEGER) AS fold, round(threshold, 6) AS threshold, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train DESC, bin) AS k FROM s) WHERE k = 1")
def kfold_accuracy(spark, sf_dir):
    return _rounded(M.kfold_accuracy(_verification(spark, sf_dir)))


@query()
def tar_at_far(spark, sf_dir):
    return _rounded(M.tar_at_far(_verification(spark, sf_dir), 0.05))


# -- labels ------------------------------------------------------------------------------------------------------


def _sized(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 3 - 4).cast("long").alias("label"))


_S = "s AS (SELECT p_partkey AS id, CAST(p_size * 3 - 4 AS BIGINT) AS label FROM part)"


@query(f"WITH {_S}, n AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label DESC) - 1 AS new_label FROM s WHERE label >= 0 GROUP BY label) SELECT id, label, coalesce(new_label, label) AS new_label FROM s LEFT JOIN n USING (label)")
def relabel_freq(spark, sf_dir):
    return L.by_frequency(_sized(spark, sf_dir)).select("id", "label", "new_label")


@query(f"WITH {_S} SELECT id, label, dense_rank() OVER (ORDER BY label) - 1 + min(label) OVER () AS new_label FROM s")
def relabel_dense(spark, sf_dir):
    return L.dense(_sized(spark, sf_dir)).select("id", "label", "new_label")


@query(f"WITH {_S}, z AS (SELECT id, CASE WHEN label % 5 <> 0 THEN label END AS label FROM s), n AS (SELECT label, row_number() OVER (ORDER BY min(id)) - 1 AS new_label FROM z WHERE label IS NOT NULL GROUP BY label) SELECT id, z.label, coalesce(new_label, (SELECT count(*) FROM n) + row_number() OVER (PARTITION BY z.label IS NULL ORDER BY id) - 1) AS new_label FROM z LEFT JOIN n ON z.label = n.label")
def relabel_first_seen(spark, sf_dir):
    return L.by_first_seen(_sized(spark, sf_dir).withColumn("label", F.when(F.col("label") % 5 != 0, F.col("label")))).select("id", "label", "new_label")


@query("WITH s AS (SELECT p_partkey AS id, p_brand AS part, CAST(p_size AS BIGINT) AS label FROM part), o AS (SELECT part, coalesce(sum(max(label) + 1) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM s GROUP BY part) SELECT id, part, label, CAST(label + shift AS BIGINT) AS new_label FROM s JOIN o USING (part)")
def label_offset_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("part"), F.col("p_size").cast("long").alias("label"))
    return L.offset_concat(rows).select("id", "part", "label", "new_label")


@query(f"WITH {_S} SELECT id, label, CASE WHEN label >= 0 AND count(*) OVER (PARTITION BY label) < 40 THEN -label ELSE label END AS new_label FROM s")
def infrequent_negate(spark, sf_dir):
    return L.negate_infrequent(_sized(spark, sf_dir), 40).select("id", "label", "new_label")


@query(f"WITH {_S} SELECT id, CASE WHEN label IN (2, 5, 8) THEN 2 WHEN label IN (11, 14) THEN -1 ELSE label END AS label FROM s")
def merge_manual(spark, sf_dir):
    decisions = spark.createDataFrame([(5, 2), (8, 5), (11, -1), (14, -1)], "old_label long, new_label long")
    return L.update_annotations(_sized(spark, sf_dir), decisions).select("id", "label")


@query("SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def majority_segment(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return counts.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("n")).alias("s"), "c_mktsegment")).alias("b")).select("c_nationkey", "b.c_mktsegment", (-F.col("b.s")).alias("n"))


# -- histograms and calendars --------------------------------------------------------------------------------------


@query("WITH c AS (SELECT p_size AS bin, count(*) AS n FROM part GROUP BY 1) SELECT r.i AS bin, coalesce(n, 0) AS n FROM range(0, (SELECT max(bin) + 1 FROM c)) r(i) LEFT JOIN c ON c.bin = r.i")
def bincount(spark, sf_dir):
    return T.bincount(table(spark, sf_dir, "part"), "p_size")


@query("WITH c AS (SELECT k AS bin, count(*) AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_suppkey, l_returnflag) GROUP BY 1) SELECT r.i AS bin, coalesce(n, 0) AS n FROM range(0, (SELECT least(max(bin) + 1, 300) FROM c)) r(i) LEFT JOIN c ON c.bin = r.i")
def count_of_counts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("c", F.struct("l_suppkey", "l_returnflag"))
    return T.count_of_counts(l, "c", 300)


_EDGES = "[" + ", ".join(map(str, T.MEMBERSHIP)) + "]"


@query(f"WITH s AS (SELECT count(*) AS size FROM lineitem GROUP BY l_partkey), b AS (SELECT unnest({_EDGES}) AS lo), c AS (SELECT list_max(list_filter({_EDGES}, lambda e: e <= size)) AS lo, count(*) AS n FROM s GROUP BY 1) SELECT b.lo, coalesce(c.n, 0) AS n FROM b LEFT JOIN c USING (lo) WHERE b.lo <= (SELECT max(size) FROM s) UNION ALL SELECT CAST(max(size) AS INTEGER), 0 FROM s HAVING max(size) IS NOT NULL")
def hist_membership(spark, sf_dir):
    return T.membership_histogram(table(spark, sf_dir, "lineitem"), "l_partkey")


_LV = "[" + ", ".join(map(str, T.LABEL_VALUES)) + "]"


@query(f"WITH e AS (SELECT {_LV} AS e), b AS (SELECT i, e[i] AS lo, e[i + 1] AS hi FROM (SELECT e, unnest(range(1, len(e))) AS i FROM e)) SELECT lo || ' - ' || (hi - 1) AS name, count(p_partkey) AS n FROM b LEFT JOIN part ON p_partkey >= lo AND (p_partkey < hi OR hi = 10000 AND p_partkey = hi) GROUP BY lo, hi")
def hist_label_value(spark, sf_dir):
    return T.label_value_histogram(table(spark, sf_dir, "part"), "p_partkey")


_ANGLE = "CAST(floor(l_extendedprice) AS BIGINT) % 240 - 120 + l_discount"


@query(f"WITH v AS (SELECT {_ANGLE} AS v FROM lineitem), c AS (SELECT least(floor(v), 89) AS angle, count(*) AS n FROM v WHERE v BETWEEN -90 AND 90 GROUP BY 1) SELECT CAST(r.i AS INTEGER) AS angle, coalesce(c.n, 0) AS n FROM range(-90, 90) r(i) LEFT JOIN c ON c.angle = r.i")
def hist_angle(spark, sf_dir):
    v = F.floor("l_extendedprice") % 240 - 120 + F.col("l_discount")
    return T.angle_histogram(table(spark, sf_dir, "lineitem"), v)


@query("WITH v AS (SELECT value AS v FROM events WHERE value BETWEEN 0 AND 100), c AS (SELECT least(floor((v - 0) / 2.5), 39) AS bin, count(*) AS n FROM v GROUP BY 1) SELECT CAST(r.i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(n) OVER (), 6) AS share, round(coalesce(n, 0) / (sum(n) OVER () * 2.5), 6) AS density FROM range(0, 40) r(i) LEFT JOIN c ON c.bin = r.i")
def hist_density(spark, sf_dir):
    return _rounded(T.even_histogram(table(spark, sf_dir, "events"), F.col("value"), 0, 100, 40))


@query("SELECT event_type, time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def bucket_10min(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return T.tumbling_counts(e, "ts", "10 minutes", "event_type").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(" UNION ALL ".join(f"SELECT '{u}' AS unit, CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS bucket, count(*) AS n FROM events GROUP BY 2" for u in ("hour", "day", "month", "year")))
def bucket_calendar(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = e.select(F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.date_trunc(u, "ts").alias("bucket")) for u in ("hour", "day", "month", "year")])).alias("b"))
    return parts.groupBy("b.unit", F.col("b.bucket").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT d.day, t.event_type, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT day FROM c) d CROSS JOIN (SELECT DISTINCT event_type FROM c) t LEFT JOIN c ON c.day = d.day AND c.event_type = t.event_type")
def calendar_align(spark, sf_dir):
    return T.calendar_align(table(spark, sf_dir, "events"), "ts", "event_type")


@query("WITH e AS (SELECT event_type, CAST(user_id % 20 - 2 AS BIGINT) AS label FROM events) SELECT g AS event_type, count(*) AS n_rows, count_if(label >= 0) AS n_labelled, count(DISTINCT (event_type, label)) AS n_clusters, count(DISTINCT CASE WHEN label >= 0 THEN (event_type, label) END) AS n_classes FROM (SELECT event_type, label, event_type AS g FROM e UNION ALL SELECT event_type, label, 'total' FROM e) GROUP BY g")
def overview_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.pmod("user_id", F.lit(20)) - 2).alias("label"))
    return T.overview(e, "event_type", "label")


@query("WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS running, round(sum(n) OVER (PARTITION BY event_type) / sum(n) OVER (), 6) AS share FROM d")
def cumulative_share(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return _rounded(T.running_share(d, "event_type", "day", "n"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, CAST(dense_rank() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS INTEGER) AS place FROM events GROUP BY 1, 2")
def shared_axis_rank(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day")).distinct()
    axis = d.select("day").distinct().withColumn("place", F.dense_rank().over(Window.orderBy("day")) - 1)
    return d.join(F.broadcast(axis), "day")


@query("SELECT event_id, user_id, CASE WHEN abs(value - lag(value, 1) OVER w) < 5 THEN 1 WHEN abs(value - lag(value, 2) OVER w) < 5 THEN 2 ELSE 0 END AS match FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_match_prev2(spark, sf_dir):
    return T.last_two_match(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5).select("event_id", "user_id", "match")


@query()
def stateful_dedup_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return suppress.suppress_batch(e, "user_id", ["ts", "event_id"], "value", 10).drop("ts")


# -- keys, maps, boxes ---------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, event_type AS channel, ts, CAST(event_id % 7 AS INTEGER) AS face FROM events")
def key_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = keys.face_key(keys.frame_key(F.col("event_type"), F.col("ts").cast("timestamp")), F.pmod("event_id", F.lit(7)))
    return e.select("event_id", keys.parse_key(name).alias("p")).select("event_id", "p.channel", F.col("p.ts").cast("timestamp_ntz").alias("ts"), "p.face")


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS INTEGER) AS x, CAST(l_suppkey AS INTEGER) AS y FROM lineitem")
def tuple_parse(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("t", keys.tuple_of_ints(F.format_string("(%d, %d)", "l_partkey", "l_suppkey")))
    return l.select("l_orderkey", "l_linenumber", F.col("t")[0].alias("x"), F.col("t")[1].alias("y"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS ax, l_suppkey % 50 AS ay, CAST(l_quantity AS BIGINT) AS aw, l_linenumber * 5 AS ah, l_suppkey % 40 AS bx, l_partkey % 40 AS by_, l_linenumber * 6 AS bw, CAST(l_quantity AS BIGINT) AS bh FROM lineitem),
i AS (SELECT *, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx) + 1) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_) + 1) AS both_ FROM b)
SELECT l_orderkey, l_linenumber, round(both_ / ((aw + 1) * (ah + 1) + (bw + 1) * (bh + 1) - both_), 6) AS iou FROM i""")
def box_iou(spark, sf_dir):
    c = F.col
    a = (c("l_partkey") % 50, c("l_suppkey") % 50, c("l_quantity").cast("long"), c("l_linenumber") * 5)
    b = (c("l_suppkey") % 40, c("l_partkey") % 40, c("l_linenumber") * 6, c("l_quantity").cast("long"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(V.box_iou(a, b), 6).alias("iou"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax >= l_discount AND l_tax >= l_quantity / 100 THEN 'tax' WHEN l_discount >= l_quantity / 100 THEN 'discount' ELSE 'quantity' END AS top FROM lineitem")
def top_category(spark, sf_dir):
    m = F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount"), F.lit("quantity"), F.col("l_quantity") / 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.top_category(m).alias("top"))


@query("WITH x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: exp(x)) AS x FROM embeddings) SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * (i - 1))) / list_sum(x) * 3 - 99, 6) AS angle FROM x")
def softmax_expectation(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.expected_angle(F.col("embedding"), 3, 99), 6).alias("angle"))


# -- splits and sets -----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 2654435761) % 1000003, c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.2) AS test FROM customer")
def stratified_split(spark, sf_dir):
    return T.stratified_split(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 0.2).select("c_custkey", "c_mktsegment", "test")


@query("WITH n AS (SELECT c_nationkey, row_number() OVER (ORDER BY (CAST(c_nationkey AS BIGINT) * 2654435761) % 1000003, c_nationkey) <= ceil(0.5 * count(*) OVER ()) AS train FROM (SELECT DISTINCT c_nationkey FROM customer)) SELECT c_custkey, c_nationkey, train FROM customer JOIN n USING (c_nationkey)")
def class_disjoint_split(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.col("c_nationkey").cast("long"))
    return T.class_disjoint_split(c, "c_nationkey", 0.5).select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey"), "train")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer")
def semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_f", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_f", F.lit(False)))


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(t, 1) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def left_join_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna({"n_orders": 0, "total": 1.0})


@query("SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def union_concat(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")).unionByName(s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


@query("SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return T.first_rows(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT l_partkey, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 20 AND 35 AND avg(l_discount) > 0.045")
def having_filters(spark, sf_dir):
    """Discounts are added in the order of the table's rows: sums of doubles depend on it, and many parts lie at the threshold itself."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.struct("_metadata.file_path", "_metadata.row_index", "l_discount").alias("row"))
    sizes = rows.groupBy("l_partkey").agg(F.count("*").alias("n")).filter(F.col("n").between(20, 35))
    # At most 35 rows a part are gathered; nulls are neither added nor counted.
    few = rows.toDF("part", "row").join(sizes, F.col("part").eqNullSafe(F.col("l_partkey")))
    lines = few.groupBy("l_partkey", "n").agg(F.array_sort(F.collect_list(F.when(F.col("row.l_discount").isNotNull(), F.col("row")))).alias("l"))
    mean = F.when(F.size("l") > 0, F.aggregate("l", F.lit(0.0), lambda total, row: total + row["l_discount"]) / F.size("l"))
    return lines.withColumn("m", mean).filter(F.col("m") > 0.045).select("l_partkey", "n", F.round("m", 6).alias("mean"))


@query("SELECT event_id, event_type, value FROM events WHERE value <= 95 AND value >= 50")
def quality_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").filter((F.col("value") <= 95) & (F.col("value") >= 50)).select("event_id", "event_type", "value")


# -- streams and models --------------------------------------------------------------------------------------------


def _events_stream(spark, sf_dir) -> tuple[DataFrame, str]:
    """The events as a stream, and a folder for its state."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="prismata-")).rstrip("/")
    schema = table(spark, sf_dir, "events").schema
    # The pattern matches the table as one file and as a folder of parts.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")), f"{root}/prismata/stream-{uuid.uuid4().hex}"


@query()
def stream_tumbling(spark, sf_dir):
    e, at = _events_stream(spark, sf_dir)
    return suppress.run_once(suppress.tumbling(e, "ts", "10 minutes", "1 hour", "event_type"), "tumbling", at)


@query()
def stream_session(spark, sf_dir):
    e, at = _events_stream(spark, sf_dir)
    return suppress.run_once(suppress.sessions(e, "ts", "30 minutes", "1 hour", "user_id"), "session", at)


@query("SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stream_dedup(spark, sf_dir):
    e, at = _events_stream(spark, sf_dir)
    return suppress.run_once(suppress.dedup_stream(e.select("user_id", "event_type", "ts"), "ts", "60 days", ["user_id", "event_type"]), "dedup", at).select("user_id", "event_type")


@query()
def stream_stateful_dedup(spark, sf_dir):
    e, at = _events_stream(spark, sf_dir)
    return suppress.run_once(suppress.suppress_stream(e.select("event_id", "user_id", "value"), "user_id", "event_id", "value", 10), "suppress", at)


@query()
def online_index(spark, sf_dir):
    return suppress.online_labels(_emb(spark, sf_dir).withColumn("shard", F.pmod("id", F.lit(4))), "shard", 0.7)


@query()
def udf_adapter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", adapters.represent(F.col("text"), "hashing").alias("vec"))


@query("SELECT doc_id AS id, i AS place, w AS word FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS w, unnest(range(0, len(regexp_extract_all(text, '[0-9]{4,}')))) AS i FROM documents)")
def udtf_explode(spark, sf_dir):
    digits = re.compile("[0-9]{4,}")
    return adapters.detect(table(spark, sf_dir, "documents"), "doc_id", "text", lambda: lambda text: [{"word": w} for w in digits.findall(text)], "word string")
