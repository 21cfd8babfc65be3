"""Queries over alignment joins, filters, samples, sets, names and nested values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import similarity as S
from .registry import query, table
from .similarity import E, M, N, P, U, _emb, _knn

# -- joins that align by name ---------------------------------------------------------------------------------------


@query("SELECT e.vec_id AS id, CAST(e.label AS BIGINT) AS label, l.toxic AS mark, len(e.embedding) AS dims FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id")
def align_features(spark, sf_dir):
    """Features with the annotation of the same name; rows without a partner go."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.size("embedding").cast("long").alias("dims"))
    return e.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("mark")), "id")


@query("SELECT doc_id AS id, quality AS y_true, toxic AS y_pred, quality = toxic AS same FROM labels JOIN documents USING (doc_id)")
def align_annotations(spark, sf_dir):
    """True and predicted annotations of the same names."""
    true = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y_true"))
    pred = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("y_pred"))
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return true.join(pred, "id").join(known, "id").withColumn("same", F.col("y_true") == F.col("y_pred"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first FROM lineitem JOIN embeddings e ON e.vec_id = l_partkey")
def embedding_lookup(spark, sf_dir):
    """The vector of each row's key; rows whose key has none go."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("l_partkey"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(e, "l_partkey").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "first")


@query("WITH m AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS x FROM lineitem), z AS (SELECT s, count(*) AS n FROM m GROUP BY s) SELECT a.s AS s1, b.s AS s2, count(*) AS shared, round(count(*) / (any_value(p.n) + any_value(q.n) - count(*)), 6) AS iou FROM m a JOIN m b ON a.x = b.x AND a.s < b.s JOIN z p ON p.s = a.s JOIN z q ON q.s = b.s GROUP BY 1, 2 HAVING count(*) >= 2")
def overlapping_sets(spark, sf_dir):
    """Orders that share two parts or more, with their intersection over union, by an inverted index; a part has about thirty orders at every size."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("x")).distinct()
    n = m.groupBy("s").count()
    pairs = m.toDF("s1", "x").join(m.toDF("s2", "x"), "x").filter("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("shared")).filter("shared >= 2")
    both = pairs.join(n.toDF("s1", "n1"), "s1").join(n.toDF("s2", "n2"), "s2")
    return both.select("s1", "s2", "shared", F.round(F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared")), 6).alias("iou"))


# -- filters --------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey >= 5 AND s_nationkey < 15")
def class_range_filter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter((F.col("s_nationkey") >= 5) & (F.col("s_nationkey") < 15)).select("s_suppkey", "s_nationkey")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'st')")
def substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.contains(F.lower("p_type"), F.lit("st"))).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 5)")
def members_of_size(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(o.groupBy("o_custkey").count().filter("count = 5"), "o_custkey", "left_semi")


@query("SELECT vec_id AS id, label FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE CAST(label AS BIGINT) END AS label FROM embeddings) WHERE label <> -1")
def drop_ignored(spark, sf_dir):
    """Rows without the ignored label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.col("label").cast("long")).alias("label"))
    return e.filter("label <> -1")


@query("SELECT event_id, value FROM events WHERE value >= 20 AND value <= 95 AND event_type <> 'view'")
def detection_filter(spark, sf_dir):
    """Confidence within bounds and a wanted kind."""
    return table(spark, sf_dir, "events").filter(F.col("value").between(20, 95) & (F.col("event_type") != "view")).select("event_id", "value")


@query(f"WITH {N}, g AS (SELECT src, count_if(la = lb) AS pos, count(*) AS n FROM k GROUP BY src) SELECT src, round(pos / n, 6) AS iop FROM g WHERE pos / n >= 0.2 AND pos / n < 0.9")
def iop_range_filter(spark, sf_dir):
    """Proposals (neighbourhoods) whose share of one label lies in a range."""
    hits = S.label_agreement(_knn(spark, sf_dir), _emb(spark, sf_dir).select("id", "label")).groupBy("src").agg(F.avg(F.col("same").cast("int")).alias("iop"))
    return hits.filter((F.col("iop") >= 0.2) & (F.col("iop") < 0.9)).select("src", F.round("iop", 6).alias("iop"))


# -- top k, samples -------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer) WHERE r <= 3")
def smallest_k(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT p_partkey FROM part ORDER BY (p_partkey * 2654435761) % 1000003, p_partkey LIMIT 25")
def sample_rows(spark, sf_dir):
    """A sample without replacement: the first rows in an order that has nothing to do with the data."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.orderBy(F.pmod(F.col("p_partkey") * F.lit(2654435761), F.lit(1000003)), "p_partkey").limit(25)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY (s_suppkey * 2654435761) % 1000003, s_suppkey) AS place FROM supplier")
def shuffle_rows(spark, sf_dir):
    """A repeatable permutation: places by range counts, so no task holds more than a range."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.pmod(F.col("s_suppkey") * F.lit(2654435761), F.lit(1000003)).alias("h"))
    s = s.withColumn("b", F.floor(F.col("h") / 62501))
    counts = s.groupBy("b").count()
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("b", "before")
    place = F.row_number().over(Window.partitionBy("b").orderBy("h", "s_suppkey")) + F.col("before")
    return s.join(F.broadcast(before), "b").select("s_suppkey", place.alias("place"))


@query("SELECT side, id FROM ((SELECT 'customer' AS side, c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25) UNION ALL (SELECT 'supplier', s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 25))")
def take_per_side(spark, sf_dir):
    c = table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25).select(F.lit("customer").alias("side"), F.col("c_custkey").alias("id"))
    s = table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(25).select(F.lit("supplier").alias("side"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s)


@query("SELECT CAST(d AS VARCHAR) AS tick FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE i % 30 = 0")
def thinned_ticks(spark, sf_dir):
    """Every thirtieth day of an axis; days are a bounded axis, whatever the rows."""
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("i", F.row_number().over(Window.orderBy("d")) - 1)
    return d.filter("i % 30 = 0").select(F.col("d").cast("string").alias("tick"))


# -- sets -----------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey AS id FROM supplier EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).subtract(c)


@query("SELECT a.l_suppkey AS supplier, count(*) AS shared FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') a JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') b USING (l_suppkey, l_partkey) GROUP BY 1")
def intersection_size(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    one, two = (li.filter(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey") for f in "RA")
    return one.intersect(two).groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("shared"))


@query("SELECT DISTINCT l_orderkey AS proposal, l_partkey AS member FROM lineitem WHERE l_shipdate < '1995-01-01' UNION SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 40")
def union_of_proposals(spark, sf_dir):
    """Members of proposals from two runs, each once."""
    li = table(spark, sf_dir, "lineitem")
    pick = lambda df: df.select(F.col("l_orderkey").alias("proposal"), F.col("l_partkey").alias("member"))
    return pick(li.filter("l_shipdate < timestamp'1995-01-01'")).unionByName(pick(li.filter("l_quantity > 40"))).distinct()


@query("SELECT l_partkey AS key, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS orders FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY 1")
def inverted_index(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").distinct()
    return li.groupBy(F.col("l_partkey").alias("key")).agg(F.array_join(F.sort_array(F.collect_list("l_orderkey")).cast("array<string>"), ",").alias("orders"))


# -- sums over groups -----------------------------------------------------------------------------------------------


@query(f"WITH {M} SELECT label, i - 1 AS i, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM m)")
def normalised_centres(spark, sf_dir):
    c = S.centroids(_emb(spark, sf_dir)).select("label", F.posexplode(V.normalise(F.col("vec"))).alias("i", "x"))
    return c.select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT CAST(nullif(regexp_extract(p_brand, '[0-9]+'), '') AS BIGINT) AS prefix, count(*) AS n FROM part GROUP BY 1")
def prefix_counts(spark, sf_dir):
    """Counts by the number in a name; names without one have none."""
    number = F.regexp_extract("p_brand", "[0-9]+", 0)
    return table(spark, sf_dir, "part").groupBy(F.when(number != "", number.cast("long")).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT o_custkey) AS covered, (SELECT count(*) FROM customer) AS total, round(count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 6) AS coverage FROM orders")
def coverage(spark, sf_dir):
    covered = table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("covered"))
    total = table(spark, sf_dir, "customer").agg(F.count("*").alias("total"))
    return covered.join(F.broadcast(total)).withColumn("coverage", F.round(F.col("covered") / F.col("total"), 6))


@query("SELECT l_returnflag AS flag, round(avg(l_discount), 6) AS mean, min(l_discount) AS least, max(l_discount) AS most, round(stddev_pop(l_discount), 6) AS std, round(avg(pow(l_discount - 1, 2)), 6) AS mse_to_one, round(avg(pow(l_discount, 2)), 6) AS mse_to_zero FROM lineitem GROUP BY 1")
def summary_and_mse(spark, sf_dir):
    """Mean, bounds, deviation, and mean squared error to the constants 1 and 0."""
    d = F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.round(F.avg(d), 6).alias("mean"), F.min(d).alias("least"), F.max(d).alias("most"), F.round(F.stddev_pop(d), 6).alias("std"), F.round(F.avg(F.pow(d - 1, F.lit(2))), 6).alias("mse_to_one"), F.round(F.avg(d * d), 6).alias("mse_to_zero"))


# -- vectors --------------------------------------------------------------------------------------------------------


@query(f"WITH {U} SELECT id, abs(sqrt(list_dot_product(v, v)) - 1) < 1e-6 AS is_unit FROM u UNION ALL SELECT -id - 1, abs(sqrt(list_dot_product(v, v)) - 1) < 1e-6 FROM e")
def norm_check(spark, sf_dir):
    """Whether vectors have length 1: normalised ones, and (under negated names) as they are."""
    unit = lambda c: (F.abs(F.sqrt(V.inner_product(c, c)) - 1) < 1e-6).alias("is_unit")
    e = _emb(spark, sf_dir)
    return e.select("id", unit(V.normalise(F.col("vec")))).unionByName(e.select((-F.col("id") - 1).alias("id"), unit(V.doubles(F.col("vec")))))


@query("SELECT vec_id AS id, len(embedding) * 2 AS dims, round(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE), 6) AS diff FROM embeddings")
def concat_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    twice = F.concat("embedding", F.reverse("embedding"))
    return e.select(F.col("vec_id").alias("id"), F.size(twice).cast("long").alias("dims"), F.round(twice[0].cast("double") - F.element_at(twice, -2).cast("double"), 6).alias("diff"))


@query("SELECT lo, lo + 5 AS hi, lo + 2.5 AS middle, count(*) AS n FROM (SELECT floor(l_quantity / 5) * 5 AS lo FROM lineitem) GROUP BY 1")
def bin_middles(spark, sf_dir):
    lo = (F.floor(F.col("l_quantity") / 5) * 5).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(lo.alias("lo")).agg(F.count("*").alias("n")).select("lo", (F.col("lo") + 5).alias("hi"), (F.col("lo") + 2.5).alias("middle"), "n")


@query("SELECT event_id, greatest(0.0, least(100.0, value * 2 - 50)) AS clamped, value - (SELECT avg(value) FROM events) > 0 AS above FROM events")
def clamp_and_centre(spark, sf_dir):
    """A value held to bounds, and on which side of the mean it lies."""
    e = table(spark, sf_dir, "events")
    mean = e.agg(F.avg("value").alias("mean"))
    return e.join(F.broadcast(mean)).select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("value") * 2 - 50)).alias("clamped"), (F.col("value") - F.col("mean") > 0).alias("above"))


# -- names and times ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'data/crops/' || trim(p_name) || '.jpg' AS path, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, replace('data/crops/' || trim(p_name) || '.jpg', '.jpg', '.npy') AS swapped FROM part")
def path_names(spark, sf_dir):
    """Trimmed names with a prefix, numbers padded to four places, and another suffix."""
    path = F.concat(F.lit("data/crops/"), F.trim("p_name"), F.lit(".jpg"))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.regexp_replace(path, r"\.jpg$", ".npy").alias("swapped"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events")
def time_formats(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH:mm:ss").alias("time"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("minute"))


@query("SELECT x || ',' || y AS pair, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, n FROM (SELECT least(l_partkey, l_suppkey) AS x, greatest(l_partkey, l_suppkey) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def pair_keys(spark, sf_dir):
    """Unordered pairs as one key 'x,y', counted by it and split again."""
    key = F.concat_ws(",", F.least("l_partkey", "l_suppkey").cast("string"), F.greatest("l_partkey", "l_suppkey").cast("string"))
    counts = table(spark, sf_dir, "lineitem").groupBy(key.alias("pair")).agg(F.count("*").alias("n"))
    return counts.select("pair", F.split("pair", ",")[0].cast("long").alias("x"), F.split("pair", ",")[1].cast("long").alias("y"), "n")


# -- nested values --------------------------------------------------------------------------------------------------


def _annotations(spark, sf_dir) -> DataFrame:
    """Nested documents: one a nation, from names to {label, score}."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_name", F.struct(F.col("c_custkey").alias("label"), F.col("c_acctbal").alias("score")).alias("v"))
    return c.groupBy(F.col("c_nationkey").alias("doc")).agg(F.map_from_entries(F.collect_list(F.struct("c_name", "v"))).alias("labels"))


@query("SELECT c_nationkey AS doc, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_custkey END AS label, c_acctbal AS score FROM customer")
def nested_update(spark, sf_dir):
    """A label inside nested documents is rewritten in place, all else stays; rows again for the comparison."""
    changed = F.transform_values("labels", lambda k, v: v.withField("label", F.when(v["label"] % 4 == 0, F.lit(-1).cast("long")).otherwise(v["label"])))
    return _annotations(spark, sf_dir).select("doc", F.explode(changed).alias("name", "v")).select("doc", "name", "v.label", "v.score")


@query("SELECT c_custkey AS label, c_name AS name, c_nationkey AS doc FROM customer")
def nested_invert(spark, sf_dir):
    """From documents of names to labels: labels to the names and documents that hold them."""
    flat = _annotations(spark, sf_dir).select("doc", F.explode("labels").alias("name", "v"))
    inverted = flat.groupBy("v.label").agg(F.collect_list(F.struct("name", "doc")).alias("at"))
    return inverted.select("label", F.explode("at").alias("a")).select("label", "a.name", "a.doc")


@query("SELECT key, arg_max(v, r) AS value FROM (SELECT o_custkey AS key, o_totalprice AS v, struct_pack(d := o_orderdate, k := o_orderkey) AS r FROM orders) GROUP BY key")
def maps_merged(spark, sf_dir):
    """Maps merged in order of time; of a key that occurs again the last value stays."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("value"))


@query("SELECT c_nationkey AS doc, count(*) + 1 AS n, count_if(c_acctbal >= 0) AS kept FROM customer GROUP BY 1")
def nested_append_drop(spark, sf_dir):
    """A value appended to each document's list, and keys dropped by a condition on their value."""
    a = _annotations(spark, sf_dir)
    names = F.array_append(F.map_keys("labels"), "added")
    return a.select("doc", F.size(names).cast("long").alias("n"), F.size(F.map_filter("labels", lambda k, v: v["score"] >= 0)).cast("long").alias("kept"))


# -- evaluation -----------------------------------------------------------------------------------------------------


@query(f"WITH {P}, s AS (SELECT src AS id, la, lb, sum(dist) AS t, count(*) AS n FROM p GROUP BY 1, 2, 3), a AS (SELECT id, max(CASE WHEN la = lb THEN t / n END) AS a, min(CASE WHEN la <> lb THEN t / n END) AS b FROM s GROUP BY id), f AS (SELECT CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM a) SELECT CAST(floor(round(s, 9) * 10) AS BIGINT) AS bin, count(*) AS n FROM f GROUP BY 1")
def silhouette_histogram(spark, sf_dir):
    from ..operators import metrics

    s = metrics.silhouette_samples(_emb(spark, sf_dir))
    return s.groupBy(F.floor(F.round("silhouette", 9) * 10).alias("bin")).agg(F.count("*").alias("n"))


@query("WITH y AS (SELECT CAST(label AS BIGINT) AS y_true, vec_id % 211 AS y_pred FROM embeddings), k AS (SELECT *, count(*) OVER (PARTITION BY y_pred) AS m FROM y) SELECT count(*) AS n, count(DISTINCT y_pred) AS clusters, (SELECT count(*) FROM k WHERE m <= 5) AS dropped FROM k WHERE m > 5")
def without_small_clusters(spark, sf_dir):
    """What an evaluation without singletons and small clusters is left with."""
    y = _emb(spark, sf_dir).select("label", F.pmod("id", F.lit(211)).alias("y_pred"))
    sized = y.join(y.groupBy("y_pred").agg(F.count("*").alias("m")), "y_pred")
    kept = F.col("m") > 5
    return sized.agg(F.count_if(kept).alias("n"), F.count_distinct(F.when(kept, F.col("y_pred"))).alias("clusters"), F.count_if(~kept).alias("dropped"))


@query(f"WITH {N} SELECT count(*) AS pairs, round(avg(CASE WHEN (dist < 0.7) = (la = lb) THEN 1.0 ELSE 0 END), 6) AS accuracy, round(count_if(dist < 0.7 AND la = lb) / greatest(1, count_if(dist < 0.7)), 6) AS precision, round(count_if(dist < 0.7 AND la = lb) / greatest(1, count_if(la = lb)), 6) AS recall FROM k")
def link_accuracy(spark, sf_dir):
    """Accuracy, precision and recall of predicted links among neighbours."""
    j = S.label_agreement(_knn(spark, sf_dir), _emb(spark, sf_dir).select("id", "label"))
    near, same = F.col("dist") < 0.7, F.col("same")
    return j.agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(near == same, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.count_if(near & same) / F.greatest(F.lit(1), F.count_if(near)), 6).alias("precision"), F.round(F.count_if(near & same) / F.greatest(F.lit(1), F.count_if(same)), 6).alias("recall"))
