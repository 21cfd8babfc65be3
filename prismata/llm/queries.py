"""The queries of this package: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; models count folds 1 to 3 of the labelled rows, the curve is fitted on fold 4, fold 0 is held out."""
    from . import toxicity

    fold = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    scores = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold.between(1, 3), fold == 4)
    return scores.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines: how many went, and the digest of the text that is left."""
    from . import lines

    out = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes an archive of all pages and reads it back."""
    from . import warc

    files = warc.write_warc(_table(spark, sf_dir, "pages"), common.scratch(spark, "warc"))
    records = warc.read_warc(spark, files, with_payload=False)
    number = lambda c: F.regexp_extract(c, r"(-?\d+)$", 1).cast("long")
    return records.select(number("name").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), number("refers_to").alias("refers_to"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated strings of 200 bytes."""
    from . import suffixes

    return suffixes.repeated_spans(_table(spark, sf_dir, "documents")).drop("spans")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents as files of a tree: the source and language are directories, as are runs of 64 ids."""
    from . import licenses

    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit(""), "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), F.col("doc_id").cast("string"))
    out = licenses.scan_licenses(docs.select(path.alias("path"), "text"))
    return out.withColumn("doc_id", F.substring_index("path", "/", -1).cast("long")).drop("path")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents for windows of all benchmark items."""
    from . import decontaminate

    return decontaminate.scan_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 5-word Jaccard similarity of 0.8."""
    from . import jaccard

    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents, decodes them again, and returns digests of the ids."""
    from . import pieces

    return pieces.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path(PIECES), ids_too=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts all documents' tokens through a cache that starts empty."""
    from . import token_counts

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), common.scratch(spark, "token-cache"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 of all embeddings for every hundredth vec_id."""
    from . import topk

    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_lines, op3_warc, op4_suffixes, op5_licenses, op6_decontaminate, op7_jaccard, op8_pieces, op9_token_counts, op10_topk, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_licenses": op5_sql(), "op6_decontaminate": OP6_SQL, "op7_jaccard": OP7_SQL, "op10_topk": OP10_SQL}


def op5_sql() -> str:
    """The scan in SQL; the templates' weights are constants."""
    from . import licenses

    idf, rows, other = licenses.weights()
    w = ", ".join(f"('{t}', '{x}', {d!r})" for t, x, d in rows)
    i = ", ".join(f"('{x}', {d!r})" for x, d in idf.items())
    stop = ", ".join(f"'{x}'" for x in licenses.STOP)
    return rf"""
WITH w(template, word, dot) AS (VALUES {w}), i(word, idf) AS (VALUES {i}),
f AS (SELECT doc_id, '/' || source || '/' || lang || '/' || CAST(doc_id // 64 AS VARCHAR) AS dir, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
u AS (SELECT doc_id, u, t FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS t, unnest(range(0, len(string_split(low, chr(10))))) AS u FROM f) UNION ALL SELECT doc_id, -1, low FROM f),
x AS (SELECT doc_id, u, word, count(*) AS tf FROM (SELECT doc_id, u, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS word FROM u) WHERE word NOT IN ({stop}) GROUP BY ALL),
s AS (SELECT doc_id, u, sqrt(sum(pow(tf * coalesce(idf, {other!r}), 2))) AS size FROM x LEFT JOIN i USING (word) GROUP BY ALL),
d AS (SELECT doc_id, u, template, round(sum(tf * dot) / any_value(size), 6) AS score FROM x JOIN w USING (word) JOIN s USING (doc_id, u) GROUP BY doc_id, u, template),
o AS (SELECT doc_id, count(DISTINCT CASE WHEN u >= 0 THEN u END) AS n_units, arg_min(template, struct_pack(s := -score, t := template)) AS own_license, max(score) AS own_score, bool_or(u = -1) AS is_license_file FROM d WHERE score >= {licenses.THRESHOLD} GROUP BY doc_id),
l AS (SELECT dir AS from_dir, arg_min(own_license, struct_pack(s := -own_score, t := own_license)) AS dir_license FROM o JOIN f USING (doc_id) WHERE is_license_file GROUP BY dir),
a AS (SELECT dir, k, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') AS from_dir FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM f))),
n AS (SELECT dir, arg_max(from_dir, k) AS from_dir, arg_max(dir_license, k) AS dir_license FROM a JOIN l USING (from_dir) GROUP BY dir)
SELECT f.doc_id, coalesce(n_units, 0) AS n_units, own_license, own_score, coalesce(is_license_file, false) AS is_license_file, coalesce(own_license, dir_license) AS license, CASE WHEN own_license IS NULL THEN n.from_dir END AS from_dir
FROM f LEFT JOIN o USING (doc_id) LEFT JOIN n USING (dir)
"""


OP3_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS key
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM k),
p AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
m AS (SELECT p.doc_id, p.n, p.i, k.item FROM p JOIN k ON p.n = k.n AND p.key = k.key),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 80 * (p.n + q.n - m)),
r AS (WITH RECURSIVE t AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT t.x, e.y FROM t JOIN e ON t.y = e.x) SELECT x, min(y) AS component_id FROM t GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id
"""
