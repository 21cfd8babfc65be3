"""Files of the data model: dense matrices, label files, document JSON, stringified CSV, pairs, logs, frame folders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DISTRIBUTION = "map<string,double>"
ANNOTATION = f"struct<label:int,mask:double,attributes:struct<age:{DISTRIBUTION},gender:{DISTRIBUTION},race:{DISTRIBUTION},expression:{DISTRIBUTION},pose:struct<yaw:double,pitch:double,roll:double>>>"
ANNOTATIONS = f"struct<labels:map<string,{ANNOTATION}>,ignore:array<string>>"
DETECTIONS = "name string, confidence double, box string, left_eye string, right_eye string, nose string, mouth_left string, mouth_right string, image string, face string, crop string"
LOG = "ts string, level string, message string"


def read_matrix(spark: SparkSession, path: str, dim: int, dtype: str = "float32", rows_a_part: int = 1 << 16) -> DataFrame:
    """(id, vec) of a header-less row-major matrix; the place in the file is the id.

    Ranges of rows are tasks. Each reads its own bytes through pyarrow's file systems, so a file of any size is split.
    """
    width = dim * np.dtype(dtype).itemsize
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).getLen()
    n = size // width
    starts = spark.range(0, n, rows_a_part).repartition(max(1, min(10_000, -(-n // rows_a_part))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with store.open_input_file(name) as f:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    m = min(rows_a_part, n - start)
                    x = np.frombuffer(f.read_at(m * width, start * width), dtype).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + m)), pa.ListArray.from_arrays(pa.array(np.arange(0, m * dim + 1, dim, dtype=np.int32)), pa.array(x))], ["id", "vec"])

    return starts.mapInArrow(run, "id long, vec array<float>")


def write_matrix(df: DataFrame, path: str) -> None:
    """Parts of rows sorted by id, each a binary column; `read_matrix_parts` reads them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([flat.tobytes()], pa.binary())], ["first", "content"])

    df.select(F.col("id").cast("long"), "vec").repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, "first long, content binary").write.mode("overwrite").parquet(path)


def read_matrix_parts(spark: SparkSession, path: str, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(content, np.float32)
                m = len(x) // dim
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + m)), pa.ListArray.from_arrays(pa.array(np.arange(0, m * dim + 1, dim, dtype=np.int32)), pa.array(x))], ["id", "vec"])

    return spark.read.schema("first long, content binary").parquet(path).mapInArrow(run, "id long, vec array<float>")


def read_labels(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(id, label): one label a line, the line's number is the id."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("id", "v"))
    return lines.filter("trim(v) <> ''").select((F.col("id") + start).cast("long").alias("id"), F.trim("v").cast("int").alias("label"))


def write_labels(df: DataFrame, path: str) -> None:
    df.orderBy("id").select(F.col("label").cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, label, mask, attributes) and the ignored pairs (c1, c2) of annotation documents."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", ANNOTATIONS).alias("d"))
    labels = doc.select(F.explode("d.labels").alias("name", "a")).select("name", "a.*")
    ignored = doc.select(F.explode("d.ignore").alias("p")).select(F.split("p", ",")[0].cast("int").alias("c1"), F.split("p", ",")[1].cast("int").alias("c2"))
    return labels, ignored


def annotations_json(rows: DataFrame) -> DataFrame:
    """One document (value) of rows (name, label, ...). For exports that fit one document; larger ones stay a table."""
    rest = [c for c in rows.columns if c != "name"]
    return rows.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(*rest))))).alias("labels"))).alias("value"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """(c1, c2, dist) of a document {"matches": {"c1,c2": dist}}."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<matches:map<string,double>>").alias("d"))
    pairs = doc.select(F.explode("d.matches").alias("k", "dist"))
    return pairs.select(F.split("k", ",")[0].cast("int").alias("c1"), F.split("k", ",")[1].cast("int").alias("c2"), "dist")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.keys import tuple_of_ints

    raw = spark.read.schema(DETECTIONS).csv(path, header=True, quote='"', escape='"')
    point = lambda c: F.struct(tuple_of_ints(F.col(c))[0].alias("x"), tuple_of_ints(F.col(c))[1].alias("y")).alias(c)
    return raw.select("name", "confidence", tuple_of_ints(F.col("box")).alias("box"), F.struct(*map(point, ("left_eye", "right_eye", "nose", "mouth_left", "mouth_right"))).alias("landmarks"), *[tuple_of_ints(F.col(c)).alias(c) for c in ("image", "face", "crop")])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).csv(path, sep="\t", quote="").withColumn("ts", F.try_to_timestamp("ts"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, first, second, is_same): a line of three fields names two pictures of one person, of four, of two persons."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pair_id", "line"))
    f = F.split(F.trim("line"), r"\s+")
    picture = lambda who, k: F.format_string("%s/%s_%04d.jpg", f[who], f[who], f[k].cast("int"))
    same = F.size(f) == 3
    return lines.filter(F.size(f).isin(3, 4)).select(F.col("pair_id").cast("long"), picture(0, 1).alias("first"), F.when(same, picture(0, 2)).otherwise(picture(2, 3)).alias("second"), same.alias("is_same"))


def merge_parts(parts: DataFrame, key: str = "name", file: str = "file") -> DataFrame:
    """Part tables merged: of rows with one key the one of the last file stays."""
    rest = [c for c in parts.columns if c != key]
    return parts.groupBy(key).agg(F.max_by(F.struct(*rest), file).alias("r")).select(key, "r.*")


def read_frames(spark: SparkSession, folder: str, stream: bool = False, files_a_trigger: int = 100) -> DataFrame:
    """(name, channel, ts, content) of files named channel_frame_digits.png, as a table or a stream."""
    from ..functions.keys import digit_timestamp

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger) if stream else spark.read
    raw = reader.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split(F.regexp_replace(name, r"\.png$", ""), "_")
    return raw.filter(F.size(parts) == 3).select(name.alias("name"), parts[0].alias("channel"), digit_timestamp(parts[2]).alias("ts"), "content")


def next_batch(names: DataFrame, last: str | None, n: int) -> DataFrame:
    """The first n names after the watermark."""
    return (names.filter(F.col("name") > last) if last else names).orderBy("name").limit(n)


def positions(df: DataFrame, order: str) -> DataFrame:
    """0-based place of each row of one sorted file."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(order)) - 1)
