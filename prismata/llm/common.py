"""What the operators of this package share: the shared folder, tables, text buffers."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a kernel works on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="prismata-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/prismata/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes a frame to a table in the shared folder and reads it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def stored_in_turns(frames: Iterator[DataFrame], name: str, compression: str | None = None) -> DataFrame:
    """Writes frames of one schema to one table, one after the other; the shuffle files of each go before the next begins."""
    path = spark = schema = None
    for df in frames:
        spark, schema = df.sparkSession, df.schema
        path = path or scratch(spark, name)
        df.write.mode("append").parquet(path, compression=compression)
        del df
        release(spark)
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder; for narrow frames."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of frames that are no longer referenced, and waits a moment for it."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def discard(df: DataFrame) -> None:
    """Deletes the table of a frame that `stored` made, once nothing reads it any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/prismata/" in name:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def across(entries: DataFrame, key: str, group: str) -> tuple[int, float]:
    """How many entries there are, and how many pairs of them share a key but not a group."""
    counts = entries.groupBy(key, group).agg(F.count("*").cast("double").alias("m")).groupBy(key).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"))
    n, pairs = counts.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()
    return int(n or 0), float(pairs or 0)


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """The named input columns and nothing else, so further columns can't clash with an operator's own."""
    return df.select(*[F.col(f"`{name}`").alias(new) for new, name in wanted.items()])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets) of runs of whole texts."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


# Random odd multipliers and byte values of the rolling hashes.
_RNG = np.random.default_rng(20240607)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    found = _POWERS.get(int(base))
    if found is None or len(found) < n:
        size = max(n, CHUNK_BYTES + (1 << 18))
        found = np.full(size, base, np.uint64)
        found[0] = 1
        found = np.cumprod(found, dtype=np.uint64)
        if size <= 1 << 23:
            _POWERS[int(base)] = found
    return found[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """n + 1 running polynomial sums modulo 2**64; `span_hashes` takes substrings' hashes from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], alike for equal bytes wherever they lie."""
    return mixed((prefix[ends] - prefix[starts]) * _powers(BASE_INVERSE, len(prefix))[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes within texts, and the n + 1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(len(data) + 1, np.bool_)
    inside[:-1] = is_word[data]
    before = np.zeros(len(data) + 1, np.bool_)
    before[1:] = inside[:-1]
    edge = offsets[:-1]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    last = np.zeros(len(data) + 1, np.bool_)
    last[:-1] = inside[:-1] & ~inside[1:]
    tails = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[tails] = inside[tails]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: A-Z to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of the pattern [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, np.bool_)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text: 0-9, a-z and all beyond ASCII.
ALNUM = np.zeros(256, np.bool_)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
