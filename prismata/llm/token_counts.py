"""Token counts through a digest cache.

Whole texts are keyed by the SHA-256 of their normalised content, the cache by that digest and a digest of the
tokenizer's file and settings. Only distinct contents that the cache lacks are encoded, and their counts are appended.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); repeated texts are encoded once; an empty table
gives an empty table; further columns of the input are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
#: Tokens over which a text is marked, unless the caller says otherwise.
LIMIT = 512


@functools.lru_cache(maxsize=4)
def _counter(path: str):
    """A function from texts to token counts.

    A byte-level BPE file whose only added token is a special one is counted by the tiktoken library with the same
    vocabulary: the split pattern and the merges are the same, and it is over three times as fast. The special string
    itself counts as one token, as the tokenizers library has it. Any other .json goes through tokenizers, a .model
    through sentencepiece.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    spec = json.load(open(path, encoding="utf-8"))
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and len(spec["added_tokens"]) == 1 and spec["added_tokens"][0]["special"] and not model.get("ignore_merges")
    if not plain:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    special = spec["added_tokens"][0]["content"]
    # The printable stand-ins of byte-level BPE, and its split pattern.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes(chars[c] for c in piece): rank for piece, rank in model["vocab"].items() if piece != special}
    coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts = text.split(special) if special in text else [text]
            out.append(len(parts) - 1 + sum(len(coder.encode_ordinary(p)) for p in parts))
        return out

    return count


def count_tokens(path: str, texts: list[str]) -> list[int]:
    """Counts on the driver, for small inputs and tests."""
    return _counter(path)(texts)


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer version: its file's content and the settings of `count_tokens`."""
    return hashlib.sha256(open(path, "rb").read() + b"|no added special tokens|whole text").hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            texts = batch.column(1)
            counts = [n for at in range(0, len(texts), 256) for n in count([x or "" for x in texts.slice(at, 256).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    `tokenizer` is a path that all executors can open, `cache` a Parquet folder in a shared store; it is made when missing,
    and what this call had to encode is appended to it. Copies meet by digest after map-side aggregation, so that a text
    which a third of all rows repeat sends one row a task.
    """
    spark: SparkSession = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    rows = common.columns(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    if not known.isEmpty():
        misses = misses.join(known, "digest", "left_anti")
    fresh = misses.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # Cut, so that the join reads plain exchanges on both sides and adaptive execution can split a hot digest.
    counts = common.cut(spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return keyed.drop("text").join(counts, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
