"""Exact top-k by inner product over a bit-sliced index.

Every component x becomes the integer floor(scale * x); an offset makes it unsigned. A block of vectors holds, for each
attribute and bit, a bitmap of the vectors that have the bit. A query weighs each bitmap by its own component: the
component in signed binary digits says which shifted bitmaps (or complements, for negative digits) to add, and carry-save
adders add them 64 vectors an operation. The lowest `dropped` bits of the attributes are not sliced; they bound the score
from above and below. The k-th best lower bound is found from the most significant slice of the sums downward, rows below
it by more than the bound's width are out, and the rest (the boundary and what is above it) are scored exactly.

Defined results: vectors that are null, or hold a null or non-finite component, take no part as query or candidate, nor
does an empty one; ties go to the smaller vec_id; a query with fewer candidates returns all; vectors of other lengths than
the query's are no candidates of it; repeated vec_ids are candidates each, but not of a query with their own id; an empty table gives no rows;
components of any finite size are scored exactly, those beyond 64 bits after scaling count as the largest of 64 bits, and a score beyond
64 bits is an error; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE = 1024
TOP = 10
#: Vectors in a block of the index, queries in a block: what one task holds.
BLOCK = 1 << 15
QUERIES = 1 << 10
#: Low bits of an attribute that are bounded instead of sliced.
DROPPED = 3


def pack(x: np.ndarray) -> np.ndarray:
    """Boolean rows to bitmaps of 64-bit words."""
    n = x.shape[-1]
    padded = np.zeros((*x.shape[:-1], -(-n // 64) * 64), np.bool_)
    padded[..., :n] = x
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class BitSliced:
    """The index of one block: integer rows, and their upper bits as bitmaps."""

    def __init__(self, rows: np.ndarray, dropped: int = DROPPED):
        self.rows = rows
        self.low = int(rows.min(initial=0))
        shifted = (rows - self.low).T >> dropped
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        self.slices = np.stack([pack((shifted >> b) & 1 == 1) for b in range(self.bits)], 1) if rows.size else None
        self.dropped = dropped
        self.all = pack(np.ones((1, len(rows)), np.bool_))[0]

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of sum(q * (x >> dropped)) plus a constant that makes it unsigned, and that constant."""
        columns: list[list[np.ndarray]] = []
        constant = 0
        for d, q in enumerate(query.tolist()):
            shift = 0
            while q:
                digit = 0
                if q & 1:
                    digit = 2 - (q & 3)  # 1 or -1: the next digit is 0 then
                    q -= digit
                if digit:
                    for b in range(self.bits):
                        at = b + shift
                        while len(columns) <= at:
                            columns.append([])
                        columns[at].append(self.slices[d, b] if digit > 0 else self.slices[d, b] ^ self.all)
                        if digit < 0:
                            constant += 1 << at
                q >>= 1
                shift += 1
        out = []
        at = 0
        while at < len(columns):
            column = columns[at]
            if at + 1 >= len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[at + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                column[:] = [a ^ b]
                columns[at + 1].append(a & b)
            out.append(column[0] if column else np.zeros_like(self.all))
            at += 1
        return out, constant

    def best(self, query: np.ndarray, k: int, barred: np.ndarray | None = None) -> np.ndarray:
        """Positions that may be among the k highest scores, all that are among them."""
        slices, constant = self.sums(query)
        live = self.all.copy() if barred is None else self.all & ~barred
        taken, chosen, floor = 0, np.zeros_like(live), 0
        for at in range(len(slices) - 1, -1, -1):  # most significant slice first: the k-th value, bit by bit
            ones = live & slices[at]
            n = int(np.bitwise_count(ones).sum())
            if taken + n >= k:
                live, floor = ones, floor | 1 << at
            else:
                chosen |= ones
                taken += n
                live = live & ~slices[at]
        # score = 2**dropped * sum + q . rest, 0 <= rest < 2**dropped: rows that much lower can still be ahead.
        q = query.astype(object)
        width = int(sum(abs(int(x)) for x in q)) * ((1 << self.dropped) - 1)
        reach = floor - (-(-width >> self.dropped) if width else 0) - 1
        keep = self._at_least(slices, reach)
        return np.flatnonzero(np.unpackbits((keep & (self.all if barred is None else self.all & ~barred)).view(np.uint8), bitorder="little"))

    def _at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """Bitmap of the rows whose sum is `bound` or more."""
        if bound <= 0:
            return self.all
        if bound.bit_length() > len(slices):
            return np.zeros_like(self.all)
        equal, more = self.all.copy(), np.zeros_like(self.all)
        for at in range(len(slices) - 1, -1, -1):
            if bound >> at & 1:
                equal &= slices[at]
            else:
                more |= equal & slices[at]
                equal &= ~slices[at]
        return more | equal


def top_of_block(index: BitSliced, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the block's k best for a query, ties by id."""
    at = index.best(query, k, pack((ids == query_id)[None])[0])
    scores = index.rows[at] @ query
    order = np.lexsort((ids[at], -scores))[:k]
    return ids[at][order], scores[order]


#: From here on sums of products could leave 64 bits on the way; they are taken in integers without a limit.
_WIDE = 1 << 62


def _wide_top(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for components so large that products need more than 64 bits; a score that does is an error."""
    scores = rows.astype(object) @ query.astype(object)
    at = sorted((j for j in range(len(ids)) if ids[j] != query_id), key=lambda j: (-scores[j], ids[j]))[:k]
    return ids[at], np.array([int(scores[j]) for j in at], np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block to one row: ids and components as bytes."""
    ids, rows, key = [], [], None

    def flush():
        i, r = np.concatenate(ids), np.concatenate(rows)
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([i.tobytes()], pa.binary()), pa.array([r.tobytes()], pa.binary())], ["dims", "block", "ids", "vectors"])

    for batch in batches:
        dims, block = batch.column("dims").to_numpy(), batch.column("block").to_numpy()
        edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(block)], strict=True):
            if a == b:
                continue
            now = (int(dims[a]), int(block[a]))
            if key is not None and now != key:
                yield flush()
                ids, rows = [], []
            key = now
            ids.append(batch.column("id").slice(a, b - a).to_numpy().astype(np.int64))
            flat = batch.column("v").slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
            rows.append(flat.reshape(b - a, now[0]).astype(np.int64))
    if key is not None:
        yield flush()


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, ids, vectors, qids, qvectors in zip(*(batch.column(c).to_pylist() for c in ("dims", "ids", "vectors", "qids", "qvectors")), strict=True):
                i = np.frombuffer(ids, np.int64)
                rows = np.frombuffer(vectors, np.int64).reshape(len(i), dims)
                index, most = None, max(int(rows.max()), -int(rows.min()))
                q, n = np.frombuffer(qids, np.int64), []
                best, scores = [], []
                for qid, query in zip(q.tolist(), np.frombuffer(qvectors, np.int64).reshape(len(q), dims), strict=True):
                    if most * sum(abs(int(x)) for x in query) >= _WIDE:
                        b, s = _wide_top(rows, i, query, qid, k)
                    else:
                        index = index or BitSliced(rows)
                        b, s = top_of_block(index, i, query, qid, k)
                    best.append(b)
                    scores.append(s)
                    n.append(len(b))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, n)), pa.array(np.concatenate(best)), pa.array(np.concatenate(scores))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k highest integer inner products.

    `is_query` is a condition on the column `id`. Blocks of the index meet blocks of queries by the pair of their numbers;
    a task holds one of each, and hands on k rows a query. Only those partial results are sorted by query.
    """
    rows = common.columns(vectors, id=id_col, v=vector_col).select(F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"))
    whole = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    ints = whole.select("id", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    asked = ints.filter(is_query)
    n, nq = (f.groupBy().count().first()[0] for f in (ints, asked))
    if not nq:
        return ints.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, qblocks = -(-n // block), -(-nq // queries)

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        keyed = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))
        return keyed.repartition(max(1, parts), "dims", "block").sortWithinPartitions("dims", "block").mapInArrow(_packed, "dims int, block long, ids binary, vectors binary")

    left = dealt(ints, blocks).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    right = dealt(asked, qblocks).select("dims", F.col("block").cast("int").alias("q"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    pairs = left.join(right.hint("shuffle_hash"), ["dims", "block", "q"])
    partial = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
