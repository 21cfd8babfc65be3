"""Repeated byte strings of a given length, by a sparse suffix array in range-partitioned buckets.

Every byte covered by a LENGTH-byte string that also starts somewhere else (in the same text or another) is repeated.

Sampled suffixes. A suffix is taken at each position that holds the smallest TOKEN-byte hash, the leftmost of equal ones,
among the positions of some LENGTH-byte string. The choice depends on the string's bytes alone, so equal strings own equal
suffixes at equal places in them, and each string belongs to exactly one suffix: a suffix stands for a run of strings
around it, and what those cover is its context. That leaves about 2 suffixes for each LENGTH - TOKEN + 2 bytes and loses no string.

Buckets. Suffixes, summed map-side where contexts are equal, are range-partitioned with sampled splitters by their leading
token and context, and each bucket is sorted by multikey quicksort. Contexts found twice are repeated whole. A leading
token with several contexts is open, also when a bucket boundary cuts it: the first and last token of each bucket are
compared across boundaries. Open suffixes, which are few (the edges of copies), fetch their bytes, go to buckets by
token again, are sorted by multikey quicksort of their words, and what neighbours have in common bounds which
strings can be equal; those are told apart by hashes of the whole string. Tokens with more than HOT open contexts go
string by string through a map-side aggregation instead, so no bucket has to hold them.

Defined results: a null or empty text has 0 bytes, 0 removed, and the digest of nothing; a text shorter than LENGTH has
nothing to remove; copies are removed in all places; repeated rows are texts of their own (and so repeat each other); rows
with a null id are treated like others; an empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
TOKEN = 64
#: Positions of a piece that a kernel handles at once; longer texts go in pieces that overlap.
PIECE = 1 << 22
#: Open contexts of one token that a bucket may hold.
HOT = 20_000
#: Contexts compared at once within a bucket.
SLAB = 4096
_POSITION_BITS = np.uint64(24)
_NO_ID = -(1 << 63)


def sampled(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, token: int = TOKEN) -> tuple[np.ndarray, ...]:
    """Of texts in one array: suffix position, first and last string start (in the array), token and context hashes; by position."""
    n = len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < length:
        return none
    prefix = common.prefix_hashes(data)
    inverse = common._powers(common.BASE_INVERSE, n + 1)
    grams = common.mixed((prefix[token:] - prefix[:-token]) * inverse[: n - token + 1])
    best = (grams >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - token + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    at = (best & ((np.uint64(1) << _POSITION_BITS) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(at))
    text = np.searchsorted(offsets, starts, side="right") - 1
    whole = np.flatnonzero(starts + length <= offsets[text + 1])
    if not len(whole):
        return none
    at, text = at[whole], text[whole]
    new = np.ones(len(whole), np.bool_)
    new[1:] = (at[1:] != at[:-1]) | (np.diff(whole) != 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(whole)) - 1
    x, lo, hi = at[head], whole[head], whole[tail]
    key = grams[x]
    context = common.mixed((prefix[hi + length] - prefix[lo]) * inverse[lo] + ((x - lo) * 512 + (x - hi)).astype(np.uint64) * np.uint64(0x9E6D62D06F6A9A9B))
    return x, lo, hi, key, context


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of unsigned words by multikey quicksort: rows that tie up to a word are sorted by the next one."""
    order = np.argsort(words[:, 0], kind="quicksort")
    group = np.zeros(len(order), np.int64)
    for depth in range(words.shape[1]):
        if depth:
            tied = np.flatnonzero((np.diff(group, prepend=-1) == 0) | (np.diff(group, append=-1) == 0))
            if not len(tied):
                break
            sub = np.lexsort((words[order[tied], depth], group[tied]))
            order[tied] = order[tied][sub]
        value = words[order, depth]
        new = np.ones(len(order), np.bool_)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
    return order


_SUFFIX = "doc long, row long, pos int, reach int, key long, context long"


def _suffixes(length: int, token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = common.buffers(batch.column(2))
            for a, b, d, o in common.chunks(data, offsets):
                for shift in range(0, max(1, len(d)), PIECE):
                    piece = d[shift : shift + PIECE + length - 1]
                    inner = np.clip(o - shift, 0, len(piece))
                    x, lo, hi, key, context = sampled(piece, inner, length, token)
                    text = np.searchsorted(o, lo + shift, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(doc[a:b][text]), pa.array(row[a:b][text]), pa.array((x + shift - o[text]).astype(np.int32)), pa.array(((x - lo) << 16 | (x - hi)).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(context.view(np.int64))], ["doc", "row", "pos", "reach", "key", "context"])

    return run


def _runs(key: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, context) with summed n."""
    order = multikey_order(np.stack([key, context], 1))
    key, context, n = key[order], context[order], n[order]
    new = np.ones(len(key), np.bool_)
    new[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1])
    head = np.flatnonzero(new)
    return key[head], context[head], np.add.reduceat(n, head) if len(head) else n


def _presummed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of equal contexts, as far as a task's buffer sees them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        k, c = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        k, c, n = _runs(k, c, np.ones(len(k), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.view(np.int64)), pa.array(n)], ["key", "context", "n"])

    for batch in batches:
        held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)))
        size += batch.num_rows
        if size >= 1 << 20:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's suffixes that are repeated whole or may be in part; `edge` marks the tokens at its boundaries."""
    cols = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if not cols:
        return
    k, c, n = (np.concatenate([x[i] for x in cols]) for i in range(3))
    k, c, n = _runs(k.view(np.uint64), c.view(np.uint64), n)
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    several = np.repeat(np.diff(np.append(head, len(k))) > 1, np.diff(np.append(head, len(k))))
    edge = (k == k[0]) | (k == k[-1])
    keep = np.flatnonzero((n > 1) | several | edge)
    for at in range(0, len(keep), 1 << 16):
        i = keep[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(k[i].view(np.int64)), pa.array(c[i].view(np.int64)), pa.array(n[i]), pa.array(several[i]), pa.array(edge[i])], ["key", "context", "n", "several", "edge"])


def _fetch(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, contexts, reach, got = [], [], [], []
            for text, marks in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for m in marks:
                    left, least = m["reach"] >> 16, m["reach"] & 0xFFFF
                    keys.append(m["key"])
                    contexts.append(m["context"])
                    reach.append(m["reach"])
                    got.append(raw[m["pos"] - left : m["pos"] - least + length])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contexts, pa.int64()), pa.array(reach, pa.int32()), pa.array(got, pa.binary())], ["key", "context", "reach", "bytes"])

    return run


def _matrix(reach: np.ndarray, texts: list[bytes], length: int, token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in rows, suffixes at one column; the largest and smallest left reach."""
    left, least = reach >> 16, reach & 0xFFFF
    most = length - token
    out = np.zeros((len(texts), most + length), np.uint8)
    for i, t in enumerate(texts):
        at = most - left[i]
        out[i, at : at + len(t)] = np.frombuffer(t, np.uint8)
    return out, left, least


def _strings(rows: np.ndarray, length: int, token: int) -> np.ndarray:
    """Hashes of the strings that start 0 to length - token bytes left of the suffix."""
    most = length - token
    prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
    np.cumsum(common.BYTE_VALUES[rows] * common._powers(common.BASE, rows.shape[1])[None], axis=1, out=prefix[:, 1:])
    starts = most - np.arange(most + 1)
    return common.mixed((prefix[:, starts + length] - prefix[:, starts]) * common._powers(common.BASE_INVERSE, most + 1)[starts][None])


def compared(key: np.ndarray, reach: np.ndarray, texts: list[bytes], length: int, token: int) -> list[tuple[list[int], list[int]]]:
    """Runs of repeated bytes around each suffix (starts and ends relative to it), from contexts that share tokens."""
    rows, left, least = _matrix(reach, texts, length, token)
    most = length - token
    right = rows[:, most:]
    words = np.concatenate([key[:, None], np.ascontiguousarray(np.pad(right, ((0, 0), (0, -length % 8)))).view(">u8").astype(np.uint64)], 1)
    order = multikey_order(words)
    # What neighbours in suffix order share to the right bounds what any two suffixes share.
    same = (words[order[1:]] == words[order[:-1]])
    run = np.where(same.all(1), same.shape[1], same.argmin(1))
    shared = np.where(run > 0, np.minimum(length, run * 8), 0)  # words less the token, and up to a word more
    ahead = np.zeros(len(order), np.int64)
    ahead[order[1:]] = shared
    ahead[order[:-1]] = np.maximum(ahead[order[:-1]], shared)
    j = np.arange(most + 1)
    live = (j >= least[:, None]) & (j <= left[:, None]) & (length - j <= ahead[:, None])
    which, offset = np.nonzero(live)
    found = np.zeros(live.shape, np.bool_)
    if len(which):
        hashes = _strings(rows, length, token)[which, offset]
        full = common.mixed(hashes + key[which] * np.uint64(0x9E3779B97F4A7C15) + offset.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        _, back, counts = np.unique(full, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        found[which[twice], offset[twice]] = True
    return [_covered(found[i], length) for i in range(len(texts))]


def _covered(flags: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [-int(b - 1) for b in edges[1::2]], [length - int(a) for a in edges[::2]]


def _compare_bucket(length: int, token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a slab holds whole keys."""
        held: list[pa.RecordBatch] = []

        def judged(table: pa.Table) -> pa.RecordBatch:
            key = table["key"].to_numpy().view(np.uint64)
            spans = compared(key, table["reach"].to_numpy(), table["bytes"].to_pylist(), length, token)
            return pa.RecordBatch.from_arrays([table["key"].combine_chunks(), table["context"].combine_chunks(), pa.array([s[0] for s in spans], pa.list_(pa.int32())), pa.array([s[1] for s in spans], pa.list_(pa.int32()))], ["key", "context", "starts", "ends"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) < SLAB:
                continue
            table = pa.Table.from_batches(held)
            keys = table["key"].to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
            if cut:
                yield judged(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held and sum(h.num_rows for h in held):
            yield judged(pa.Table.from_batches(held))

    return run


def _string_rows(length: int, token: int):
    """Contexts to a row for each of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows, left, least = _matrix(part.column("reach").to_numpy(), part.column("bytes").to_pylist(), length, token)
                j = np.arange(length - token + 1)
                which, offset = np.nonzero((j >= least[:, None]) & (j <= left[:, None]))
                h = _strings(rows, length, token)[which, offset]
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(which)), part.column("context").take(pa.array(which)), pa.array(offset.astype(np.int32)), pa.array(h.view(np.int64))], ["key", "context", "j", "string"])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, spans) to the digest of what is left."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            runs = merged([(s["start"], s["end"]) for s in spans or ()])
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in runs]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, token: int = TOKEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every row."""
    spark = docs.sparkSession
    texts = common.columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select(F.coalesce("id", F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text", "id")
    long = texts.filter(F.octet_length("text") >= length)
    suffixes = common.stored(long.select("doc", "row", "text").mapInArrow(_suffixes(length, token), _SUFFIX), "suffixes")

    # Buckets by leading token and context; Spark samples the splitters.
    sums = suffixes.select("key", "context").mapInArrow(_presummed, "key long, context long, n long")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = common.stored(sums.repartitionByRange(parts, "key", "context").mapInArrow(_bucket, "key long, context long, n long, several boolean, edge boolean"), "suffix-runs")
    common.release(spark)
    # Tokens that boundaries cut: at most two a bucket.
    cut = [r[0] for r in found.filter("edge").groupBy("key").agg((F.min("context") < F.max("context")).alias("several")).filter("several").select("key").collect()]
    across = F.col("key").isin(cut) if cut else F.lit(False)
    marks = found.select("key", "context", "n", (F.col("several") | (F.col("edge") & across)).alias("open")).filter("open or n > 1")

    places = common.stored(suffixes.join(marks, ["key", "context"]), "suffix-places")
    common.release(spark)
    whole = places.filter("n > 1").select("doc", "row", (F.col("pos") - F.shiftright("reach", 16)).alias("start"), (F.col("pos") - F.col("reach").bitwiseAND(0xFFFF) + length).alias("end"))

    # One place of each open context gives its bytes.
    one = places.filter("open").groupBy("key", "context").agg(F.min(F.struct("doc", "row", "pos", "reach")).alias("at")).select("key", "context", "at.*")
    asked = one.groupBy("doc", "row").agg(F.collect_list(F.struct("key", "context", "pos", "reach")).alias("marks"))
    once = long.join(asked, ["doc", "row"]).groupBy("doc", "row").agg(F.first("text").alias("text"), F.first("marks").alias("marks"))
    contexts = common.stored(once.select("text", "marks").mapInArrow(_fetch(length), "key long, context long, reach int, bytes binary"), "suffix-contexts")
    common.release(spark)
    hot = common.cut(contexts.groupBy("key").count().filter(F.col("count") > HOT).select("key"))
    if hot.isEmpty():
        cool, extra = contexts, None
    else:
        cool = contexts.join(hot, "key", "left_anti")
        strings = contexts.join(hot, "key", "left_semi").mapInArrow(_string_rows(length, token), "key long, context long, j int, string long")
        twice = strings.groupBy("key", "j", "string").agg(F.min("context").alias("c0"), F.max("context").alias("c1")).filter("c0 < c1").select("key", "j", "string")
        extra = strings.join(twice, ["key", "j", "string"]).select("key", "context", (-F.col("j")).alias("start"), (length - F.col("j")).alias("end"))
    answers = cool.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(_compare_bucket(length, token), "key long, context long, starts array<int>, ends array<int>")
    spans = answers.select("key", "context", F.explode(F.arrays_zip("starts", "ends")).alias("s")).select("key", "context", F.col("s.starts").alias("start"), F.col("s.ends").alias("end"))
    if extra is not None:
        spans = spans.unionByName(extra)
    part = places.filter("open and n = 1").select("doc", "row", "pos", "key", "context").join(spans, ["key", "context"]).select("doc", "row", (F.col("pos") + F.col("start")).alias("start"), (F.col("pos") + F.col("end")).alias("end"))
    by_text = common.stored(whole.unionByName(part).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans")
    common.release(spark)
    result = texts.join(by_text, ["doc", "row"], "left").select("id", "text", "spans").mapInArrow(_kept, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")
    return result.withColumnRenamed("doc", id_col)
