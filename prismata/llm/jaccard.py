"""Exact n-gram Jaccard join by prefix index lists, with skipping by set relations.

Sets are the distinct hashes of K-word shingles, in one global order: shingles that are frequent in a sample of texts come
last, the others by hash. (The order decides how long lists get, never what is found.) Two sets of similarity t or more
share a shingle among their first n - ceil(t * n) + 1, so only these go to the index lists.

* Equal sets are one class before anything else; index lists hold classes, not documents.
* Lists are built in one shuffle: entries (shingle, class, position) are packed by ranges of shingles, and lists of a single
  class, nearly all of them, are dropped where a range is sorted. Nothing else of the index is ever written.
* Block skipping: lists are read by blocks of position. The first block gives the classes of a list one leader; the others are
  read only where a list still holds two groups. A pair is skipped where its sizes or positions rule the similarity out, where
  the shingles before the shared one are the same (it is found there), or by its parity maps: a map of n or more bits has a bit flipped for each shingle, so maps of two sets never differ in
  more bits than the sets in shingles. Maps folded to LEAST_BITS go with the entries, so that the join that finds a pair rules
  it out. All of these are bounds, so no link is lost.
* Answers from similar sets: a class that was verified against a leader takes over the leader's group, and pairs inside one
  group are never looked at again, since their component is known. What is left is verified exactly, pair by pair, on the
  whole sets.

Every pair of different groups that shares an indexed shingle and passes the bounds is verified. All lists go through a
leader round; then those of up to SMALL classes compare what is left all with all, and longer ones (copies by the thousand)
shrink in further leader rounds before they are exhausted.

Sets are told apart, and shingles compared, by 64-bit and 63-bit hashes.

Defined results: a null or empty text, or one without words, has 0 shingles, no links and is its own component; a text of
fewer than K words has one shingle; rows with a null id have a null component and link with nothing; repeated ids are rows
of their own, each linked by its own text; an empty table gives no rows; extra columns are not looked at; very long texts
are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from . import common, shingles

K = 5
PERCENT = 80
#: Positions of the first block.
FIRST = 4
#: The order is taken from one text in SAMPLE_EVERY, or more if the corpus has fewer than SAMPLE_LEAST * SAMPLE_EVERY; shingles seen in FREQUENT of them come last, at most FREQUENT_MOST of them.
SAMPLE_EVERY = 16
SAMPLE_LEAST = 4000
FREQUENT = 2
FREQUENT_MOST = 1 << 18
#: Classes of a list that are compared all with all at once.
SMALL = 64
#: Longer lists are exhausted once they promise this many comparisons an entry, or after LEADER_ROUNDS.
PAIRS_AN_ENTRY = 500
LEADER_ROUNDS = 6
#: Ranges of shingles a partition.
RANGES = 16
#: Bits of the smallest parity map.
LEAST_BITS = 256
FOLDS = [f"f{i}" for i in range(LEAST_BITS // 64)]

_FACTOR = common._RNG.integers(1, 2**63, 1, dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)
_LAST = np.uint64(1) << np.uint64(63)
#: A shingle, the one before it in the set's order (0 for the first), the class, the position and the size.
_ENTRY = np.dtype([("v", "<u8"), ("before", "<u8"), ("key", "<i8"), ("p", "<u4"), ("n", "<u4")])


def _sampled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            for _, _, d, o in common.chunks(data, offsets):
                s, _ = shingles.sets(d, o, k)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    return run


def frequent(texts: DataFrame, k: int = K) -> np.ndarray:
    """Sorted shingles that a sample of the texts repeats; a bounded number, for the order only."""
    n = texts.count()
    every = max(1, min(SAMPLE_EVERY, n // SAMPLE_LEAST))
    sample = texts.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text")
    found = sample.mapInArrow(_sampled(k), "s long").groupBy("s").count().filter(F.col("count") >= FREQUENT)
    top = found.orderBy(F.col("count").desc(), "s").limit(FREQUENT_MOST).select("s").toPandas()["s"]
    return np.sort(top.to_numpy(np.int64)).view(np.uint64)


def parity(s: np.ndarray) -> bytes:
    """A map of at least as many bits as there are shingles (a power of two), in which each shingle flips one."""
    size = max(LEAST_BITS, 1 << int(len(s) - 1).bit_length())
    counts = np.bincount((common.mixed(s) & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two parity maps differ, the longer folded to the shorter; never more than the sets differ in shingles."""
    if len(x) < len(y):
        x, y = y, x
    a = int.from_bytes(x, "big")
    while len(x) > len(y):
        # Bit i of a map comes first, so the halves are i and i + size / 2.
        half = len(x) * 4
        a = (a >> half) ^ (a & ((1 << half) - 1))
        x = x[: len(x) // 2]
    return (a ^ int.from_bytes(y, "big")).bit_count()


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, map) to (key, the map folded to LEAST_BITS, as longs)."""
    for batch in batches:
        words = [np.bitwise_xor.reduce(np.frombuffer(m.as_py(), np.int64).reshape(-1, LEAST_BITS // 64), axis=0) for m in batch.column(1)]
        folds = np.array(words, np.int64).reshape(-1, LEAST_BITS // 64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(folds[:, i]) for i in range(folds.shape[1])]], ["key", *FOLDS])


def _indexed(shared, k: int, percent: int, ranges: int):
    """(id, row, text) to a row of each text, and packed index entries of the classes that the task has not seen yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.frombuffer(shared.value, np.uint64)
        seen: set[int] = set()
        for batch in batches:
            data, offsets = common.buffers(batch.column(2))
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            held = []
            for a, b, d, o in common.chunks(data, offsets):
                s, at = shingles.sets(d, o, k)
                n = np.diff(at)
                full = np.flatnonzero(n)
                keys = np.zeros(len(n), np.uint64)
                if len(full):
                    keys[full] = common.mixed(np.add.reduceat(common.mixed(s), at[:-1][full]) + np.add.reduceat(common.mixed(s * _FACTOR), at[:-1][full]) * _FACTOR)
                keys = keys.view(np.int64)
                fresh = np.zeros(len(n), np.bool_)
                maps: list[bytes | None] = [None] * len(n)
                for i in full.tolist():
                    key = int(keys[i])
                    if known[a + i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                        maps[i] = parity(s[at[i] : at[i + 1]])
                docs = np.repeat(np.arange(len(n)), n)
                mine = fresh[docs]
                s, docs = s[mine], docs[mine]
                v = s
                if len(late) and len(s):
                    near = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    v = np.where(late[near] == s, s | _LAST, s)
                order = np.lexsort((v, docs))
                v, docs = v[order], docs[order]
                rank = np.arange(len(v)) - np.searchsorted(docs, docs)
                take = rank < (n - (n * percent + 99) // 100 + 1)[docs]
                found = np.empty(int(take.sum()), _ENTRY)
                found["before"] = np.where(rank > 0, np.concatenate([v[:1], v[:-1]]), np.uint64(0))[take]
                found["v"], found["key"], found["p"], found["n"] = v[take], keys[docs[take]], rank[take], n[docs[take]]
                held.append(found)
                size = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array((keys % ranges).astype(np.int32)), batch.column(0).slice(a, size), batch.column(1).slice(a, size), pa.array(n.astype(np.int32)), pa.array(keys), pa.array(maps, pa.binary()), pa.nulls(size, pa.binary())],
                    ["range", "id", "row", "n", "key", "map", "entries"],
                )
            found = np.concatenate(held) if held else np.empty(0, _ENTRY)
            # Frequent shingles have the first bit; the others fill the space below it.
            part = ((found["v"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(31)).astype(np.int64) % ranges
            order = np.argsort(part, kind="stable")
            found, edges = found[order], np.searchsorted(part[order], np.arange(ranges + 1))
            full = np.flatnonzero(np.diff(edges))
            if len(full):
                none = lambda kind: pa.nulls(len(full), kind)
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.binary()), pa.array([found[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary())], ["range", "id", "row", "n", "key", "map", "entries"])

    return run


def _shared_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts as they are, and the entries of lists that hold two classes; rows come range by range."""

    def lists(blobs: list[bytes]) -> pa.RecordBatch:
        e = np.frombuffer(b"".join(blobs), _ENTRY)
        e = e[np.lexsort((e["key"], e["v"]))]
        same = e["v"][1:] == e["v"][:-1]
        new = np.concatenate([[True], ~(same & (e["key"][1:] == e["key"][:-1]))])  # other tasks saw the class too
        e = e[new]
        same = np.concatenate([[False], e["v"][1:] == e["v"][:-1], [False]])
        e = e[same[1:] | same[:-1]]
        none = lambda kind: pa.nulls(len(e), kind)
        return pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), pa.array(e["n"].astype(np.int32)), pa.array(e["key"]), none(pa.binary()), pa.array(e["v"].astype(np.uint64).view(np.int64)), pa.array(e["before"].astype(np.uint64).view(np.int64)), pa.array(e["p"].astype(np.int32))], ["id", "row", "n", "key", "map", "v", "before", "p"])

    now, blobs = -1, []
    for batch in batches:
        packed = batch.column(6)
        whole = packed.is_null()
        plain = batch.filter(whole)
        if plain.num_rows:
            yield pa.RecordBatch.from_arrays([*plain.columns[1:6], pa.nulls(plain.num_rows, pa.int64()), pa.nulls(plain.num_rows, pa.int64()), pa.nulls(plain.num_rows, pa.int32())], ["id", "row", "n", "key", "map", "v", "before", "p"])
        rest = batch.filter(packed.is_valid())
        for at, blob in zip(rest.column(0).to_pylist(), rest.column(6), strict=True):
            if at != now:
                if blobs:
                    yield lists(blobs)
                now, blobs = at, []
            blobs.append(blob.as_py())
    if blobs:
        yield lists(blobs)


def _set_of(k: int):
    """(key, text) to (key, sorted shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            for a, b, d, o in common.chunks(data, offsets):
                s, at = shingles.sets(d, o, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([s[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)], pa.binary())], ["key", "s"])

    return run


def _verified(percent: int):
    """(a, b, shingles of a, shingles of b) to whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                found.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], ["a", "b", "linked"])

    return run


def _possible(percent: int):
    """(a, b, na, nb, map of a, map of b) to the pairs that the maps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(100 + percent) * bits_apart(x.as_py(), y.as_py()) <= (100 - percent) * (n + m) for n, m, x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _bounded(percent: int):
    """Sizes, positions of a shared shingle and folded maps (n, p and FOLDS ending in x and y) allow the similarity, and the one
    before it is not shared too: the first that two sets share is enough, and before it they differ."""
    nx, ny, px, py = (F.col(c) for c in ("nx", "ny", "px", "py"))
    apart = reduce(add, [F.bit_count(F.col(f"{c}x").bitwiseXOR(F.col(f"{c}y"))) for c in FOLDS])
    rest = F.least(nx - px, ny - py)
    fresh = (px == 0) | (py == 0) | (F.col("beforex") != F.col("beforey"))
    return fresh & (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (rest * (100 + percent) >= (nx + ny) * percent) & ((100 + percent) * apart <= (100 - percent) * (nx + ny))


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; sets link when 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    rows = common.columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), F.xxhash64("text").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(frequent(rows.filter(F.col("id").isNotNull()), k).tobytes())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(_indexed(shared, k, percent, RANGES * parts), "range int, id long, row long, n int, key long, map binary, entries binary")
    index = packed.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_shared_lists, "id long, row long, n int, key long, map binary, v long, before long, p int")
    tables = [common.stored(index, "jaccard-index")]
    common.release(spark)
    members = tables[0].filter("v is null").select("id", "row", "n", "key", "map")
    lists = tables[0].filter("v is not null").select("v", "before", "key", "n", "p")

    def stored(df: DataFrame, name: str) -> DataFrame:
        tables.append(common.stored(df, name))
        return tables[-1]

    # One row a class: its first text and the parity map.
    classes = stored(members.filter("n > 0 and id is not null").groupBy("key").agg(F.min(F.struct("id", "row")).alias("at"), F.max("map").alias("map"), F.min("n").alias("n")).select("key", "at.id", "at.row", "map", "n"), "jaccard-classes")
    sizes = lists.groupBy("v").agg(F.count("*").alias("m"))
    folds = classes.select("key", "map").mapInArrow(_folded, "key long, " + ", ".join(f"{c} long" for c in FOLDS))
    entries = stored(lists.join(sizes, "v").join(folds, "key"), "jaccard-lists")

    comp: DataFrame | None = None  # (id, component) of linked classes
    links: DataFrame | None = None
    failed: DataFrame | None = None
    sets: DataFrame | None = None

    def sided(df: DataFrame, side: str, *more: str) -> DataFrame:
        return df.select(F.col("v").alias(f"v{side}"), *[F.col(c).alias(f"{c}{side}") for c in ("key", "n", "p", "before", *FOLDS, *more)])

    def judged(pairs: DataFrame) -> None:
        """Verifies pairs (p, q) that were not tried before and brings components up to date."""
        nonlocal comp, links, failed, sets
        asked = pairs.distinct()
        if failed is not None:
            asked = asked.join(failed, ["p", "q"], "left_anti")
        maps = classes.select("key", "n", "map")
        both = asked.join(maps.toDF("p", "np", "mp"), "p").join(maps.toDF("q", "nq", "mq"), "q").select("p", "q", "np", "nq", "mp", "mq")
        todo = stored(both.mapInArrow(_possible(percent), "p long, q long"), "jaccard-pairs")
        keys = todo.select(F.col("p").alias("key")).unionByName(todo.select(F.col("q").alias("key"))).distinct()
        if sets is not None:
            keys = keys.join(sets.select("key"), "key", "left_anti")
        places = classes.select("key", "id", "row").join(keys, "key", "left_semi")
        found = rows.join(places.hint("shuffle_hash"), ["id", "row"]).select("key", "text").mapInArrow(_set_of(k), "key long, s binary")
        new = stored(found.dropDuplicates(["key"]), "jaccard-sets")  # rows may repeat
        sets = new if sets is None else sets.unionByName(new)
        pair_sets = todo.join(sets.toDF("p", "x"), "p").join(sets.toDF("q", "y"), "q").select("p", "q", "x", "y")
        result = stored(pair_sets.mapInArrow(_verified(percent), "a long, b long, linked boolean"), "jaccard-judged")
        good = result.filter("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        links = good if links is None else links.unionByName(good)
        wrong = result.filter("not linked").select(F.col("a").alias("p"), F.col("b").alias("q"))
        failed = wrong if failed is None else failed.unionByName(wrong)
        comp = components(links)
        common.release(spark)

    def pairs_of(left: DataFrame, right: DataFrame, apart) -> DataFrame:
        found = left.join(right, (F.col("vx") == F.col("vy")) & apart & _bounded(percent))
        return found.select(F.least("keyx", "keyy").alias("p"), F.greatest("keyx", "keyy").alias("q"))

    def led(df: DataFrame, turn: int, *more: str) -> DataFrame:
        one = df.groupBy("v").agg(F.min_by(F.struct("key", "n", "p", "before", *FOLDS, *more), F.xxhash64("key", F.lit(turn))).alias("l"))
        return one.select(F.col("v").alias("vx"), *[F.col(f"l.{c}").alias(f"{c}x") for c in ("key", "n", "p", "before", *FOLDS, *more)])

    # First block: the leaders of lists near the front.
    block = entries.filter(F.col("p") < FIRST)
    judged(pairs_of(led(block, 0), sided(block, "y"), F.col("keyx") != F.col("keyy")))
    for turn in range(1, LEADER_ROUNDS + 2):
        grouped = entries.join(comp.withColumnRenamed("id", "key"), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
        open_lists = grouped.groupBy("v").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("v")
        open_entries = common.stored(grouped.join(open_lists, "v"), "jaccard-open")
        del grouped, open_lists
        if open_entries.isEmpty():
            common.discard(open_entries)
            break
        many = open_entries.filter(F.col("m") > SMALL)
        n, promised = common.across(many, "v", "c")
        last = turn > LEADER_ROUNDS or turn > 1 and promised <= PAIRS_AN_ENTRY * n
        if turn == 1:  # what a leader of any list can settle needs no comparison all with all
            many, few = open_entries, None
        else:
            few = open_entries if last else open_entries.filter(F.col("m") <= SMALL)
        todo = None if few is None else pairs_of(sided(few, "x", "c"), sided(few, "y", "c"), F.col("cx") < F.col("cy"))
        if not last:
            one = pairs_of(led(many, turn, "c"), sided(many, "y", "c"), F.col("cx") != F.col("cy"))
            todo = one if todo is None else todo.unionByName(one)
        judged(todo)
        common.discard(open_entries)
        if last:
            break

    # The smallest doc_id of each component, over all its classes.
    ids = classes.select("key", "id").join(comp.withColumnRenamed("id", "key"), "key", "left").withColumn("c", F.coalesce("component", "key"))
    least = ids.groupBy("c").agg(F.min("id").alias("component_id"))
    named = common.cut(ids.join(least, "c").select("key", "component_id"))
    out = common.stored(members.select("id", "n", "key"), "jaccard-rows").join(named, "key", "left")
    for table in tables:
        common.discard(table)
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")).withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one with the smallest id; rows without an id stay. Rows alike in id and text count as one."""
    found = jaccard_components(docs, k, percent, id_col, text_col)
    keep = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__keep")).distinct()
    marked = docs.withColumn("__text", F.xxhash64(F.col(f"`{text_col}`")))
    kept = marked.filter(F.col(f"`{id_col}`").isNotNull()).join(keep, F.col(f"`{id_col}`") == F.col("__keep"), "left_semi").dropDuplicates([id_col, "__text"])
    return kept.unionByName(marked.filter(F.col(f"`{id_col}`").isNull())).drop("__text")
