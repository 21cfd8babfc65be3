"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of `window` consecutive words of every test item (an item of fewer words, but not none, is one window) are the
automaton's keys. Each document is normalised to its words joined by single spaces, scanned once, and hits are mapped back
to word numbers and to byte spans of the original text.

Defined results: a null or empty text has no words and no hits; an item without words has no window; repeated items give
the same windows, and each of them is reported; empty tables give empty results or results without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: UTF-8 bytes of test items that one automaton may hold; more items are dealt to several automata, each broadcast alone.
AUTOMATON_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>, items array<string>"
_TABLE = bytes(x if common.ALNUM[x] else 32 for x in common.LOWER.tolist())


def words(text: str | bytes | None) -> list[bytes]:
    """Lower-cased words as UTF-8 bytes."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


def windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[bytes, list[str]]:
    """Window (its words, joined by spaces, a space at each end) to the ids of items that hold it."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", set()).add(item)
    return {k: sorted(v) for k, v in found.items()}


class Scanner:
    """The automaton and what its keys stand for."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for key, ids in windows(items, window).items():
            self.automaton.add_word(key.decode("latin-1"), (len(key), key.count(b" ") - 1, ids))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, a flag for each word, and the items that occur."""
        flat = b" " + b" ".join(raw.translate(_TABLE).split()) + b" "
        n = flat.count(b" ") - 1 if len(flat) > 2 else 0
        hit, items = np.zeros(n, np.bool_), set()
        found = [(end, size, k, ids) for end, (size, k, ids) in self.automaton.iter(flat.decode("latin-1"))] if self.any and n else []
        if found:
            spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
            for end, size, k, ids in found:
                at = int(np.searchsorted(spaces, end - size + 1))
                hit[at : at + k] = True
                items.update(ids)
        return n, hit, items


def _spans(raw: bytes, hit: np.ndarray) -> list[dict]:
    """Byte spans in the original text of maximal runs of hit words."""
    if not hit.any():
        return []
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = common.word_spans(common.LOWER[data], np.array([0, len(data)]), common.ALNUM)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scan(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(part.value, window) for part in shared]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    n, hit, items = scanners[0].scan(raw)
                    for more in scanners[1:]:
                        _, h, i = more.scan(raw)
                        hit, items = hit | h, items | i
                    ids = sorted(items)
                    out.append((doc, n, int(hit.sum()), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit.any()), _spans(raw, hit), ids))
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _dealt(docs: DataFrame, benchmark: DataFrame) -> list:
    """Broadcast test items: one lot, or lots of at most AUTOMATON_BYTES.

    Test items are a reference table that does not grow with the corpus; its size is summed before it is sent, and above
    AUTOMATON_BYTES it is dealt to automata of about that size, which are sent one by one.
    """
    context = docs.sparkSession.sparkContext
    items = common.columns(benchmark, item="item_id", text="text").filter(F.col("item").isNotNull()).select(F.col("item").cast("string"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // AUTOMATON_BYTES))
    return [context.broadcast([tuple(r) for r in (items if parts == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)).collect()]) for k in range(parts)]


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hits of every document: counts, digest of the item ids, spans in the original bytes, the ids."""
    rows = common.columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    return rows.mapInArrow(_scan(_dealt(docs, benchmark), window), SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows without any hit, with all their columns."""
    shared, at = _dealt(docs, benchmark), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners = [Scanner(part.value, window) for part in shared]
        for batch in batches:
            clean = [not (t.is_valid and any(s.scan(t.as_buffer().to_pybytes())[1].any() for s in scanners)) for t in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
