"""SentencePiece encoding and decoding in batched numpy.

Texts are cut at the space mark into words (runs of marks and what follows), distinct words are sorted by length, and words
of equal length advance together, one character a step. All their substrings of up to the longest piece are hashed at
once and probed in the sorted hashes of the pieces. At each step every candidate piece that ends there is weighed for
every word, the best is taken by a vectorised maximum, and its length is stored as the backpointer.

What is weighed follows the model's kind. For a unigram model it is the sum of scores: Viterbi. For a BPE model sums of
scores do not give the library's pieces, since BPE takes merges by rank and not the best sum; there a candidate counts if it is
compatible with the last piece before it, that is if merging the two by rank gives the two again. A segmentation whose
neighbours are all compatible is the BPE one, so exactly one candidate counts at each step, and the same maximum finds it.
Compatible pairs are kept in a sorted table that grows as pairs turn up.

Characters without a piece become byte pieces where the model has them, else the unknown id.

Defined results: null and empty texts have no pieces and decode to an empty text; decoding restores a text but for the
space mark U+2581, which is a space afterwards, as the library has it (and NUL-free byte pieces that are no UTF-8 become U+FFFD);
repeated texts are rows of their own; an empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Words that a worker remembers twice over, characters of words that a batch advances at once, and bits of the table of pairs.
REMEMBERED = 1 << 18
AT_ONCE = 1 << 21
PAIR_BITS = 21
#: Bits of the filter before the sorted pieces are probed.
FILTER_BITS = 20
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_POINTS = common._RNG.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Pieces:
    """A model: its pieces, and the two directions."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.unknown = model.unk_id()
        self.bytes_at = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.own = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.bpe = _is_bpe(model)
        if any(MARK in p.lstrip(MARK) for p in self.own):
            raise ValueError("pieces go on after a space mark: words can't be encoded alone")
        self.longest = max(map(len, self.own))
        keys = np.array([self._hash(p) for p in self.own], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(self.own.values(), np.int64)[order]
        self._ready()
        self.text = [model.id_to_piece(i) for i in range(n)]
        by_byte = {i: b for b, i in self.bytes_at.items()}
        self.raw = [bytes([by_byte[i]]) if i in by_byte else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else self.text[i].replace(MARK, " ").encode() for i in range(n)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.borders: dict[tuple[int, bool], list[tuple[str, float]]] = {}

    def _ready(self) -> None:
        """Tables beside the sorted keys: a filter of their leading bits, and a direct-mapped memory of compatible pairs."""
        self.maybe = np.zeros(1 << FILTER_BITS, np.bool_)
        self.maybe[self.keys >> np.uint64(64 - FILTER_BITS)] = True
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)
        self.fit = np.zeros(1 << PAIR_BITS, np.bool_)

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where none has."""
        out = np.full(hashes.shape, -1, np.int64)
        ask = np.nonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)])
        h = hashes[ask]
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        out[ask] = np.where(self.keys[at] == h, self.ids[at], -1)
        return out

    @staticmethod
    def _points(words: list[str]) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)

    @staticmethod
    def _prefix(points: np.ndarray) -> np.ndarray:
        out = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        np.cumsum(common.mixed(points.astype(np.uint64) * _POINTS[0] + _POINTS[1]) * common._powers(common.BASE, points.shape[1])[None], axis=1, out=out[:, 1:])
        return out

    def _hash(self, piece: str) -> int:
        return int(common.mixed(self._prefix(self._points([piece]))[0, -1:])[0])

    def _compatible(self, before: int, piece: int) -> bool:
        """Merging both pieces' characters by rank leaves the two.

        Each piece has its own merges, and only what lies at the border can merge across it. Walking both borders up by
        rank, a merge across comes first if its score is higher (or as high, and more to the left).
        """
        left, right = self._border(before, True), self._border(piece, False)
        i = j = 0
        while True:
            across = self.own.get(left[i][0] + right[j][0])
            next_left, next_right = left[i][1], right[j][1]
            if across is not None and self.score[across] > next_left and self.score[across] >= next_right:
                return False
            if next_left == next_right == -np.inf:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _border(self, piece: int, at_end: bool) -> list[tuple[str, float]]:
        """The parts of a piece at its end (or start) as it is merged, each with the score of the merge that ends it."""
        held = self.borders.get((piece, at_end))
        if held is None:
            parts = list(self.text[piece])
            out, edge = [], -1 if at_end else 0
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    k = self.own.get(parts[i] + parts[i + 1])
                    if k is not None and (best is None or self.score[k] > best):
                        best, at = self.score[k], i
                if best is None:
                    break
                if at == (len(parts) - 2 if at_end else 0):
                    out.append((parts[edge], float(best)))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out.append((parts[edge], -np.inf))
            held = self.borders[piece, at_end] = out
        return held

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which candidates are compatible; -1 before is a word's start, under -1 is a character without a piece."""
        out = (before < 0) | (piece < 0)
        ask = np.flatnonzero(~out)
        pair = before[ask] << 20 | piece[ask]
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        hit = self.pairs[slot] == pair
        out[ask] = self.fit[slot] & hit
        miss = np.flatnonzero(~hit)
        if len(miss):
            new, back = np.unique(pair[miss], return_inverse=True)
            fit = np.array([self._compatible(int(p) >> 20, int(p) & 0xFFFFF) for p in new])
            out[ask[miss]] = fit[back]
            self.pairs[slot[miss]] = pair[miss]
            self.fit[slot[miss]] = self._of(self.pairs[slot[miss]], new, fit)
        return out

    @staticmethod
    def _of(pairs: np.ndarray, new: np.ndarray, fit: np.ndarray) -> np.ndarray:
        """What was just found for pairs; two that share a slot leave the later one there."""
        return fit[np.searchsorted(new, pairs)]

    def _equal_length(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length: a row of piece ids each (-2 - code point where a character has none), flush right, and how many."""
        points = self._points(words)
        n, size = points.shape
        prefix = self._prefix(points)
        inverse = common._powers(common.BASE_INVERSE, size + 1)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        last = np.full((n, size + 1), -1, np.int64)
        back = np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        for i in range(1, size + 1):
            lengths = np.arange(1, min(self.longest, i) + 1)
            piece = self._probe(common.mixed((prefix[:, i : i + 1] - prefix[:, i - lengths]) * inverse[i - lengths][None]))
            one = piece[:, 0] < 0
            piece[one, 0] = -2 - points[one, i - 1].astype(np.int64)  # a character alone is always a candidate
            value = np.full(piece.shape, -np.inf)
            w, c = np.nonzero(piece != -1)
            p, at = piece[w, c], i - 1 - c
            if self.bpe:
                ok = self._fits(last[w, at], p)
                value[w[ok], c[ok]] = c[ok]
            else:
                value[w, c] = best[w, at] + np.where(p >= 0, self.score[np.maximum(p, 0)], self.score.min() - 10)
            k = value.argmax(1)
            best[:, i], last[:, i], back[:, i] = value[rows, k], piece[rows, k], k + 1
        ids, at, used = np.zeros((n, size), np.int64), np.full(n, size), np.zeros(n, np.int64)
        while (go := np.flatnonzero(at > 0)).size:
            used[go] += 1
            ids[go, size - used[go]] = last[go, at[go]]
            at[go] -= back[go, at[go]]
        return ids, used

    def _learn(self, words: set[str]) -> None:
        """Encodes words and remembers them as little-endian 32-bit ids."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, same in sorted(by_size.items()):
            step = max(1, AT_ONCE // size // self.longest)
            for at in range(0, len(same), step):
                part = same[at : at + step]
                ids, used = self._equal_length(part)
                small, width, total = ids.astype("<i4").tobytes(), 4 * size, 0
                for w, n in zip(part, used.tolist(), strict=True):
                    total += width
                    self.known[w] = small[total - 4 * n : total]
                for r in np.flatnonzero((ids < -1).any(1)).tolist():
                    self.known[part[r]] = self._spelled(ids[r, size - used[r] :].tolist())

    def _spelled(self, ids: list[int]) -> bytes:
        """Ids with characters that have no piece as byte pieces, or as the unknown id once a run."""
        flat: list[int] = []
        for k in ids:
            if k >= 0:
                flat.append(k)
            elif self.bytes_at:
                flat += [self.bytes_at[b] for b in chr(-2 - k).encode("utf-8", "surrogatepass")]
            elif not flat or flat[-1] != self.unknown:
                flat.append(self.unknown)
        return np.array(flat, "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without begin and end."""
        if len(self.known) > REMEMBERED:  # words that come up again are taken over, the rest is forgotten
            self.known, self.older = {}, self.known
        split = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known, older = self.known, self.older
        new = {w for words in split for w in words if w not in known}
        for w in [w for w in new if w in older]:
            known[w] = older[w]
            new.discard(w)
        if new:
            self._learn(new)
        return [np.frombuffer(b"".join([known[w] for w in words]), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts first is taken off."""
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def _is_bpe(model) -> bool:
    """Field 3 of the trainer spec (field 2 of the model file) is the kind; 2 is BPE."""

    def varint(raw: bytes, at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 128:
                return value, at

    def fields(raw: bytes):
        at = 0
        while at < len(raw):
            tag, at = varint(raw, at)
            if tag & 7 == 0:
                value, at = varint(raw, at)
            elif tag & 7 == 2:
                size, at = varint(raw, at)
                value, at = raw[at : at + size], at + size
            else:
                size = 8 if tag & 7 == 1 else 4
                value, at = raw[at : at + size], at + size
            yield tag >> 3, value

    spec = next((v for k, v in fields(model.serialized_model_proto()) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1) == 2


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def _run(path: str, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = model.encode(texts)
                back = [model.decode(ids) == text.replace(MARK, " ") for ids, text in zip(found, texts, strict=True)]
                digests = [hashlib.sha256(ids.tobytes()).hexdigest() for ids in found]
                cols = [part.column(0), pa.array([len(i) for i in found], pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.bool_())]
                names = ["id", "n_tokens", "ids_sha256", "round_trip"]
                if ids_too:
                    ends = np.concatenate([[0], np.cumsum([len(i) for i in found])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_texts(docs: DataFrame, model: str, ids_too: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, SHA-256 of the ids as little-endian 32-bit numbers, whether decoding restores the text, and the ids."""
    rows = common.columns(docs, id=id_col, text=text_col).select(F.col("id").cast("long"), "text")
    schema = "id long, n_tokens long, ids_sha256 string, round_trip boolean" + (", ids array<int>" if ids_too else "")
    return rows.mapInArrow(_run(model, ids_too), schema).withColumnRenamed("id", id_col)
