"""Sets of word shingles as 63-bit hashes."""

from __future__ import annotations

import numpy as np

from . import common

_FACTORS = common._RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and the n + 1 offsets of each text's. A text of 1 to k - 1 words has one."""
    low = common.LOWER[data]
    starts, ends, at = common.word_spans(low, offsets, common.NOT_SPACE)
    h = common.span_hashes(common.prefix_hashes(low), starts, ends)
    n_words = np.diff(at)
    docs = np.repeat(np.arange(len(n_words)), n_words)
    m = len(h)
    if m >= k:
        s = np.zeros(m - k + 1, np.uint64)
        for j in range(k):
            s += h[j : m - k + 1 + j] * _FACTORS[j]
        whole = docs[: m - k + 1] == docs[k - 1 :]
        s, d = common.mixed(s[whole]), docs[: m - k + 1][whole]
    else:
        s, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        one = np.array([common.mixed(np.array([(h[at[i] : at[i + 1]] * _FACTORS[: n_words[i]]).sum(dtype=np.uint64) + np.uint64(0xA5A5 + n_words[i])]))[0] for i in short], np.uint64)
        s, d = np.concatenate([s, one]), np.concatenate([d, short])
    s >>= np.uint64(1)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), np.bool_)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(len(n_words) + 1))
