"""Models behind one protocol: a class with `predict(batch)`, found by name, run as pandas UDFs or table functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Represents(Protocol):
    """A model that turns contents into vectors."""

    dim: int

    def represent(self, contents: list) -> np.ndarray: ...


class Hashing:
    """A deterministic stand-in: signed hashing of a text's words, at length 1."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def represent(self, contents: list) -> np.ndarray:
        out = np.zeros((len(contents), self.dim))
        for i, text in enumerate(contents):
            for word in (text or "").split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


MODELS: dict[str, Callable[[], Represents]] = {"hashing": Hashing}


def get_model(name: str) -> Callable[[], Represents]:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(MODELS)}")
    return MODELS[name]


def represent(content: Column, model: str) -> Column:
    """Vectors of a column; the model is made once a task and fed Arrow batches."""
    make = get_model(model)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = make()
        for contents in batches:
            yield pd.Series(list(loaded.represent(contents.tolist())))

    return run(content)


def detect(df: DataFrame, id_col: str, content: str, detector: Callable[[], Callable[[object], list[dict]]], schema: str) -> DataFrame:
    """A row for each detection: id, place, and the detector's fields; contents that fail give none."""
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = detector()
        for pdf in batches:
            rows = [(i, k, *[d[n] for n in names]) for i, c in zip(pdf["id"], pdf["content"], strict=True) if c is not None for k, d in enumerate(find(c))]
            yield pd.DataFrame(rows, columns=["id", "place", *names])

    return df.select(F.col(id_col).alias("id"), F.col(content).alias("content")).mapInPandas(run, f"id long, place long, {schema}")


# -- picture primitives on grey arrays ----------------------------------------------------------------------------


def blur_score(grey: np.ndarray) -> float:
    """Variance of the Laplacian."""
    g = grey.astype(float)
    lap = -4 * g[1:-1, 1:-1] + g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:]
    return float(lap.var()) if lap.size else 0.0


def emptiness(grey: np.ndarray, edge: float = 25) -> float:
    """Share of pixels without an edge, by gradient."""
    g = grey.astype(float)
    gy, gx = np.gradient(g) if min(g.shape) > 1 else (np.zeros_like(g), np.zeros_like(g))
    return float((np.hypot(gx, gy) < edge).mean())


def center_crop(img: np.ndarray, margin: float) -> np.ndarray:
    h, w = img.shape[:2]
    dy, dx = int(h * margin), int(w * margin)
    return img[dy : h - dy, dx : w - dx]


def padded_crop(img: np.ndarray, box: tuple[int, int, int, int], margin: float = 1.0, padding: float = 0.5) -> np.ndarray:
    """A square around a box's centre on the picture padded by its own share."""
    x, y, w, h = box
    r = int((1 + margin) * max(h, w) / 2)
    ph, pw = int(img.shape[0] * padding), int(img.shape[1] * padding)
    pad = np.pad(img, [(ph, ph), (pw, pw)] + [(0, 0)] * (img.ndim - 2))
    cy, cx = y + h // 2 + ph, x + w // 2 + pw
    return pad[max(0, cy - r) : cy + r, max(0, cx - r) : cx + r]
