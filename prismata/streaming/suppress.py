"""Keyed state over streams: suppression of near-copies, the online similarity index, windows with late data."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def last_emitted(values: np.ndarray, state: float | None, differs: Callable[[float, float], bool]) -> tuple[np.ndarray, float | None]:
    """Which values are emitted: those unlike the last one emitted; state changes only then."""
    keep = np.zeros(len(values), np.bool_)
    for i, v in enumerate(values):
        if state is None or differs(float(v), state):
            keep[i], state = True, float(v)
    return keep, state


def _passing(pdf: pd.DataFrame, empty: float | None, blur: float | None) -> pd.DataFrame:
    if empty is not None:
        pdf = pdf[pdf["empty"] <= empty]
    if blur is not None:
        pdf = pdf[pdf["blur"] >= blur]
    return pdf


def suppress_batch(df: DataFrame, key: str, order: list[str], value: str, tolerance: float, empty: float | None = None, blur: float | None = None) -> DataFrame:
    """Rows that differ by more than `tolerance` from the last row of their key that was emitted.

    The rule is sequential within a key. A key's rows come sorted through the shuffle in Arrow batches and only the last
    emitted value is held, so a hot key costs time in one task but no memory.
    """
    columns = df.columns
    at = columns.index(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for pdf in batches:
            parts = []
            for k, part in pdf.groupby(columns[at], sort=False, dropna=False):
                if k != current:
                    current, state = k, None
                part = _passing(part, empty, blur)
                keep, state = last_emitted(part[value].to_numpy(), state, lambda a, b: abs(a - b) > tolerance)
                parts.append(part[keep])
            if parts:
                yield pd.concat(parts)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, df.schema)


def suppress_stream(df: DataFrame, key: str, order: str, value: str, tolerance: float) -> DataFrame:
    """The same over a stream; order holds within a micro-batch and between them."""
    names = df.columns

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        keep, last = last_emitted(pdf[value].to_numpy(), last, lambda a, b: abs(a - b) > tolerance)
        if last is not None:
            state.update((last,))
        yield pdf[keep][names]

    return df.groupBy(key).applyInPandasWithState(run, df.schema, "last double", "append", GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window; rows later than `late` are dropped."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def dedup_stream(df: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over what is there now into a table of the checkpoint folder, and reads it."""
    out = f"{checkpoint}/{name}"
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


class SimilarityIndex:
    """An online tree that labels vectors one by one.

    Nodes hold the mean of the vectors below them. A search steps to the nearest child until it meets an end node, whose
    leaves share a label. A vector within the threshold joins it; any other starts an end node, beside the found one, or in
    a new node together with it when it is nearer than the found one's own nearest sibling that is not identical.
    """

    def __init__(self, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float):
        self.distance, self.threshold = distance, threshold
        self.value: list[np.ndarray] = []
        self.count: list[int] = []
        self.parent: list[int] = []
        self.children: list[list[int]] = []
        self.label: list[int | None] = []
        self.end: list[bool] = []
        self.root: int | None = None
        self.labels = 0

    def _node(self, value: np.ndarray, label: int | None, end: bool, count: int = 0) -> int:
        self.value.append(np.array(value, float))
        self.count.append(count)
        self.parent.append(-1)
        self.children.append([])
        self.label.append(label)
        self.end.append(end)
        return len(self.value) - 1

    def _attach(self, node: int, parent: int) -> None:
        old = self.parent[node]
        if old >= 0:
            self.children[old].remove(node)
        self.parent[node] = parent
        self.children[parent].append(node)

    def search(self, query: np.ndarray) -> tuple[int | None, float]:
        """The end node that the descent meets, and its distance."""
        if self.root is None:
            return None, float("inf")
        at, dist = self.root, float("inf")
        while not self.end[at]:
            kids = self.children[at]
            d = self.distance(query, np.stack([self.value[k] for k in kids]))
            best = int(np.argmin(d))
            at, dist = kids[best], float(d[best])
        return at, dist

    def add(self, query: np.ndarray) -> int:
        """Inserts a vector and returns its label."""
        query = np.asarray(query, float)
        found, dist = self.search(query)
        if found is not None and dist <= self.threshold:
            end = found
        else:
            end = self._node(query, self.labels, True)
            self.labels += 1
            if found is None:
                self.root = self._node(query, None, False)
                self._attach(end, self.root)
            else:
                above = self.parent[found]
                if dist < self._sibling_distance(found):
                    pair = self._node(query, None, False)
                    self._attach(end, pair)
                    self._attach(pair, above)
                    self._attach(found, pair)
                    self._refresh(pair)
                else:
                    self._attach(end, above)
        leaves = self.count[end]
        self.value[end] = (self.value[end] * leaves + query) / (leaves + 1)
        self.count[end] = leaves + 1
        at = self.parent[end]
        while at >= 0:
            self._refresh(at)
            at = self.parent[at]
        return self.label[end]

    def _sibling_distance(self, node: int) -> float:
        """To the nearest sibling of another value: 0 without siblings, infinite if all are alike."""
        others = [k for k in self.children[self.parent[node]] if k != node]
        if not others:
            return 0.0
        d = self.distance(self.value[node], np.stack([self.value[k] for k in others]))
        d = d[d > 0]
        return float(d.min()) if len(d) else float("inf")

    def _refresh(self, node: int) -> None:
        kids = self.children[node]
        n = sum(self.count[k] for k in kids)
        self.count[node] = n
        if n:
            self.value[node] = sum(self.value[k] * self.count[k] for k in kids) / n
        labels = {self.label[k] for k in kids}
        self.label[node] = labels.pop() if len(labels) == 1 else None

    def depths(self) -> dict[int, int]:
        """Depth of each label's end node."""
        out = {}
        for i, end in enumerate(self.end):
            if end:
                d, at = 0, i
                while self.parent[at] >= 0:
                    d, at = d + 1, self.parent[at]
                out[self.label[i]] = d
        return out

    def dump(self) -> str:
        return json.dumps({"value": [v.tolist() for v in self.value], "count": self.count, "parent": self.parent, "children": self.children, "label": self.label, "end": self.end, "root": self.root, "labels": self.labels})

    def load(self, text: str) -> SimilarityIndex:
        d = json.loads(text)
        self.value = [np.array(v) for v in d["value"]]
        for k in ("count", "parent", "children", "label", "end", "root", "labels"):
            setattr(self, k, d[k])
        return self


def cosine_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - b @ a / np.maximum(np.linalg.norm(a) * np.linalg.norm(b, axis=1), 1e-300)


def euclidean_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((b - a) ** 2).sum(1))


METRICS = {"cosine": cosine_many, "euclidean": euclidean_many}


def online_labels(df: DataFrame, shard: str, threshold: float = 0.5, metric: str = "cosine") -> DataFrame:
    """(id, shard, label): an index for each shard, fed in id order; the result depends on the sharding."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        index = SimilarityIndex(METRICS[metric], threshold)
        return pd.DataFrame({"id": pdf["id"], "shard": pdf["shard"], "label": [index.add(v) for v in pdf["vec"]]})

    return df.select("id", F.col(shard).cast("long").alias("shard"), F.col("vec").cast("array<double>").alias("vec")).groupBy("shard").applyInPandas(run, "id long, shard long, label long")


def online_stream(df: DataFrame, threshold: float = 0.5, metric: str = "cosine") -> DataFrame:
    """The same over a stream (id, shard, vec); the index is the key's state."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        index = SimilarityIndex(METRICS[metric], threshold)
        if state.exists:
            index.load(state.get[0])
        pdf = pd.concat(list(frames)).sort_values("id")
        out = pd.DataFrame({"id": pdf["id"], "shard": key[0], "label": [index.add(v) for v in pdf["vec"]]})
        state.update((index.dump(),))
        yield out

    return df.groupBy("shard").applyInPandasWithState(run, "id long, shard long, label long", "tree string", "append", GroupStateTimeout.NoTimeout)
