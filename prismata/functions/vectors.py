"""Column functions over arrays of numbers; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(inner_product(v, v))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is zero."""
    return F.lit(1.0) - F.try_divide(inner_product(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector as it is."""
    size = norm(v)
    return F.when(size > 0, F.transform(doubles(v), lambda x: x / size)).otherwise(doubles(v))


def concat_normalised(a: Column, b: Column) -> Column:
    return normalise(F.concat(normalise(a), normalise(b)))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    raised = F.transform(doubles(v), lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / _sum(raised))


def expected_angle(logits: Column, width: float = 3.0, offset: float = 180.0) -> Column:
    """Mean bin of softmaxed logits, in degrees."""
    p = softmax(logits)
    return _sum(F.zip_with(p, F.sequence(F.lit(0), F.size(p) - 1), lambda x, i: x * i)) * width - offset


def template_match(a: Column, b: Column) -> Column:
    """1 - normalised squared difference of two signatures."""
    return F.lit(1.0) - F.try_divide(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))), F.sqrt(inner_product(a, a) * inner_product(b, b)))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normalised_distribution(m: Column, digits: int = 2) -> Column:
    """A map's values as rounded shares."""
    total = _sum(F.map_values(m))
    return F.transform_values(m, lambda _, p: F.round(p / total, digits))


def top_category(m: Column) -> Column:
    """The key of a map's largest value, the first one on ties."""
    entries = F.transform(F.map_entries(m), lambda e, i: F.struct(e["value"].alias("p"), (-i).alias("pos"), e["key"].alias("k")))
    return F.array_max(entries)["k"]


def set_scores(a: Column, b: Column) -> Column:
    """Intersection over union, over the first and over the second set."""
    both = F.size(F.array_intersect(a, b))
    return F.struct((both / F.size(F.array_union(a, b))).alias("iou"), (both / F.size(F.array_distinct(a))).alias("iop"), (both / F.size(F.array_distinct(b))).alias("iog"))


def box_iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Of two boxes (x, y, w, h), pixels at the edges counted in."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    side = lambda lo1, w1, lo2, w2: F.greatest(F.lit(0), F.least(lo1 + w1, lo2 + w2) - F.greatest(lo1, lo2) + 1)
    both = side(ax, aw, bx, bw) * side(ay, ah, by, bh)
    return both / ((aw + 1) * (ah + 1) + (bw + 1) * (bh + 1) - both)
