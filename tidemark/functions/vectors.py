"""Column functions on vectors and boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: named in another lambda it would be computed again for each number of a vector."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Of length 1; vectors near zero stay as they are."""
    scaled = lambda x, n: F.when(n > 1e-12, F.transform(x, lambda y: y.cast("double") / n)).otherwise(F.transform(x, lambda y: y.cast("double")))
    return bound(v, lambda x: bound(norm(x), lambda n: scaled(x, n)))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def quantize(v: Column) -> Column:
    """(scale, qv): 8-bit numbers, half to even; a zero vector has scale 1."""
    whole = lambda x, scale: F.transform(x, lambda y: F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.rint(y.cast("double") / scale))).cast("tinyint"))
    most = lambda x: F.array_max(F.transform(x, lambda y: F.abs(y.cast("double"))))
    scale = lambda x: bound(most(x), lambda m: F.when(m > 0, m / 127).otherwise(1.0))
    return bound(v, lambda x: bound(scale(x), lambda k: F.struct(k.alias("scale"), whole(x, k).alias("qv"))))


def dequantize(scale: Column, qv: Column) -> Column:
    return F.transform(qv, lambda x: x * scale)


def truncate(v: Column, size: int) -> Column:
    """The first size numbers, of length 1."""
    return l2_normalize(F.slice(v, 1, size))


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def area(b: Column) -> Column:
    """Area of a box (x1, y1, x2, y2)."""
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(0.0)


def min_max(value: Column, lowest: Column, highest: Column) -> Column:
    """Blend scale of scores: a range of 0 counts as 1, so a single hit gets 0."""
    return (value - lowest) / F.when(highest == lowest, 1.0).otherwise(highest - lowest)
