"""Vector and scalar math as columns: dot product, normalisation, sigmoid, temporal overlap and IoU."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if a vector is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """v over its norm, which counts as ``floor`` at least."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-12)))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part of two intervals, negative if they are apart."""
    return F.least(a1, b1) - F.greatest(a0, b0)


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap, 0 at least, over the hull of both intervals; 0 if the hull has no length."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, F.greatest(F.lit(0.0), overlap(a0, a1, b0, b1)) / hull).otherwise(F.lit(0.0))


def half_up(x: Column | str, digits: int) -> Column:
    """``x``, doubles, rounded as SQL on doubles does it: x * 10^digits to the next whole number, halves away from 0, over 10^digits.

    What counts as a half is the product in double precision, not ``x`` in decimal digits, by which ``F.round`` goes:
    0.5239375 * 10^6 lies below 523937.5. NaN, infinities and numbers too large for a fraction stay as they are.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = x * F.lit(10.0**digits)
    near = F.rint(y)
    whole = F.when(F.abs(y - near) == 0.5, y + F.signum(y) * 0.5).otherwise(near)
    return F.when(F.abs(y) < 2.0**52, whole / F.lit(10.0**digits)).otherwise(x)


def prf(tp: Column, fp: Column, fn: Column, digits: int = 4) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined, rounded; F1 is of the unrounded two."""
    tp, fp, fn = (x.cast("double") for x in (tp, fp, fn))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    return half_up(p, digits), half_up(r, digits), half_up(f, digits)
