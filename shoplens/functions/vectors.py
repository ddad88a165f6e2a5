"""Vector math as Column expressions on array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """dot / (|a| |b|); 0 when either norm is 0; NULL when a vector is NULL.

    One pass over the zipped pair accumulates (a·b, |a|², |b|²).
    """
    acc0 = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    pairs = F.arrays_zip(_c(a).alias("x"), _c(b).alias("y"))
    return F.aggregate(
        pairs, acc0,
        lambda s, p: F.struct((s["d"] + p["x"] * p["y"]).alias("d"), (s["a"] + p["x"] * p["x"]).alias("a"),
                              (s["b"] + p["y"] * p["y"]).alias("b")),
        lambda s: F.when((s["a"] == 0) | (s["b"] == 0), F.lit(0.0))
        .otherwise(s["d"] / (F.sqrt(s["a"]) * F.sqrt(s["b"]))))


def scale(a, s) -> Column:
    return F.transform(_c(a), lambda x: x * _c(s))


def normalize(a) -> Column:
    """a / |a|; a zero vector is returned unchanged.

    The norm is accumulated once per row and handed to the finish lambda, so
    the cost stays O(d) even when ``a`` is itself a vector expression.
    """
    col = _c(a)
    return F.aggregate(col, F.lit(0.0), lambda s, x: s + x * x,
                       lambda s: F.when(s > 0, F.transform(col, lambda x: x / F.sqrt(s))).otherwise(col))


def weighted_sum(a, wa, b, wb) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * F.lit(wa) + y * F.lit(wb))


def concat_vectors(a, b) -> Column:
    return F.concat(_c(a), _c(b))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
