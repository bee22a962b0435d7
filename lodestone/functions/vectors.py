"""Functions of ``array<float>`` columns; arithmetic is in double precision."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """Unit length; a zero vector stays zero. The norm is bound by an outer lambda, else it would be worked out for each element."""
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(eps))), lambda n: F.transform(doubles(v), lambda x: x / n)), 1)


def scaled(v: Column, w: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * w)


def combine(*parts: tuple[Column | float, Column]) -> Column:
    """The weighted sum of vectors of one dimension."""
    out = None
    for w, v in parts:
        term = scaled(v, w if isinstance(w, Column) else F.lit(w))
        out = term if out is None else F.zip_with(out, term, lambda x, y: x + y)
    return out


def is_finite(v: Column) -> Column:
    return ~F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def unit_norm_report(df: DataFrame, column: str = "embedding", tol: float = 1e-4) -> DataFrame:
    """One row: the greatest and the mean deviation of norms from 1, and how many are over ``tol``."""
    off = F.abs(norm(F.col(column)) - 1)
    return df.agg(F.max(off).alias("max_off"), F.avg(off).alias("mean_off"), F.count_if(off > tol).alias("n_off"))


def aligned(df: DataFrame, dim: int, renorm: bool = True, check_unit_norm: bool = False, tol: float = 1e-4, column: str = "embedding") -> DataFrame:
    """The rows with vectors in float; raises on another dimension or a value that isn't finite. Vectors are made unit length with ``renorm``; else, if
    asked for, norms that are off by more than ``tol`` are reported by a warning."""
    if check_unit_norm and not renorm:
        r = unit_norm_report(df, column, tol).first()
        if r.n_off:
            warnings.warn(f"{r.n_off} vectors are not of unit length: off by {r.max_off:.3g} at most, {r.mean_off:.3g} on average", stacklevel=2)
    return df.withColumn(column, checked(F.col(column), dim, renorm))


def checked(v: Column, dim: int, renorm: bool = True) -> Column:
    """The vector in float, of unit length if ``renorm``; raises on another dimension or a value that isn't finite."""
    ok = (F.size(v) == dim) & is_finite(v)
    out = l2_normalize(v) if renorm else doubles(v)
    return F.when(ok, out.cast("array<float>")).otherwise(F.raise_error(F.lit(f"a vector is not of {dim} finite numbers")).cast("array<float>"))
