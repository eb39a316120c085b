"""Element-wise and reducing functions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_Number = Column | float


def _lit(x: _Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _paired(a: Column, b: Column, f) -> Column:
    """zip_with of arrays of one length; other lengths raise an error."""
    same = F.size(a) == F.size(b)
    a = F.when(same, doubles(a)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
    return F.zip_with(a, doubles(b), f)


def total(v: Column) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(_paired(a, b, lambda x, y: x * y))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(total(_paired(a, b, lambda x, y: (x - y) * (x - y))))


def element_min(v: Column, c: _Number) -> Column:
    return F.transform(doubles(v), lambda x: F.least(x, _lit(c)))


def element_max(v: Column, c: _Number) -> Column:
    return F.transform(doubles(v), lambda x: F.greatest(x, _lit(c)))


def element_add(v: Column, c: _Number) -> Column:
    return F.transform(doubles(v), lambda x: x + _lit(c))


def element_multiply(v: Column, c: _Number) -> Column:
    return F.transform(doubles(v), lambda x: x * _lit(c))


def vector_min(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: F.least(x, y))


def vector_max(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: F.greatest(x, y))


def vector_add(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x + y)


def vector_multiply(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def vector_square(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * x)


def vector_sqrt(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: F.sqrt(x))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def variance(v: Column) -> Column:
    """Population variance."""
    m = mean(v)
    return total(F.transform(doubles(v), lambda x: (x - m) * (x - m))) / F.size(v)


def _weight_sum(w: Column) -> Column:
    return F.when(total(w) > 0, total(w)).otherwise(F.raise_error(F.lit("weights must have a positive sum")).cast("double"))


def weighted_mean(v: Column, w: Column) -> Column:
    return dot(v, w) / _weight_sum(w)


def weighted_variance(v: Column, w: Column) -> Column:
    m = weighted_mean(v, w)
    return total(_paired(v, w, lambda x, y: y * (x - m) * (x - m))) / _weight_sum(w)


def condensed_index(i: Column, j: Column) -> Column:
    """Place of (i, j) in a lower triangle that includes the diagonal."""
    high, low = F.greatest(i, j), F.least(i, j)
    return F.expr("0") + (high * (high + 1) / 2).cast("long") + low


def register_sql(spark) -> None:
    """Names the reducing functions as SQL functions over array<double>."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vec_euclid(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))")
