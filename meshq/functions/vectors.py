"""Column expressions on vectors held as ARRAY<DOUBLE>, and their flat forms for few dimensions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative slack that keeps pruning lossless under rounding.
SLACK = 1e-12


def vector(values) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def as_double(col) -> Column:
    return F.col(col).cast("array<double>") if isinstance(col, str) else col.cast("array<double>")


def total(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda s, v: s + v)


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_checked(a: Column, b: Column) -> Column:
    """Vectors of unlike lengths raise an error."""
    return F.when(F.size(a) == F.size(b), l2(a, b)).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of unlike lengths")).cast("double")))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def flat_l2_squared(cols: list[Column], point) -> Column:
    return reduce(add, [(c - v) * (c - v) for c, v in zip(cols, point, strict=True)])


def box_distance_squared(p: Column, lo: Column, hi: Column) -> Column:
    """Squared distance from a point to an axis-aligned box, 0 inside."""
    below = F.zip_with(lo, p, lambda a, x: a - x)
    above = F.zip_with(p, hi, lambda x, b: x - b)
    return total(F.transform(F.zip_with(below, above, lambda a, b: F.greatest(a, b, F.lit(0.0))), lambda v: v * v))


def flat_box_distance_squared(cols: list[Column], lo, hi) -> Column:
    out = [F.greatest(a - c, c - b, F.lit(0.0)) for c, a, b in zip(cols, lo, hi, strict=True)]
    return reduce(add, [d * d for d in out])


def in_box(p: Column, lo: Column, hi: Column) -> Column:
    """Inclusive on all sides."""
    return F.forall(F.arrays_zip(p.alias("p"), lo.alias("l"), hi.alias("h")), lambda z: z["p"].between(z["l"], z["h"]))


def flat_in_box(cols: list[Column], lo, hi) -> Column:
    return reduce(lambda a, b: a & b, [c.between(a, b) for c, a, b in zip(cols, lo, hi, strict=True)])


def ratio(child: Column, parent: Column) -> Column:
    """Child coordinates over parent coordinates; null where the parent coordinate is near zero."""
    return F.zip_with(child, parent, lambda c, p: F.when(~is_zero(p), c / p))


def prolong(ratios: Column, parent: Column) -> Column:
    return F.zip_with(ratios, parent, lambda r, p: r * p)


def is_finite(v: Column) -> Column:
    """True if the vector is not null and holds finite numbers only."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def close(actual: Column, expected: Column, absolute=1e-6, relative=1e-6) -> Column:
    gap = F.abs(actual - expected)
    return (gap <= absolute) | (gap / F.greatest(F.lit(1.0), F.abs(expected)) <= relative)


def log_volume(lo: Column, hi: Column) -> Column:
    """Sum of the logarithms of the sides; minus infinity if a side is not positive."""
    sides = F.zip_with(hi, lo, lambda h, l: h - l)
    return F.when(F.exists(sides, lambda s: s <= 0), F.lit(float("-inf"))).otherwise(F.aggregate(sides, F.lit(0.0), lambda a, s: a + F.ln(s)))


def volume_label(log_v: Column) -> Column:
    """exp(log_v) as m.mmE+x, without overflow; 0, inf or nan where it is no number."""
    tens = log_v / F.lit(2.302585092994046)
    whole = F.floor(tens)
    number = F.format_string("%.2fE%+d", F.bround(F.pow(F.lit(10.0), tens - whole), 2), whole)
    special = F.when(F.isnan(log_v), "nan").when(log_v == float("inf"), "inf").when(log_v == float("-inf"), "0")
    return F.coalesce(special, F.when(F.abs(log_v) != float("inf"), number))


def near(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Whether two numbers, or two vectors in all components, differ by less than eps."""
    return F.abs(a - b) < eps


def near_vectors(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(near(x, y, eps), F.lit(False))), lambda v: v)


def is_zero(a: Column, eps: float = 1e-6) -> Column:
    return F.abs(a) < eps
