"""Column expressions shared by the operators. Those on arrays (dot, norm, cosines) are interpreted lambdas; the others stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """Nearest multiple of 10^-digits, halves away from zero, as a double that is never -0.0.

    Values too large to have a fraction at that scale stay as they are.
    """
    c, scale = F.col(c) if isinstance(c, str) else c, F.lit(float(10**digits))
    big = F.abs(c) * scale
    near = F.signum(c) * F.floor(big + F.lit(0.5)).cast("double") / scale + F.lit(0.0)
    return F.when(big < F.lit(4.5e15), near).otherwise(c)


def finite(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def octant(x: Column, y: Column) -> Column:
    """Which eighth of the circle the angle of (x, y) lies in, from -pi on; lower edges belong to an octant, pi to the first.

    Comparisons instead of atan2: no rounding at the diagonals. The zero vector counts as angle 0.
    """
    zero = F.lit(0.0)
    return (
        F.when(y < zero, F.when(x < y, 0).when(x < zero, 1).when(x < -y, 2).otherwise(3))
        .when(y == zero, F.when(x < zero, 0).otherwise(4))
        .otherwise(F.when(x > zero, F.when(y < x, 4).otherwise(5)).when(-x < y, 6).otherwise(7))
    ).cast("int")


def octant_atan2(x: Column, y: Column) -> Column:
    """The same from the angle itself, as floating point has it."""
    return F.pmod(F.floor((F.atan2(y, x) + F.lit(math.pi)) / F.lit(2 * math.pi) * F.lit(8.0)), F.lit(8)).cast("int")


def bin_of(value: Column, cuts: Sequence[Column]) -> Column:
    """How many of the ascending cuts are not above the value."""
    return reduce(lambda a, b: a + b, [(value >= c).cast("int") for c in cuts])


def fixed_bins(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of equal width, the value clipped to the range; the last bin includes its upper edge."""
    width = (high - low) / bins
    clipped = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.least(F.lit(bins - 1), F.floor((clipped - F.lit(low)) / F.lit(width)).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where the product of the norms is at most 1e-12."""
    scale = norm(a) * norm(b)
    return F.when(scale <= F.lit(1e-12), F.lit(0.0)).otherwise(dot(a, b) / scale)


def cosine_clipped(a: Column, b: Column) -> Column:
    """Cosine whose denominator is at least 1e-12."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def contains_any(text: Column, hints: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in hints], F.lit(False))


def first_match(text: Column, names: Sequence[tuple[str, str]], otherwise: Column) -> Column:
    """The name of the first hint that the text contains."""
    out = None
    for hint, name in names:
        cond = F.contains(text, F.lit(hint))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return otherwise if out is None else out.otherwise(otherwise)


def slug(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit("/"), F.lit("__")), F.lit("-"), F.lit("_"))
