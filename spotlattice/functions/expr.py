"""Column expressions shared by the operators, with SQL texts of the same formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing value in text tables.
NULLS = ("", "NA", "nan")
# Coefficients of W. J. Cody's rational approximations of the error function
# (Mathematics of Computation 23, 1969), numerator and denominator of each of its three ranges.
_SMALL = (
    (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1),
    (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03),
)
_MIDDLE = (
    (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8),
    (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03),
)
_LARGE = (
    (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2),
    (2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c).isin(*NULLS), None).otherwise(F.trim(c))


def number(c: Column, kind: str = "double") -> Column:
    """Numeric value of a text; null where it is missing or not a number."""
    return blank_to_null(c).try_cast(kind)


def erfc(z: Column) -> Column:
    """Complementary error function of a column z >= 0, good to about 1e-15.

    Spark has no erf. About 45 uses of ``z``: pass a column, not a long expression,
    so that the projection stays within one generated method.
    """

    def ratio(y: Column, top: tuple, bottom: tuple) -> Column:
        a, b = top[-1] * y, y
        for t, u in zip(top[:-2], bottom[:-1]):
            a, b = (a + t) * y, (b + u) * y
        return (a + top[-2]) / (b + bottom[-1])

    small = 1.0 - z * ratio(z * z, *_SMALL)
    middle = F.exp(-z * z) * ratio(z, *_MIDDLE)
    y = 1.0 / (z * z)
    large = F.exp(-z * z) * (1 / math.sqrt(math.pi) - y * ratio(y, *_LARGE)) / z
    return F.when(z < 0.46875, small).when(z <= 4.0, middle).otherwise(large)


def erfc_sql(z: str) -> str:
    def ratio(y: str, top: tuple, bottom: tuple) -> str:
        a, b = f"{top[-1]!r}::DOUBLE * {y}", y
        for t, u in zip(top[:-2], bottom[:-1]):
            a, b = f"({a} + {t!r}::DOUBLE) * {y}", f"({b} + {u!r}::DOUBLE) * {y}"
        return f"({a} + {top[-2]!r}::DOUBLE) / ({b} + {bottom[-1]!r}::DOUBLE)"

    y = f"(1.0::DOUBLE / ({z} * {z}))"
    small = f"1.0::DOUBLE - {z} * ({ratio(f'({z} * {z})', *_SMALL)})"
    middle = f"exp(-{z} * {z}) * ({ratio(z, *_MIDDLE)})"
    large = f"exp(-{z} * {z}) * ({1 / math.sqrt(math.pi)!r}::DOUBLE - {y} * ({ratio(y, *_LARGE)})) / {z}"
    return f"(CASE WHEN {z} < 0.46875::DOUBLE THEN {small} WHEN {z} <= 4.0::DOUBLE THEN {middle} ELSE {large} END)"


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal; ``z`` is a column, not a long expression."""
    t = F.abs(z) / math.sqrt(2)
    return F.when(z >= 0, erfc(t) / 2).otherwise(1 - erfc(t) / 2)


def hash_number(text: Column) -> Column:
    """A whole number below 2^32 from a text, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_number_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def r6(c: Column) -> Column:
    return F.round(c, 6)


def r12(c: Column) -> Column:
    return F.round(c, 12)
