"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero, by scaling, as SQL engines and C round doubles: the sign of zero stays, where ``F.round`` goes by decimal digits and drops it."""
    def scaled(v: Column) -> Column:
        y = F.abs(v) * 10.0**digits
        whole = F.rint(y)
        away = F.signum(v) * (whole + F.when(y - whole == 0.5, 1.0).otherwise(0.0)) / 10.0**digits
        return F.when(y >= 2.0**53, v).otherwise(away)

    return F.transform(F.array(x), scaled)[0]


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Null where a vector is zero. Norms that are at hand need not be computed again."""
    return F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))


def normalized(v: Column | str) -> Column:
    """Length one; components of a zero vector become null. The length is a variable, as it would be computed for each component otherwise."""
    return F.transform(F.array(norm(v)), lambda length: F.transform(_doubles(v), lambda x: F.try_divide(x, length)))[0]
