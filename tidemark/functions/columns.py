"""Scalar column builders. NULL is the only missing value; non-finite results become NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def masked(x: Column, eligible: Column) -> Column:
    """A field or constant where the row is eligible, else NULL."""
    return F.when(eligible, x)


def add(a: Column, b: Column) -> Column:
    return finite(a + b)


def subtract(a: Column, b: Column) -> Column:
    return finite(a - b)


def multiply(a: Column, b: Column) -> Column:
    return finite(a * b)


def divide(a: Column, b: Column) -> Column:
    """a / b; a zero divisor gives NULL."""
    return finite(F.try_divide(a, b))


def quotient(a: Column, b: Column) -> Column:
    """a / b in IEEE arithmetic, for results that are held against SQL: a zero divisor gives an infinity, or NaN under zero."""
    return F.coalesce(F.try_divide(a, b), a * F.pow(b, F.lit(-1.0)))


def rounded(x: Column, places: int) -> Column:
    """x to so many places by scaling, as DuckDB rounds; ``F.round`` rounds the decimal text, which differs by a last place near halves."""
    scale = F.lit(10.0**places)
    return F.round(x * scale) / scale


def _all_known(xs: tuple[Column, ...]) -> Column:
    return reduce(lambda p, q: p & q, [x.isNotNull() for x in xs])


def smallest(*xs: Column) -> Column:
    """Minimum of at least two operands; a missing operand makes it missing."""
    return F.when(_all_known(xs), F.least(*xs))


def largest(*xs: Column) -> Column:
    """Maximum of at least two operands; a missing operand makes it missing."""
    return F.when(_all_known(xs), F.greatest(*xs))


def winsorize(x: Column, limit: float) -> Column:
    """x clipped to [-limit, limit]."""
    if not limit > 0:
        raise ValueError("the limit must be positive")
    return F.when(x.isNotNull(), F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), x)))


def residual_return(stock: Column, sector: Column, beta: Column, market: Column) -> Column:
    return finite(stock - sector - beta * market)


def simple_return(now: Column, before: Column) -> Column:
    """now / before - 1 where the earlier price is positive."""
    return F.when(before > 0, F.try_divide(now, before) - 1)


def event_score(polarity: Column, magnitude: Column) -> Column:
    """polarity in [-1, 1] times magnitude in [0, 1]; out of range is NULL."""
    return F.when(polarity.between(-1, 1) & magnitude.between(0, 1), polarity * magnitude)


def row_hash(*columns: Column | str) -> Column:
    """SHA-256 of the row's JSON, fields in the given order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def age_days(day: Column, observed: Column) -> Column:
    return F.datediff(day, observed)


def decay(age: Column, half_life_days: float | None) -> Column:
    """2 ** (-age / half life); 1 without a half life."""
    return F.lit(1.0) if half_life_days is None else F.pow(F.lit(2.0), -age / float(half_life_days))


def just_before(day: Column) -> Column:
    """The last microsecond before a day begins."""
    return day.cast("timestamp") - F.expr("INTERVAL '0.000001' SECOND")


def softmax(scores: Column) -> Column:
    """Softmax of an array of doubles."""
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: F.try_divide(x, F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)))


def normal_json(text: Column, schema: str) -> Column:
    """JSON text in one canonical spelling: the given fields, in the schema's order."""
    return F.to_json(F.from_json(text, schema))
