"""Rounding, stretching and scoring as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_away(x: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def stretch(v: Column, lo: Column, hi: Column) -> Column:
    """Values between two percentiles to 0..1, clipped."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo + 1e-9)))


def natural_key(name: str) -> Column:
    """Parts of a name, to sort by: what isn't digits as it is, runs of digits by their number, whatever its length."""
    stripped = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    number = lambda p: F.concat(F.lpad(F.length(stripped(p)).cast("string"), 9, "0"), stripped(p))
    return F.transform(F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def percent_change(new: Column, old: Column) -> Column:
    """100 (new - old) / old; null where old is 0."""
    return F.try_divide(100 * (new - old), old)
