"""Sums of fractions that come out the same however the rows are spread.

Adding doubles rounds at every step, so the same rows give other last digits in another order. Here every value is taken
to nine decimals once and added as a decimal, which rounds nothing: equal groups have equal sums, near ones their true
order, in every run and on every layout. Sums have 38 digits; more is an error and never a wrong number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

PLACES = 9
VALUE = DecimalType(28, PLACES)
TOTAL = DecimalType(38, PLACES)


def exact(column: Column | str) -> Column:
    """One value as a decimal of nine places. What is no number, or has more than 19 digits before the point, is an error."""
    value = F.col(column) if isinstance(column, str) else column
    taken = value.try_cast(VALUE)
    return F.when(value.isNotNull() & taken.isNull(), F.raise_error(F.concat(F.lit("no exact decimal: "), value.cast("string"))).cast(VALUE)).otherwise(taken)


def exact_sum(column: Column | str) -> Column:
    """The sum of :func:`exact` values; NULL for no values, an error beyond 38 digits."""
    return _checked(exact(column))


def sum_of_sums(column: Column | str) -> Column:
    """The sum of exact sums."""
    return _checked((F.col(column) if isinstance(column, str) else column).cast(TOTAL))


def _checked(value: Column) -> Column:
    total = F.try_sum(value).cast(TOTAL)
    over = F.count(value) > 0
    return F.when(over & total.isNull(), F.raise_error(F.lit("an exact sum has more than 38 digits")).cast(TOTAL)).otherwise(total)
