"""Rounding on integers, so that results are exact and independent of row order.

Counts and cents stay BIGINT until the last step. A quotient is rounded half away
from zero by integer division and only then scaled to a DOUBLE. The intermediate
product is a DECIMAL, so it cannot overflow where the inputs did not.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(28,0)"


def div(num: Column, den: Column) -> Column:
    """Integer division; NULL where the divisor is zero."""
    return F.call_function("div", num, F.nullif(den, F.lit(0).cast(WIDE)))


def half_up(num: Column, den: Column, scale: int = 1) -> Column:
    """``round(scale * num / den)`` as BIGINT; NULL where ``den`` is zero."""
    n, d = num.cast(WIDE), den.cast(WIDE)
    size = div(F.abs(n) * F.lit(2 * scale) + d, d * F.lit(2))
    return F.when(n < 0, -size).otherwise(size)


def _scaled(units: Column, per_one: float) -> Column:
    return units.cast("double") / F.lit(per_one)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to 2 decimals."""
    return _scaled(half_up(part, whole, 10_000), 100.0)


def percent1(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to 1 decimal."""
    return _scaled(half_up(part, whole, 1_000), 10.0)


def change(now: Column, before: Column) -> Column:
    """Growth from ``before`` to ``now`` in percent, to 2 decimals."""
    return percent(now - before, before)


def average(total: Column, n: Column) -> Column:
    """``total / n`` to 2 decimals."""
    return _scaled(half_up(total, n, 100), 100.0)


def average0(total: Column, n: Column) -> Column:
    """``total / n`` to 0 decimals."""
    return half_up(total, n).cast("double")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def money(in_cents: Column) -> Column:
    return _scaled(in_cents, 100.0)


def money_per(in_cents: Column, n: Column) -> Column:
    """Amount per head to 2 decimals, from cents."""
    return _scaled(half_up(in_cents, n), 100.0)


def twelfth(in_twelfths: Column) -> Column:
    """Whole cents from twelfths of a cent (BIGINT)."""
    return half_up(in_twelfths, F.lit(12))
