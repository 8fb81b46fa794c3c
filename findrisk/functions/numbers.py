"""Numeric helpers that never raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(column: Column, default: float | None = 0.0) -> Column:
    """Value as double; text that is not a number, NaN and null become ``default``."""
    value = F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def whole(column: Column) -> Column:
    """Value as int, fractions cut off, anything unusable 0."""
    return F.coalesce(number(column).try_cast("int"), F.lit(0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


# The words that count as true.
TRUE_WORDS = ("true", "yes", "1", "patched")


def truth(text: Column) -> Column:
    """1 for a text that is one of the words for true, in any case and with blanks around, else 0."""
    return flag(F.lower(F.trim(text)).isin(*TRUE_WORDS))


def clip(column: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(column, F.lit(float(low))), F.lit(float(high)))


def round4(column: Column) -> Column:
    """Four decimals by scaling: the scaled double is rounded, ties to even."""
    return F.rint(column * 10000.0) / 10000.0


def exact_round(column: Column, digits: int) -> Column:
    """Decimals as number printing gives them: the exact binary value is rounded, ties to even.

    Scaling alone is not enough: 0.5135 lies just below or above the tie that its
    scaled value shows. Where the scaled value is a tie, the part that the
    multiplication lost decides; it is recovered by splitting the factor into
    two halves whose products are exact.
    """
    scale = float(10**digits)
    scaled = column * scale
    wide = column * 134217729.0
    high = wide - (wide - column)
    lost = (high * scale - scaled) + (column - high) * scale
    below = F.floor(scaled).cast("double")
    rounded = (
        F.when(scaled - below != 0.5, F.rint(scaled)).when(lost > 0, below + 1.0).when(lost < 0, below).otherwise(F.rint(scaled))
    )
    return rounded / scale


def fixed(column: Column, digits: int, sign: bool = False) -> Column:
    """Text with a fixed number of decimals; null stays null."""
    pattern = f"%{'+' if sign else ''}.{digits}f"
    return F.when(column.isNotNull(), F.format_string(pattern, exact_round(column, digits)))


def round4_half_up(column: Column) -> Column:
    """Four decimals, ties upward, as the service variant reports them."""
    return F.floor(column * 10000.0 + 0.5).cast("double") / 10000.0


def ratio(top: Column, bottom: Column) -> Column:
    """Plain quotient of two counts as double, 0 when there is nothing to divide by."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def mean4(column: Column) -> Column:
    """Mean of a column that holds four decimals, summed in whole ten-thousandths.

    Whole numbers add up exactly, so the mean does not depend on the order in
    which partial sums arrive or on tasks being run again.
    """
    return sum4(column) / F.count(column) / 10000.0


def sum4(column: Column) -> Column:
    """Exact sum of a four-decimal column in ten-thousandths, as a double quotient's numerator."""
    return F.sum(F.rint(column * 10000.0).cast("bigint")).cast("double")


def exact_mean(column: Column) -> Column:
    """Mean summed in decimals of eight places, so that it is the same in whatever order rows arrive."""
    return F.sum(column.cast("decimal(18,8)")).cast("double") / F.count(column)
