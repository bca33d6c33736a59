"""Text to values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space around a field, and numeric prefixes.
BLANKS = " \t\r\n"
DECIMAL_PREFIX = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[+-]?(?:nan|inf(?:inity)?))"
INTEGER_PREFIX = r"^([+-]?[0-9]+)"


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(BLANKS))


def to_double(text: Column, lenient: bool = False) -> Column:
    """NULL where the text is no number; `lenient` accepts a numeric prefix ('12abc' is 12)."""
    if lenient:
        text = F.regexp_extract(F.lower(text), DECIMAL_PREFIX, 1)
    return text.try_cast("double")


def to_bigint(text: Column, lenient: bool = False) -> Column:
    if lenient:
        text = F.regexp_extract(text, INTEGER_PREFIX, 1)
    return text.try_cast("bigint")


def is_whole(value: Column, units: int) -> Column:
    """Whether an amount is a whole number of minor units that a BIGINT can hold (up to the last digits of a double)."""
    scaled = value * units
    off = F.abs(scaled - F.round(scaled))
    return (F.abs(scaled) < float(2**63)) & (off <= F.abs(scaled) * 1e-12 + 1e-9)


def to_minor(value: Column, units: int = 100) -> Column:
    """Currency amount as whole minor units; NULL for NaN, infinities and overflow."""
    scaled = F.round(value * units)
    return F.when(F.abs(scaled) < float(2**63), scaled).try_cast("bigint")
