"""Scalar expressions: time arithmetic, safe ratios, casts and value clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Device names that count as mobile (compared in lower case).
MOBILE_DEVICES = ("mobile", "tablet", "ios", "android")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed full days (floor), which differs from calendar-day `datediff`."""
    gap = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(gap / F.lit(MICROS_PER_DAY)).cast("bigint")


def fractional_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_DAY))


def ratio(numerator: Column, denominator: Column, default: float = 0.0) -> Column:
    """Division that yields `default` where the denominator is zero or null."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return F.coalesce(quotient, F.lit(float(default)))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value))


def r6(value: Column) -> Column:
    """Six decimals, the precision at which two engines are compared."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def non_empty(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def mobile_exact(device: Column) -> Column:
    return F.lower(device).isin(*MOBILE_DEVICES)


def mobile_substring(device: Column, tokens: Sequence[str] = MOBILE_DEVICES) -> Column:
    """True when any token occurs anywhere in the device name, ignoring case."""
    hits = [F.contains(F.lower(device), F.lit(t.lower())) for t in tokens]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return F.coalesce(found, F.lit(False))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """One alternation regex instead of one test per word; words are literals."""
    return F.lower(text).rlike("|".join(words))


def any_matches(texts: Column, words: Sequence[str]) -> Column:
    return F.exists(texts, lambda t: contains_any(t, words))


def parse_instant(text: Column) -> Column:
    """ISO-8601 text, with or without `Z`; unparseable text becomes null."""
    return F.try_to_timestamp(text)


def apply_rule(value: Column, rule: str | None) -> Column:
    """Typed conversion by rule name; a value that does not convert becomes null."""
    text = value.cast("string")
    if rule is None:
        return value
    if rule == "decimal":
        return text.try_cast("decimal(18,2)")
    if rule == "int":
        return text.try_cast("bigint")
    if rule == "float":
        return text.try_cast("double")
    if rule == "datetime":
        return parse_instant(text)
    if rule == "bool":
        return F.lower(text).isin("true", "1", "yes")
    if rule == "json_parse":
        return F.coalesce(F.try_parse_json(text), F.parse_json(F.to_json(F.struct(text.alias("raw")))))
    raise ValueError(f"unknown conversion rule {rule!r}")


def whole_number(value: Column) -> Column:
    """Text such as '3.0' to 3: through double, then truncation."""
    return value.cast("string").try_cast("double").try_cast("int")


def numeric_text(text: Column) -> Column:
    """Whether text reads as a number once commas and blanks are removed."""
    return F.regexp_replace(text, "[, ]", "").try_cast("double").isNotNull()


def compact_labels(*labels: Column) -> Column:
    """Array of the labels whose condition held, in order."""
    return F.array_compact(F.array(*labels))


def money_sum(value: Column) -> Column:
    """Sum of cent amounts without rounding drift, independent of the row order."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def money_avg(value: Column) -> Column:
    return F.try_divide(money_sum(value), F.count(value).cast("double"))
