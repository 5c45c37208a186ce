"""Parsers of the text values of an audit file, as columns: exact or null, never coerced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: what counts as white space around a value
SPACE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
AMOUNT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
DOUBLE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([Ee][+-]?[0-9]+)?$"
DATE = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(Z|[+-]([0-9]{2}):([0-9]{2}))?$"
#: amounts keep this many digits in all and after the point on the fast path
FAST = "decimal(28,8)"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE))


def clean(text: Column) -> Column:
    """Stripped text; empty is null."""
    return F.nullif(stripped(text), F.lit(""))


def parse_amount(text: Column, kind: str = FAST) -> Column:
    """xs:decimal without exponent, comma or grouping; null if invalid or wider than the type's whole digits."""
    s = stripped(text)
    return F.when(s.rlike(AMOUNT), s.try_cast(kind))


def inexact(text: Column, kind: str = FAST) -> Column:
    """Whether a valid amount does not fit the type exactly."""
    s = stripped(text)
    wide = s.try_cast(kind)
    digits = F.length(F.regexp_extract(F.regexp_replace(s, "0+$", ""), r"\.([0-9]*)$", 1))
    scale = int(kind.rstrip(")").split(",")[1])
    return s.rlike(AMOUNT) & (wide.isNull() | (s.contains(".") & (digits > scale)))


def parse_int(text: Column) -> Column:
    s = stripped(text)
    return F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint"))


def is_double(text: Column) -> Column:
    s = stripped(text)
    return s.isin("INF", "-INF", "NaN") | s.rlike(DOUBLE)


def parse_double(text: Column) -> Column:
    """An xs:double as an exact decimal; special values and exponents beyond 400 are null."""
    s = stripped(text)
    exponent = F.ltrim(F.regexp_replace(F.regexp_extract(s, "[Ee][+-]?([0-9]+)$", 1), "^0+", ""))
    fits = (F.length(exponent) < 3) | ((F.length(exponent) == 3) & (exponent <= "400"))
    return F.when(s.rlike(DOUBLE) & fits, s.try_cast("decimal(38,18)"))


def parse_date(text: Column) -> Column:
    """xs:date; a time zone of at most 14 hours is allowed and dropped."""
    s = stripped(text)
    hours, minutes = (F.regexp_extract(s, DATE, k).try_cast("int") for k in (5, 6))
    zone = hours.isNull() | ((minutes <= 59) & ((hours < 14) | ((hours == 14) & (minutes == 0))))
    return F.when(s.rlike(DATE) & zone, F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))


def had_zone(text: Column) -> Column:
    return parse_date(text).isNotNull() & (F.length(stripped(text)) > 10)


def parse_adf_amount(text: Column, decimals: int = 2) -> Column:
    """A fixed-width number: sign before or after, point, comma or neither, always with its decimal digits."""
    s = stripped(text)
    negative = s.startswith("-") | s.endswith("-")
    body = stripped(F.regexp_replace(s, r"^[+-]+|[+-]+$", ""))
    last = F.regexp_extract(body, r"[.,]([0-9]*)$", 1)
    good = body.rlike(r"^-?[0-9.,]*[0-9]$")
    if decimals:
        good = good & (~body.rlike("[.,]") | (F.length(last) == decimals))
    digits = F.regexp_replace(body, "[^0-9]", "").try_cast("decimal(28,0)")
    value = (digits / F.lit(10**decimals).cast("decimal(9,0)")).cast(f"decimal(28,{max(decimals, 2)})")
    return F.when(good & (s != ""), F.when(negative, -value).otherwise(value))


def parse_adf_date(text: Column) -> Column:
    s = stripped(text)
    parts = [F.regexp_extract(s, "^([0-9]{2})-?([0-9]{2})-?([0-9]{4})$", k) for k in (3, 2, 1)]
    return F.when(s.rlike("^[0-9]{2}-?[0-9]{2}-?[0-9]{4}$"), F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def significant_digits(text: Column) -> tuple[Column, Column]:
    """(all digits, digits after the point) of a decimal's text without leading zeros and trailing zeros of the fraction."""
    s = F.regexp_replace(stripped(text), "^[+-]", "")
    whole = F.regexp_replace(F.substring_index(s, ".", 1), "^0+", "")
    fraction = F.when(s.contains("."), F.regexp_replace(F.substring_index(s, ".", -1), "0+$", "")).otherwise("")
    return F.length(whole) + F.length(fraction), F.length(fraction)


def sided(amount: Column, side: Column, policy: str = "flip") -> tuple[Column, Column]:
    """(side, signed amount, debit-positive). flip: a negative debit is a credit; abs: the sign is dropped."""
    s = F.upper(stripped(side))
    value = F.abs(amount) if policy == "abs" else amount
    return F.when(s.isin("D", "C"), s), F.when(s == "D", value).when(s == "C", -value)


def split(signed: Column) -> tuple[Column, Column]:
    """(debit, credit), neither negative."""
    zero = F.lit(0)
    return F.greatest(signed, zero), F.greatest(-signed, zero)


def half_even(value: Column, kind: str = "decimal(20,2)") -> Column:
    scale = int(kind.rstrip(")").split(",")[1])
    return F.bround(value, scale).try_cast(kind)


def exact_or_null(value: Column, kind: str = "decimal(20,2)") -> Column:
    narrow = value.try_cast(kind)
    return F.when(narrow == value, narrow)
