"""Null-safe, ANSI-safe parsing of hand-written text fields (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value.
PLACEHOLDERS = ("", "NA", "N/A", "NULL", "NONE")

# Every character that is white space, the separators U+001C to U+001F included.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim_all(text: Column) -> Column:
    """``text`` without surrounding white space of any kind, Unicode spaces included."""
    return F.btrim(text, F.lit(_SPACES))


def key_upper(text: Column) -> Column:
    """Trimmed upper-case comparison key."""
    return F.upper(trim_all(text))


def key_lower(text: Column) -> Column:
    """Trimmed lower-case comparison key."""
    return F.lower(trim_all(text))


def is_placeholder(text: Column) -> Column:
    """True for null, blank and the placeholder words in any letter case (never null)."""
    return F.coalesce(key_upper(text).isin(*PLACEHOLDERS), F.lit(True))


def null_if_placeholder(text: Column) -> Column:
    """Trimmed text, or null where it is a placeholder."""
    trimmed = trim_all(text)
    return F.when(~F.upper(trimmed).isin(*PLACEHOLDERS), trimmed)


def parse_day(text: Column) -> Column:
    """A date from year-first notations (``-``, ``/`` or nothing between the parts, time ignored).

    Anything else, and days that do not exist, give null.
    """
    # The common notation is read as it is; the pattern below is for the others.
    common = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-") & text.between("0001", "9999-99-99")
    trimmed = trim_all(text)
    usable = trimmed.rlike(r"^(?!0000)\d{4}([-/.]?)\d{2}\1\d{2}(?:[T ].*)?$")
    digits = F.translate(F.substring(trimmed, 1, 10), "-/.", "")
    iso = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(common, text.try_cast("date")).when(usable, iso.try_cast("date"))


def parse_instant(text: Column) -> Column:
    """An instant (timestamp) from ISO-8601 text; text without a zone is UTC, bad text gives null."""
    common = (F.length(text) == 25) & (F.substring(text, 11, 1) == "T") & F.substring(text, 20, 1).isin("+", "-") & (F.substring(text, 23, 1) == ":")
    trimmed = trim_all(text)
    zoned = trimmed.rlike(r"\d:\d.*(?:[Zz]|[+-]\d{2}:?\d{2})$")
    full = F.when(zoned, trimmed).when(F.length(trimmed) == 10, F.concat(trimmed, F.lit("T00:00:00Z"))).otherwise(F.concat(trimmed, F.lit("Z")))
    return F.when(common, text.try_cast("timestamp")).otherwise(F.try_to_timestamp(full))


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 text, null if there is no usable instant."""
    return F.unix_micros(parse_instant(text))


def parse_number(text: Column) -> Column:
    """A decimal number by value (``07`` = ``7`` = ``7.0``); placeholders and other text give null."""
    return F.coalesce(text.try_cast("decimal(38,9)"), trim_all(text).try_cast("decimal(38,9)"))


def parse_int(text: Column) -> Column:
    """An integer by value, null where the text is no whole number."""
    number = trim_all(text).try_cast("decimal(38,9)")
    return F.coalesce(text.try_cast("int"), F.when(number % 1 == 0, number.try_cast("int")))
