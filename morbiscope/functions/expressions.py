"""Column expressions for cleaning surveillance feeds. All are ANSI-safe: unusable text gives null, not an error."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from morbiscope.functions.normal import PLACEHOLDERS



# ---- text ---------------------------------------------------------------------------------------------------
def clean_text(text: Column) -> Column:
    """Runs of (ASCII) white space as one blank, trimmed; placeholders become null."""
    blank = F.translate(text, "\t\n\x0b\f\r", "     ")
    # Most texts hold no run of blanks, and need no regular expression.
    tidy = F.trim(F.when(F.contains(blank, F.lit("  ")), F.regexp_replace(blank, " +", " ")).otherwise(blank))
    return F.when(~F.upper(tidy).isin(*PLACEHOLDERS), tidy)


def _titled(text: Column) -> Column:
    """Title case after blanks and hyphens: a blank that is put behind each hyphen, and taken away again, starts a word."""
    return F.replace(F.initcap(F.replace(F.lower(text), F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))


def hyphen_title(text: Column) -> Column:
    """Title case in which both sides of a hyphen start a word (``TIMOR-LESTE`` -> ``Timor-Leste``)."""
    return _titled(clean_text(text))


def compact_title(text: Column) -> Column:
    """Title case without white space; words already run together are kept apart first (``HAI phong`` -> ``HaiPhong``)."""
    parted = F.regexp_replace(clean_text(text), "([a-z])(?=[A-Z])", "$1 ")
    return F.replace(_titled(parted), F.lit(" "), F.lit(""))


def compact_key(text: Column) -> Column:
    """Join key of ``compact_title``."""
    return F.lower(compact_title(text))


def bare_name(text: Column, generic: Sequence[str] = ("CITY", "PROVINCE", "REGION", "STATE", "DISTRICT", "MUNICIPALITY")) -> Column:
    """Upper-case A-Z0-9 without generic words, for loose comparisons of place names."""
    upper = F.regexp_replace(F.upper(text), r"\b(?:" + "|".join(generic) + r")\b", "")
    return F.regexp_replace(upper, r"[^A-Z0-9]", "")


def snake_name(name: str, fallback: str = "col") -> str:
    """Column name of a spreadsheet header: runs of other characters become one underscore."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_") or fallback


def snake_columns(names: Iterable[str]) -> list[str]:
    """Safe column names; two headers that become one are an error."""
    out = [snake_name(n) for n in names]
    if twice := sorted({n for n in out if out.count(n) > 1}):
        raise ValueError(f"headers collide as {twice}")
    return out


# ---- numbers, dates -----------------------------------------------------------------------------------------
def digits_as(text: Column, kind: str = "bigint", digits: str = r"\d+") -> Column:
    """A non-negative whole number written in ``digits`` only; signs, decimals and overflow give null."""
    tidy = clean_text(text)
    return F.when(tidy.rlike(f"^{digits}$"), tidy.try_cast(kind))


def day(text: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_date(clean_text(text), pattern)


def instant(text: Column) -> Column:
    """ISO-8601 text as an instant, offsets applied; text without one is of the session's zone."""
    return F.try_to_timestamp(clean_text(text))


def clock(at: Column) -> Column:
    """An instant as the date and time in UTC, whatever the session's zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.unix_micros(at)
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000)).cast("decimal(18,6)"))


def real(text: Column) -> Column:
    return clean_text(text).try_cast("double")


def month_start(year: Column, month: Column) -> Column:
    """First day of a month, null unless the month is 1 to 12."""
    parts = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01"))
    return F.when(month.between(1, 12), F.try_to_date(parts, "yyyy-MM-dd"))


def period_end(start: Column, resolution: Column) -> Column:
    """Exclusive end of the period of a week, month or year that begins on ``start``."""
    return (
        F.when(resolution.isin("week", "epiweek", "isoweek"), F.date_add(start, 7))
        .when(resolution == "month", F.add_months(start, 1))
        .when(resolution == "year", F.add_months(start, 12))
    )


def inclusive_days(first: Column, last: Column) -> Column:
    return F.datediff(last, first) + 1


def log_scale(value: Column) -> Column:
    """log10 of positive values, else null."""
    return F.when(value > 0, F.log10(value))


# Offsets of the zone names that RFC 822 knows.
_ZONES = {"UT": "+0000", "GMT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def rfc822(text: Column) -> Column:
    """An RFC 822 date with a known zone; no zone, ``-0000`` and malformed text give null.

    The weekday, the seconds and a comment in brackets may be there or not; a year of two digits is 1969 to 2068.
    """
    tidy = F.regexp_replace(F.trim(F.regexp_replace(text, r"\([^()]*\)", " ")), r"^(?:[A-Za-z]+,|[A-Za-z]{3}\s)\s*", "")
    zone = F.upper(F.regexp_extract(tidy, r"\s([A-Za-z]{1,3})$", 1))
    offset = F.create_map(*[F.lit(x) for kv in _ZONES.items() for x in kv])[zone]
    fixed = F.when(zone != "", F.concat(F.regexp_replace(tidy, r"[A-Za-z]{1,3}$", ""), offset)).otherwise(tidy)
    seconds = F.regexp_replace(fixed, r"(\s\d{2}:\d{2})(\s)", "$1:00$2")
    year = F.regexp_extract(seconds, r"^\d{1,2}\s+[A-Za-z]{3}\s+(\d{2})\s", 1)
    century = F.when(year > "68", "19").otherwise("20")
    whole = F.when(year != "", F.concat(F.regexp_extract(seconds, r"^(\d{1,2}\s+[A-Za-z]{3}\s+)", 1), century, F.regexp_replace(seconds, r"^\d{1,2}\s+[A-Za-z]{3}\s+", ""))).otherwise(seconds)
    return F.when(~F.endswith(whole, F.lit("-0000")), F.try_to_timestamp(F.regexp_replace(whole, r"\s+", " "), F.lit("d MMM yyyy HH:mm:ss Z")))


# ---- labels and codes ---------------------------------------------------------------------------------------
def relabel(value: Column, labels: Mapping[str, str]) -> Column:
    """Mapped value, or the value itself where the map has none."""
    out = value
    for old, new in reversed(list(labels.items())):
        out = F.when(value == old, F.lit(new)).otherwise(out)
    return out


def preference(value: Column, order: Sequence[str]) -> Column:
    """Position of the value in ``order``; everything else shares the last rank."""
    out = F.lit(len(order))
    for rank, name in reversed(list(enumerate(order))):
        out = F.when(value == name, F.lit(rank)).otherwise(out)
    return out


def padded_code(code: Column, prefixes: Sequence[str]) -> Column:
    """``TH-1`` -> ``TH01`` for the prefixes whose codes are numbered alike; others are null."""
    shape = f"^({'|'.join(prefixes)})-([0-9]{{1,2}})$"
    return F.when(code.rlike(shape), F.concat(F.regexp_extract(code, shape, 1), F.lpad(F.regexp_extract(code, shape, 2), 2, "0")))


def chosen(**branches: Column) -> tuple[Column, Column]:
    """(first non-null value, name of the branch it came from or ``unmatched``)."""
    label = F.lit("unmatched")
    for name, value in reversed(branches.items()):
        label = F.when(value.isNotNull(), F.lit(name)).otherwise(label)
    return F.coalesce(*branches.values()), label


def web_address(text: Column) -> Column:
    tidy = clean_text(text)
    return F.when(tidy.rlike(r"^https?://\S+$"), tidy)


def below(path: Column, folder: str) -> Column:
    """The part of a path below its last ``folder``."""
    return F.regexp_replace(path, f"^.*/{folder}/", "")


# ---- free text ----------------------------------------------------------------------------------------------
def any_pattern(texts: Sequence[Column], patterns: Sequence[str]) -> Column:
    """True if a pattern is found in the lower-cased texts; null texts hold nothing."""
    body = F.lower(F.concat_ws(" ", *texts))
    return reduce(lambda a, b: a | b, [body.rlike(p) for p in patterns], F.lit(False))


def pattern_labels(texts: Sequence[Column], patterns: Mapping[str, str]) -> Column:
    """Names of all patterns found, in the order given."""
    body = F.lower(F.concat_ws(" ", *texts))
    return F.array_compact(F.array(*[F.when(body.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def without_suffix(title: Column, publisher: Column, separator: str = " - ") -> Column:
    """A headline without its trailing publisher."""
    tail = F.concat(F.lit(separator), publisher)
    return F.when(F.endswith(title, tail), F.substring(title, F.lit(1), F.length(title) - F.length(tail))).otherwise(title)


def words(text: Column, stop: Sequence[str] = (), least: int = 3) -> Column:
    """Lower-case a-z words of at least ``least`` letters that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+)"), 1)
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)


def _unescaped():
    """Arrow-batched decoding of HTML entities; Spark has no built-in for the named ones."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unescape(t) if isinstance(t, str) and "&" in t else t)

    return run


def plain_title(text: Column) -> Column:
    """Entities decoded, white space (Unicode) collapsed, empty as null."""
    tidy = F.trim(F.regexp_replace(_unescaped()(text), r"(?U)\s+", " "))
    return F.when(tidy != "", tidy)


# A tag that reads alike for every parser: a name, and attributes without angle brackets or open quotes.
_PLAIN_TAG = re.compile(r"""</?(?!(?:script|style|title|textarea|plaintext|xmp|iframe|noembed|noframes|noscript)\b)[A-Za-z][A-Za-z0-9]*(?:\s+[A-Za-z-]+(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+))?)*\s*/?>""", re.I)


class _Text(HTMLParser):
    """The texts between the tags of a fragment."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.texts.append(data)


def text_of_html(markup: str | None) -> str | None:
    """The text of an HTML fragment, its tags as blanks; ``<`` and ``>`` that are no tags stay text."""
    if markup is None or ("<" not in markup and "&" not in markup):
        return markup
    bare = _PLAIN_TAG.sub(" ", markup)
    if "<" not in bare:  # nothing but plain tags, which need no parser
        return unescape(bare)
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return " ".join(parser.texts)


def html_text(text: Column) -> Column:
    """Text of an HTML fragment by a parser over Arrow batches: tags as blanks, comments dropped, entities decoded, white space collapsed."""

    @F.pandas_udf("string")
    def run(fragments: pd.Series) -> pd.Series:
        return fragments.map(text_of_html, na_action="ignore")

    tidy = F.trim(F.regexp_replace(run(text), r"(?U)\s+", " "))
    return F.when(tidy != "", tidy)
