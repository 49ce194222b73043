"""Dates and times. Texts that are no date give NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format tokens of the language and the pattern letters they stand for.
TOKENS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%n": "M", "%b": "MMM", "%d": "dd", "%e": "d", "%a": "E", "%H": "HH", "%h": "H", "%M": "mm", "%S": "ss", "%3": "SSS"}


def pattern(fmt: str) -> str:
    """The language's format as a pattern; whatever is no token is quoted."""
    out, plain, k = "", "", 0

    def quoted() -> str:
        return "'" + plain.replace("'", "''") + "'" if plain else ""

    while k < len(fmt):
        token = TOKENS.get(fmt[k : k + 2])
        if token:
            out, plain, k = out + quoted() + token, "", k + 2
        else:
            plain, k = plain + fmt[k], k + 1
    return out + quoted()


def to_date(c: Column) -> Column:
    return c.try_cast("date")


def to_timestamp(c: Column) -> Column:
    return c.try_cast("timestamp")


def decimal_date_time(ts: Column) -> Column:
    """Days since 1970-01-01, with fractions."""
    return F.unix_micros(ts).cast("double") / F.lit(86_400_000_000.0)


def decimal_time(text: Column) -> Column:
    """Fraction of the day of a time HH:mm[:ss]."""
    t = F.coalesce(F.regexp_extract(text.cast("string"), r"(\d{1,2}:\d{2}(?::\d{2})?)", 1), F.lit(""))
    part = lambda k: F.coalesce(F.get(F.split(t, ":"), F.lit(k)).try_cast("double"), F.lit(0.0))
    return F.when(t != "", (part(0) * 3600 + part(1) * 60 + part(2)) / 86400.0)


def format_date_time(c: Column, fmt: str) -> Column:
    return F.date_format(c, pattern(fmt))


def duration(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)).cast("double") / 1e6
