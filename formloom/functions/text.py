"""String functions. Blank is NULL in storage and '' to these functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """A stored string as the engine keeps it: NULL for nothing but spaces."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def empty_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number_text(c: Column) -> Column:
    """A number as the language prints it: 3 rather than 3.0."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))


def substr(c: Column, start: Column, end: Column) -> Column:
    """From the zero-based start up to, not including, end."""
    begin = F.greatest(start.cast("int"), F.lit(0))
    return F.substring(empty_text(c), begin + 1, F.greatest(end.cast("int") - begin, F.lit(0)))


def concat(*parts: Column) -> Column:
    return F.concat(*[empty_text(p) for p in parts])


def format_number(c: Column) -> Column:
    """Thousands marked by commas; the decimals stay as they are."""
    text = number_text(F.abs(c))
    decimals = F.regexp_extract(text, r"(\.\d+)$", 1)
    return F.concat(F.when(c < 0, "-").otherwise(""), F.format_number(F.floor(F.abs(c)).cast("bigint"), 0), decimals)


def keyed_hash(*parts: Column) -> Column:
    """The same parts give the same hash, in any run."""
    return F.sha2(F.concat_ws("\u001f", *[empty_text(p) for p in parts]), 256)


def keyed_random(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, not on partitions or retries: the first 52 bits of their hash."""
    return F.conv(F.substring(keyed_hash(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def keyed_uuid(*parts: Column) -> Column:
    """A name-based id in the form of a UUID."""
    h = keyed_hash(*parts)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))


def plain_text(c: Column) -> Column:
    """HTML without script and style elements, tags and surplus white space."""
    bare = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def safe_html(c: Column) -> Column:
    """HTML kept, but no script elements, event attributes or script links; html, head and body are unwrapped.

    Taking a part out can make another of what stood around it, so what is
    left of such a construction is not trusted: where one more pass would
    change the text again, all tags and script links are taken out.
    """
    once = _without_scripts(c)
    again = _without_scripts(once)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(again, r"(?is)<[^<>]*>?", ""), r"[<>]", ""), r"(?i)script\s*:", "script ")
    return F.trim(F.when(once == again, once).otherwise(bare))


def _without_scripts(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    s = F.regexp_replace(s, r"(?is)\s+on[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "")
    s = F.regexp_replace(s, r"(?i)javascript:", "")
    s = F.regexp_replace(s, r"(?is)<head\b[^>]*>.*?</head\s*>", "")
    return F.regexp_replace(s, r"(?i)</?(html|body)\b[^>]*>|<!doctype[^>]*>", "")


def markdown_html(c: Column) -> Column:
    """Bold, italic and links of Markdown as HTML."""
    s = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<b>$1</b>")
    s = F.regexp_replace(s, r"\*([^*]+)\*", "<i>$1</i>")
    return F.regexp_replace(s, r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')
