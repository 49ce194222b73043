"""Rules of translations: what each language has, and whether it keeps what must stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.positions import numbers_within

TRANSLATED = ("label", "hint", "constraint message", "required message", "media:image", "media:audio", "media:video")
_TOKEN, _TAG = r"(\$\{[^}]+\})", r"(</?[A-Za-z][^>]*>)"


def languages(columns: list[str]) -> dict[str, list[str]]:
    """Language: the columns it has; '' is the default."""
    out: dict[str, list[str]] = {}
    for c in columns:
        stem = next((s for s in sorted(TRANSLATED, key=len, reverse=True) if c == s or c.startswith(s + ":")), None)
        if stem:
            out.setdefault(c[len(stem) + 1 :], []).append(stem)
    return out


def _c(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def _pairs(sheet: DataFrame, stems: tuple[str, ...] = ("label", "hint")) -> list[tuple[str, str, str]]:
    return [(s, f"{s}:{lang}", lang) for lang, have in languages(sheet.columns).items() if lang for s in have if s in stems and s in sheet.columns]


def filled(sheet: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_cells): how many cells of each column are filled."""
    some = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "").alias("some")) for c in columns]))
    return sheet.select(some.alias("c")).groupBy("c.column").agg(F.count_if("c.some").alias("n_cells"))


def inventory(sheet: DataFrame) -> DataFrame:
    """(language, n_columns, n_cells) of a sheet's languages; the default one has no name."""
    of = {f"{stem}:{lang}" if lang else stem: lang for lang, stems in languages(sheet.columns).items() for stem in stems}
    lang = F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("column"))
    return filled(sheet, list(of)).groupBy(lang.alias("language")).agg(F.count(F.lit(1)).cast("int").alias("n_columns"), F.sum("n_cells").alias("n_cells"))


def missing(sheet: DataFrame) -> DataFrame:
    """Texts of the default language without a translation (what an incremental run has to do)."""
    parts = [sheet.where((_c(a) != "") & (_c(b) == "")).select("excel_row", F.lit(a).alias("column"), F.lit(lang).alias("language")) for a, b, lang in _pairs(sheet, TRANSLATED)]
    return reduce(DataFrame.unionByName, parts)


def parity(sheet: DataFrame) -> DataFrame:
    """Filled cells of each translated column beside those of its default; one pass."""
    pairs = _pairs(sheet, TRANSLATED)
    counts = [F.struct(F.lit(b).alias("column"), F.count_if(_c(a) != "").alias("n_default"), F.count_if(_c(b) != "").alias("n_translated")) for a, b, _ in pairs]
    return sheet.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def _kept(sheet: DataFrame, pattern: str) -> DataFrame:
    found = lambda c: F.array_sort(F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(1)))
    parts = [sheet.where((_c(b) != "") & (found(a) != found(b))).select("excel_row", F.lit(b).alias("column"), F.array_except(found(a), found(b)).alias("lost"), F.array_except(found(b), found(a)).alias("added")) for a, b, _ in _pairs(sheet)]
    return reduce(DataFrame.unionByName, parts)


def tokens_kept(sheet: DataFrame) -> DataFrame:
    """Translations that lose or gain a ${field}."""
    return _kept(sheet, _TOKEN)


def tags_kept(sheet: DataFrame) -> DataFrame:
    return _kept(sheet, _TAG)


def default_unsuffixed(columns: list[str], default_language: str) -> list[str]:
    """Columns that carry the default language as a suffix."""
    return [c for c in columns if c.endswith(f":{default_language}")]


def glossary_conflicts(sheet: DataFrame) -> DataFrame:
    """Source texts that one language renders in more than one way."""
    parts = [sheet.where((_c(a) != "") & (_c(b) != "")).select(F.lit(lang).alias("language"), F.trim(_c(a)).alias("source"), F.trim(_c(b)).alias("target")) for a, b, lang in _pairs(sheet)]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("language", "source").agg(F.array_sort(F.collect_set("target")).alias("targets")).where(F.size("targets") > 1)


def media_parity(sheet: DataFrame) -> DataFrame:
    pairs = _pairs(sheet, ("media:image", "media:audio", "media:video"))
    parts = [sheet.where((_c(a) != "") != (_c(b) != "")).select("excel_row", F.lit(b).alias("column")) for a, b, _ in pairs]
    return reduce(DataFrame.unionByName, parts) if parts else sheet.sparkSession.createDataFrame([], "excel_row int, column string")


def changed_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose untouchable cells a translation has changed, with the side they are on."""
    a, b = before.select(*keys), after.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def spot_check(sheet: DataFrame, percent: float = 5.0, key: str = "excel_row") -> DataFrame:
    """(column, key): of each translated column, the smallest ``percent`` of its filled rows by hash, rounded up.

    The same rows in every run, and as many as asked for from every column,
    however short or long: the rows of a column are numbered by hash, by ranges.
    """
    columns = {c: F.col(f"`{c}`") for c in sheet.columns if ":" in c} or {"": F.lit("row")}  # without translations, of the rows
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text.alias("text")) for c, text in columns.items()]))
    filled = sheet.select(F.col(key), cells.alias("c")).select("c.column", key, "c.text").where("coalesce(text, '') <> ''").drop("text")
    turn = F.sha2(F.concat_ws(":", "column", F.col(key).cast("string")), 256)
    numbered = numbers_within(filled.withColumn("__turn", turn), ["column"], ["__turn", key], "__n")
    sizes = filled.groupBy(F.col("column").alias("of")).agg(F.ceil(F.count(F.lit(1)) * percent / 100).alias("wanted"))
    return numbered.join(F.broadcast(sizes), F.col("column") == F.col("of")).where("__n <= wanted").select("column", key)  # a row a language


def glossary_markdown(terms: list[tuple[str, dict[str, str]]], langs: list[str]) -> str:
    """The glossary as a Markdown table: term, then each language."""
    head = f"| Term | {' | '.join(langs)} |\n|{' --- |' * (len(langs) + 1)}\n"
    return head + "".join(f"| {t} | {' | '.join(x.get(lang, '') for lang in langs)} |\n" for t, x in terms)
