"""Exploration workbooks: declarative summaries compiled to DataFrames over one filtered base.

Bins use floor arithmetic over the observed range, with the largest value in
the last bin.  Percentages are of the rows that are not blank.  The option top
of a text summary gives its most frequent texts (as many as bins says, or ten).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .frequent import top_values

KINDS = ("text", "categorical", "numeric", "temporal", "geomap", "binary", "scatterplot", "crosstab", "trend", "map")
UNITS = {"days": "day", "weeks": "week", "months": "month"}


@dataclass
class Summary:
    type: str
    field: str
    field_2: str | None = None
    label: str | None = None
    note: str | None = None
    exclusion: str | None = None
    options: str = ""
    bins: int | None = None
    options_2: str = ""
    bins_2: int | None = None
    section: str | None = None

    def has(self, option: str) -> bool:
        return option in [o.strip() for o in self.options.split(",")]

    def unit(self, options: str | None = None) -> str | None:
        return next((UNITS[o.strip()] for o in (self.options if options is None else options).split(",") if o.strip() in UNITS), None)


@dataclass
class Workbook:
    summaries: list[Summary]
    global_filters: list[tuple[str, str]] = field(default_factory=list)
    global_exclusions: list[tuple[str, str]] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    @classmethod
    def of_rows(cls, summaries: list[dict], filters: list[dict] = (), exclusions: list[dict] = (), settings: dict | None = None) -> Workbook:
        """From sheet rows; begin group and end group become sections, and must match by label."""
        out, open_ = [], []
        for r in summaries:
            kind = (r.get("type") or "").strip()
            if kind == "begin group":
                open_.append(r.get("label"))
            elif kind == "end group":
                if not open_ or open_[-1] != r.get("label"):
                    raise ValueError(f"end group {r.get('label')!r} does not match")
                open_.pop()
            elif kind:
                if kind not in KINDS:
                    raise ValueError(f"unknown summary type {kind!r}")
                own = {k: r[k] for k in Summary.__dataclass_fields__ if r.get(k) not in (None, "")}
                own |= {k: int(own[k]) for k in ("bins", "bins_2") if k in own}
                out.append(Summary(**(own | {"section": " / ".join(str(x) for x in open_) or None})))
        if open_:
            raise ValueError(f"group {open_[-1]!r} is not closed")
        settings = settings or {}
        if re.search(r"[^\w-]", str(settings.get("workbook_id", ""))):
            raise ValueError("a workbook id has no spaces or punctuation")
        return cls(out, [(r["field"], r["filter"]) for r in filters], [(r["field"], r["exclusion"]) for r in exclusions], settings)


def _test(c: Column, text: str) -> Column:
    """Whether c is among "v1";"v2" or within ("min","max");... (inclusive); unknown where c is blank or no such value."""
    ranges = re.findall(r'\(\s*"([^"]*)"\s*,\s*"([^"]*)"\s*\)', text)
    if not ranges:
        return c.cast("string").isin(re.findall(r'"([^"]*)"', text))
    out = None
    for lo, hi in ranges:
        ends = [x.strip() for x in (lo, hi)]
        kind = "double" if all(re.fullmatch(r"-?\d+(\.\d+)?|", x) for x in ends) else "timestamp"
        value = c.try_cast(kind)
        parts = [value >= F.lit(ends[0]).try_cast(kind)] if ends[0] else []
        parts += [value <= F.lit(ends[1]).try_cast(kind)] if ends[1] else []
        one = parts[0] & parts[1] if len(parts) == 2 else parts[0] if parts else value.isNotNull()
        out = one if out is None else out | one
    return out


def condition(c: Column, text: str) -> Column:
    """The test with unknown as false."""
    return F.coalesce(_test(c, text), F.lit(False))


def keep(data: DataFrame, name: str, text: str) -> DataFrame:
    """Rows that pass; a filter drops unknowns by itself, so the test reaches the scan."""
    return data.where(_test(F.col(name), text))


def drop(data: DataFrame, name: str, text: str) -> DataFrame:
    """Rows that do not pass, blanks included; where the type allows, in a form that reaches the scan."""
    c, kind = F.col(name), data.schema[name].dataType.typeName()
    sure = "(" not in text if kind == "string" else kind in ("double", "float", "integer", "long", "timestamp", "date")
    return data.where(c.isNull() | ~_test(c, text)) if sure else data.where(~condition(c, text))


def base(book: Workbook, data: DataFrame) -> DataFrame:
    """What all summaries start from: global filters kept, global exclusions dropped."""
    for name, text in book.global_filters:
        data = keep(data, name, text)
    for name, text in book.global_exclusions:
        data = drop(data, name, text)
    return data


def without_keys(data: DataFrame, keys: DataFrame, key: str = "KEY") -> DataFrame:
    """Global exclusion of a table of submissions."""
    return data.join(keys, key, "left_anti")


def binned(df: DataFrame, c: Column, bins: int, name: str) -> DataFrame:
    """df with the bin 1..bins of c; the range comes from one aggregation, joined as a single row."""
    ends = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"))
    step = (F.col("__hi") - F.col("__lo")) / bins
    at = F.least(F.coalesce(F.floor(F.try_divide(c - F.col("__lo"), step)) + 1, F.lit(1)), F.lit(bins))
    return df.join(F.broadcast(ends), F.lit(True)).withColumn(name, F.when(c.isNotNull(), at.cast("int"))).drop("__lo", "__hi")


def categories(df: DataFrame, c: Column) -> DataFrame:
    """Counts and percentages; the total is one row, so no task sees all categories."""
    counts = df.where(c.isNotNull()).groupBy(c.cast("string").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.join(F.broadcast(total), F.lit(True)).select("category", "n", (100.0 * F.col("n") / F.col("__all")).alias("percent"))


def shown(s: Summary, out: DataFrame) -> DataFrame:
    """Of counts and percentages, what the options ask for; both where they ask for neither."""
    asked = [(o, c) for o, c in (("count", "n"), ("percent", "percent")) if s.has(o)]
    return out.drop(*{"n", "percent"} - {c for _, c in asked}) if asked else out


#: What the options mean, min and max ask for.
MEASURES = {"mean": F.avg, "min": F.min, "max": F.max}


def crosstab_totals(data: DataFrame, row: Column, column: Column, measures: dict[str, Column]) -> DataFrame:
    """Cells, row totals, column totals and the grand total of a cross-tabulation, by one aggregation over grouping sets.

    level says which a row is (cell, row, column, all); totals have blanks in
    place of what they are over.  percent_row, percent_column and percent_all are
    the counts' shares of their row, of their column, and of all.
    """
    level = F.element_at(F.array(*[F.lit(x) for x in ("cell", "row", "column", "all")]), F.grouping_id().cast("int") + 1)
    cube = data.cube(row.alias("row"), column.alias("column")).agg(F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()], level.alias("level"))
    of = lambda by, total: F.max(F.when(F.col("level") == total, F.col("n"))).over(Window.partitionBy(by))
    every = cube.where("level = 'all'").select(F.col("n").alias("__all"))
    share = lambda c: (100.0 * F.col("n") / c)
    shares = cube.withColumns({"__row": of("row", "row"), "__column": of("column", "column")}).join(F.broadcast(every), F.lit(True))
    in_row, in_column = F.col("level").isin("cell", "row"), F.col("level").isin("cell", "column")
    shares = shares.withColumns({"percent_row": F.when(in_row, share(F.col("__row"))), "percent_column": F.when(in_column, share(F.col("__column"))), "percent_all": share(F.col("__all"))})
    return shares.select("level", "row", "column", "n", *measures, "percent_row", "percent_column", "percent_all")


def crosstab(s: Summary, data: DataFrame) -> DataFrame:
    """Counts and shares by two fields, or measures of the second by the first.

    Of the first field's options, percent is the share within the row; of the
    second's, within the column (percent_2).  The option totals gives all totals
    and shares, with mean, min and max of the second field where asked for.
    """
    x, y = F.col(s.field), F.col(s.field_2)
    both, a, b = data.where(x.isNotNull()), x.cast("string"), y.cast("string")
    if s.bins:
        both, a = binned(both, x.try_cast("double"), s.bins, "__a"), F.col("__a").cast("string")
    measures = {k: f(y.try_cast("double")) for k, f in MEASURES.items() if s.has(k)}
    if measures and not s.has("totals"):
        return both.groupBy(a.alias("row")).agg(*[m.alias(k) for k, m in measures.items()])
    both = both.where(y.isNotNull())
    if s.bins_2:
        both, b = binned(both, y.try_cast("double"), s.bins_2, "__b"), F.col("__b").cast("string")
    if s.has("totals"):
        return crosstab_totals(both, a, b, measures)
    counts = both.groupBy(a.alias("row"), b.alias("column")).agg(F.count(F.lit(1)).alias("n"))
    within = lambda c: 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(c))
    if s.has("percent") or not s.has("count"):
        counts = counts.withColumn("percent", within("row"))
    if "percent" in [o.strip() for o in s.options_2.split(",")]:
        counts = counts.withColumn("percent_2", within("column"))
    return shown(s, counts)


def compile_summary(s: Summary, data: DataFrame) -> DataFrame:
    """The summary's result as a small DataFrame."""
    x = F.col(s.field)
    if s.exclusion:
        data = drop(data, s.field, s.exclusion)
    if s.type == "text":
        if s.has("top"):
            return top_values(data, x, s.bins or 10)
        t = x.cast("string")
        some = t.isNotNull() & (t != "")
        size = F.when(some, F.length(t))
        return data.agg(F.count_if(some).alias("n"), F.count_if(~F.coalesce(some, F.lit(False))).alias("blank"), F.countDistinct(F.when(some, t)).alias("n_distinct"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.avg(size).alias("mean_length"))
    if s.type == "categorical":
        return shown(s, categories(data, x))
    if s.type == "numeric":
        v = x.try_cast("double")
        if s.bins:
            shares = binned(data.select(v.alias("v")).where("v is not null"), F.col("v"), s.bins, "bin").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("from_value"), F.max("v").alias("to_value"))
            return shares
        measures = {"count": F.count(v).alias("n"), "mean": F.avg(v).alias("mean"), "min": F.min(v).alias("min"), "max": F.max(v).alias("max")}
        return data.agg(*([m for o, m in measures.items() if s.has(o)] or measures.values()))
    if s.type == "temporal":
        t = x.try_cast("timestamp")
        if s.bins:
            at = binned(data.select(F.unix_micros(t).alias("v")).where("v is not null"), F.col("v"), s.bins, "bin").groupBy("bin")
            return at.agg(F.count(F.lit(1)).alias("n"), F.timestamp_micros(F.min("v")).alias("from_time"), F.timestamp_micros(F.max("v")).alias("to_time"))
        unit = s.unit()
        at = F.date_trunc(unit, t) if unit else t
        return data.where(t.isNotNull()).groupBy(at.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    if s.type in ("geomap", "map"):
        p = geo.point(x.cast("string"))
        more = [F.col(s.field_2).alias("value")] if s.field_2 else []
        return data.select(p.alias("p"), *more).where("p is not null").select("p.lat", "p.lon", *(["value"] if more else []))
    if s.type == "binary":
        some = x.isNotNull() & (x.cast("string") != "")
        return data.agg(F.count_if(some).alias("present"), F.count_if(~F.coalesce(some, F.lit(False))).alias("missing"))
    y = F.col(s.field_2)
    if s.type == "scatterplot":
        pairs = data.select(x.try_cast("double").alias("x"), y.try_cast("double").alias("y")).where("x is not null and y is not null")
        if s.has("best_fit_line"):
            return pairs.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
        return pairs
    if s.type == "crosstab":
        return crosstab(s, data)
    if s.type == "trend":
        t = y.try_cast("timestamp")
        none = "none" in [o.strip() for o in f"{s.options},{s.options_2}".split(",")]
        unit = s.unit() or s.unit(s.options_2) or "day"
        v = x.try_cast("double")
        asked = {k: f for k, f in MEASURES.items() if s.has(k)} or {"mean": F.avg}
        return data.where(t.isNotNull()).groupBy((t if none else F.date_trunc(unit, t)).alias("period")).agg(F.count(v).alias("n"), *[f(v).alias(k) for k, f in asked.items()])
    raise ValueError(s.type)


def compile_workbook(book: Workbook, data: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame for each summary, by number and field; they share the filtered base."""
    rows = base(book, data)
    return {f"{k + 1}:{s.field}": compile_summary(s, rows) for k, s in enumerate(book.summaries)}
