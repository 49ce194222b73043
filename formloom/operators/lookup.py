"""Lookups and searches in pre-loaded data.

pulldata() becomes a left join with the source reduced to one row a key.
Lookups of several columns by the same source, key column and value share one
join.  The reduced source is broadcast by Spark only where it knows it to be
small; otherwise the join shuffles.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..expressions.compiler import Scope, compile_expr
from ..expressions.syntax import Call, Expr, Literal, parse, print_expr, walk
from ..functions.text import empty_text


def place_in_source(source: DataFrame) -> Column:
    """A row's place: file, block and row for rows read from files, whatever tasks the blocks go to; else partition and row."""
    place = ["_metadata.file_path", "_metadata.file_block_start"]
    try:
        source.select(*place)
    except AnalysisException:  # not rows of files
        place = []
    return F.struct(*place, F.monotonically_increasing_id())


def first_by_key(source: DataFrame, key: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a key: the first by ``order``, or in source order; blank keys match nothing."""
    rows = source.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    rows = rows.withColumn("__at", F.struct(*[F.col(o) for o in order]) if order else place_in_source(rows))
    picked = F.min_by(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), "__at")
    return rows.groupBy(F.col(key).cast("string").alias("__key")).agg(picked.alias("__row")).select("__key", "__row.*")


class Pulled:
    """Joins what the expressions pull, one join for each (source, key column, value)."""

    def __init__(self, sources: dict[str, DataFrame], order: dict[str, list[str]] | None = None):
        self.sources, self.order = sources, order or {}

    def join(self, df: DataFrame, expressions: list[str | Expr], scope: Scope) -> tuple[DataFrame, Scope]:
        """df with the pulled columns, and a scope in which pulldata() reads them."""
        wanted: dict[tuple[str, str, str], tuple[Expr, set[str]]] = {}
        for e in expressions:
            for n in walk(parse(e) if isinstance(e, str) else e):
                if isinstance(n, Call) and n.name == "pulldata":
                    source, column, lookup = (a.value for a in n.args[:3] if isinstance(a, Literal))
                    wanted.setdefault((source, lookup, print_expr(n.args[3])), (n.args[3], set()))[1].add(column)
        places: dict[tuple[str, str, str], int] = {}
        for k, ((source, lookup, shown), (value, columns)) in enumerate(sorted(wanted.items(), key=lambda x: x[0])):
            table = first_by_key(self.sources[source], lookup, sorted(columns), self.order.get(source))
            table = table.select(F.col("__key").alias(f"__k{k}"), *[F.col(c).alias(f"__p{k}_{c}") for c in sorted(columns)])
            at = compile_expr(value, scope).string()
            df = df.withColumn(f"__v{k}", at)
            df = df.join(table, F.col(f"__v{k}") == F.col(f"__k{k}"), "left").drop(f"__v{k}", f"__k{k}")
            places[source, lookup, shown] = k
        pulled = lambda s, c, lk, v: F.col(f"__p{places[s, lk, print_expr(v)]}_{c}")
        return df, replace(scope, pulled=pulled)


_TESTS = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith, "matches": lambda a, b: a == b}


def search_test(kind: str, columns: str, text: Column, of: DataFrame | None = None) -> Column:
    """Whether any of the comma-separated columns passes."""
    out = None
    for name in columns.split(","):
        c = (of[name.strip()] if of is not None else F.col(name.strip())).cast("string")
        one = _TESTS[kind](empty_text(c), text)
        out = one if out is None else out | one
    return out


def search(source: DataFrame, value: str, labels: str, kind: str | None = None, columns: str | None = None, text: str | Column | None = None, filter_column: str | None = None, filter_text: str | Column | None = None) -> DataFrame:
    """search(): the distinct choices (value, label); several label columns are joined by a space."""
    rows = source
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    if kind:
        rows = rows.where(search_test(kind, columns, lit(text)))
    if filter_column:
        rows = rows.where(F.col(filter_column).cast("string") == lit(filter_text))
    label = F.concat_ws(" ", *[F.col(c.strip()).cast("string") for c in labels.split(",")])
    return rows.select(F.col(value).cast("string").alias("value"), label.alias("label")).distinct()


def parse_search(appearance: str) -> list[Expr] | None:
    """The arguments of search() in an appearance (source, kind, columns, text, filter column, filter text), or None."""
    at = appearance.find("search(")
    if at < 0:
        return None
    depth, quote = 0, ""
    for k in range(at, len(appearance)):
        c = appearance[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return list(parse(appearance[at : k + 1]).args)
    raise ValueError(f"search( is not closed in {appearance!r}")


def search_by(appearance: str, sources: dict[str, DataFrame], value: str, labels: str) -> DataFrame:
    """search() as written in an appearance, where its texts are constants."""
    args = [a.value for a in parse_search(appearance)]
    return search(sources[args[0]], value, labels, *args[1:])


def search_each(submissions: DataFrame, source: DataFrame, key: str, kind: str, columns: str, text: Column, value: str) -> DataFrame:
    """search() for every submission's own text: (key, value), distinct.

    "matches" is an equality, so it joins by it, once for each column searched.
    The other kinds join by one too, and test the pairs that it leaves:
    "startswith" and "endswith" by the ends of each length that is asked for,
    "contains" by the first three characters of the text (fewer, if it is
    shorter; a blank text is in every row).  Only distinct texts are joined.
    """
    texts = submissions.select(key, text.alias("__text"))
    if kind == "matches":
        parts = [source.select(F.col(c.strip()).cast("string").alias("__text"), F.col(value).cast("string").alias("value")) for c in columns.split(",")]
        index = parts[0]
        for p in parts[1:]:
            index = index.unionByName(p)
        return texts.join(index.distinct(), "__text").select(key, "value").distinct()
    asked = texts.where(F.col("__text").isNotNull()).select("__text").distinct()
    size = F.length("__text") if kind != "contains" else F.least(F.length("__text"), F.lit(3))
    sizes = asked.select(size.alias("n")).agg(F.collect_set("n").alias("__sizes"))  # one row
    cells = source.select(F.col(value).cast("string").alias("value"), F.explode(F.array(*[empty_text(F.col(c.strip()).cast("string")) for c in columns.split(",")])).alias("__cell")).distinct()
    cells = cells.join(F.broadcast(sizes), F.lit(True)).select("value", "__cell", F.explode("__sizes").alias("n")).where(F.length("__cell") >= F.col("n"))
    cell, n = F.col("__cell"), F.col("n")
    if kind == "contains":
        grams = F.when(n == 0, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(cell) - n + 1, F.lit(1))), lambda k: F.substring(cell, k, n)))
        cells = cells.select("value", "__cell", F.explode(F.array_distinct(grams)).alias("__part"), "n")
    else:
        cells = cells.select("value", "__cell", (F.substring(cell, F.lit(1), n) if kind == "startswith" else F.substring(cell, F.length(cell) - n + 1, n)).alias("__part"), "n")
    asked = asked.select("__text", F.substring("__text", F.lit(1), size).alias("__part"), size.alias("n"))
    hits = asked.join(cells, ["n", "__part"]).where(_TESTS[kind](cell, F.col("__text"))).select("__text", "value").distinct()
    return texts.join(hits, "__text").select(key, "value").distinct()


def merged_workbook(base: DataFrame, dataset: DataFrame, key: str, columns: list[str], order: list[str] | None = None) -> DataFrame:
    """Columns of a server dataset beside summaries' rows."""
    table = first_by_key(dataset, key, columns, order)
    return base.join(table, base[key].cast("string") == table["__key"], "left").drop("__key")


def first_rows(source: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All columns of the first row a key, in a given order."""
    return source.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
