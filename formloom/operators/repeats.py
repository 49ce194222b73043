"""Repeat groups as arrays of structs, and their long and wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import numbers_within


def nest(parents: DataFrame, instances: DataFrame, key: str, foreign: str, order: list[str], members: dict[str, str], name: str) -> DataFrame:
    """parents with the array column ``name`` of their instances, in ``order``; parents without any get an empty array.

    members: member name: column of instances.
    """
    row = F.struct(*[F.col(o).alias(f"__o{k}") for k, o in enumerate(order)], *[F.col(c).alias(m) for m, c in members.items()])
    grouped = instances.groupBy(F.col(foreign).alias("__key")).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    kept = F.transform("__rows", lambda x: F.struct(*[x[m].alias(m) for m in members]))
    joined = parents.join(grouped, parents[key] == F.col("__key"), "left")
    return joined.select(*[parents[c] for c in parents.columns], F.coalesce(kept, F.array()).alias(name))


def long_form(df: DataFrame, key: str, repeat: str) -> DataFrame:
    """A row for each instance with its number from 1; submissions without any have one row of blanks."""
    return df.select(key, F.posexplode_outer(repeat).alias("index", "__x")).select(key, (F.col("index") + 1).alias("index"), "__x.*")


def long_rows(parents: DataFrame, instances: DataFrame, key: str, foreign: str, order: list[str], members: dict[str, str]) -> DataFrame:
    """The same from instances that arrive as rows: numbered by ranges and joined, never gathered by submission. members: name: column."""
    numbered_rows = numbers_within(instances.select(foreign, *dict.fromkeys([*order, *members.values()])), [foreign], order, "__index")
    held = numbered_rows.select(F.col(foreign).alias("__of"), F.col("__index").cast("int").alias("index"), *[F.col(c).alias(m) for m, c in members.items()])
    return parents.select(key).join(held, F.col(key) == F.col("__of"), "left").select(key, "index", *members)


def wide_form(df: DataFrame, repeat: str, member: str, most: int) -> DataFrame:
    """Columns member_1 ... member_n in place of the array; no shuffle, since the array is at hand."""
    rest = [c for c in df.columns if c != repeat]
    return df.select(*rest, *[F.get(F.col(repeat), F.lit(k))[member].alias(f"{member}_{k + 1}") for k in range(most)])


def pivot_wide(rows: DataFrame, key: str, index: Column, values: dict[str, str], most: int) -> DataFrame:
    """The same from long rows: one aggregation, a column for each index up to ``most``."""
    return rows.groupBy(key).agg(*[F.max(F.when(index == k, F.col(c))).alias(f"{n}_{k}") for n, c in values.items() for k in range(1, most + 1)])


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "index") -> DataFrame:
    """index() of long rows."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def rank_long(rows: DataFrame, key: str, value: Column, index: Column, where: Column | None = None) -> Column:
    """rank-index(-if) of long rows: highest is 1, ties by index; 999 where value is no number or ``where`` fails."""
    ok = value.isNotNull() if where is None else value.isNotNull() & F.coalesce(where, F.lit(False))
    by = Window.partitionBy(key, ok).orderBy(value.desc(), index)
    return F.when(ok, F.row_number().over(by)).otherwise(F.lit(999))


def counted(repeat: Column, n: Column) -> Column:
    """The array with exactly n instances (repeat_count): cut, or filled with blank ones."""
    rows = F.coalesce(repeat, F.array())
    want = F.greatest(F.coalesce(n.cast("int"), F.lit(0)), F.lit(0))
    return F.when(want == 0, F.slice(rows, 1, 0)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(want, F.lit(1))), lambda i: F.get(rows, i - 1)))
