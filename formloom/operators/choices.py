"""Choice lists: cascading filters, order, randomisation, mixtures of static and dynamic choices."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expressions.compiler import Scope, Value, predicate
from ..functions.text import keyed_hash


def cascading(choices: list[dict], choice_filter: str, scope: Scope) -> Column:
    """The choices (value, label) whose rows pass the filter, in list order, as an array.

    A list is a form's metadata, so each row is a constant and the filter's bare
    names are its cells; no join, and rows that cannot pass fold away.
    """
    rows = []
    for c in choices:
        own = Scope(**{**scope.__dict__, "columns": {k: Value(F.lit(v).cast("string"), "string", v) for k, v in c.items()}})
        rows.append(F.when(predicate(choice_filter, own), F.struct(F.lit(c.get("value")).alias("value"), F.lit(c.get("label")).alias("label"))))
    return F.filter(F.array(*rows), lambda x: x.isNotNull()) if rows else F.array().cast("array<struct<value:string,label:string>>")


def cascading_rows(submissions: DataFrame, choices: DataFrame, on: Column, key: str, order: str, value: str, delimiter: str = " ") -> DataFrame:
    """The same for large choice tables: a join (equality in ``on`` makes it a hash join), values joined in list order."""
    joined = submissions.join(choices, on, "left")
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))))
    return joined.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["v"].cast("string")), delimiter).alias("choices"))


def randomized(values: Column, seed: Column, fixed_top: int = 0, fixed_bottom: int = 0) -> Column:
    """The values in an order set by the seed; the first and last ones stay where they are."""
    n = F.size(values)
    middle = F.slice(values, fixed_top + 1, F.greatest(n - fixed_top - fixed_bottom, F.lit(0)))
    mixed = F.transform(F.array_sort(F.transform(middle, lambda v: F.struct(keyed_hash(seed.cast("string"), v.cast("string")).alias("h"), v.alias("v")))), lambda x: x["v"])
    return F.concat(F.slice(values, 1, fixed_top), mixed, F.slice(values, F.greatest(n - fixed_bottom, F.lit(fixed_top)) + 1, fixed_bottom))


def randomized_by(appearance: str) -> tuple[int, int, bool] | None:
    """randomized, (x,y), (seed), (seed,x,y): values fixed at top and bottom, and whether a seed is named."""
    m = re.search(r"\brandomized(?:\(([^)]*)\))?", appearance)
    if not m:
        return None
    args = [a.strip() for a in (m[1] or "").split(",") if a.strip()]
    seeded = len(args) in (1, 3)
    top, bottom = (int(a) for a in args[-2:]) if len(args) >= 2 else (0, 0)
    return top, bottom, seeded


def sorted_by(choices: DataFrame, sortby: str, source_order: str) -> DataFrame:
    """Numeric order of dynamic choices; rows of one number stay in source order."""
    return choices.orderBy(F.col(sortby).try_cast("double").asc_nulls_last(), source_order)


def mixed(before: DataFrame, dynamic: DataFrame, after: DataFrame) -> DataFrame:
    """Static choices around the dynamic ones: (part, place, value, label); static values must be numbers."""
    part = lambda df, k: df.select(F.lit(k).alias("part"), "place", F.col("value").cast("string").alias("value"), "label")
    static = lambda df: df.where(F.col("value").try_cast("double").isNotNull())
    return part(static(before), 0).unionByName(part(dynamic, 1)).unionByName(part(static(after), 2))
