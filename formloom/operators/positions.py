"""Positions and running sums of a whole order, without one task that sees all rows.

Rows are dealt by ranges of the order, sorted within each range and stored with
the range's number and their place in it.  What lies before a range is then one
number a range: the sums of the ranges before it.  Only those numbers, two or
three a partition, are gathered; they come back as a broadcast of that size.

A group of any size is split like all else, since the order within the group is
part of what ranges are dealt by.  Rows that the order cannot tell apart stay in
one range, so an order should end in something that differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

PART, AT = "__range", "__range_at"
_PLACES = (1 << 33) - 1  # Spark's ids have the partition above the lowest 33 bits


def in_order(df: DataFrame, order: list[Column | str], what: str = "ordered", partitions: int | None = None, folders: bool = False) -> DataFrame:
    """df dealt and sorted by ``order`` and stored (a folder a range, if asked for), with the number of the range and the place in it from 0."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    at, part = F.col("__id").bitwiseAND(F.lit(_PLACES)).alias(AT), F.shiftrightunsigned("__id", 33).cast("int").alias(PART)
    return stored(dealt.select(*df.columns, at, part), what, PART if folders else None)


def _before(placed: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """A row a range: what all ranges before it hold; as many rows as ranges are summed on the driver."""
    held = sorted(placed.groupBy(PART).agg(*[c.alias(f"__b_{n}") for n, c in sums.items()]).collect())
    so_far, rows = [0] * len(sums), []
    for part, *own in held:
        rows.append((part, *so_far))
        so_far = [a + (b or 0) for a, b in zip(so_far, own, strict=True)]
    kinds = [f"__b_{n} {'double' if any(isinstance(r[k], float) for r in rows) else 'bigint'}" for k, n in enumerate(sums, 1)]
    as_kind = [(r[0], *(float(x) if k.endswith("double") else x for x, k in zip(r[1:], kinds, strict=True))) for r in rows]
    return placed.sparkSession.createDataFrame(as_kind, ", ".join(["__of int", *kinds]))


def _with(placed: DataFrame, before: DataFrame) -> DataFrame:
    return placed.join(F.broadcast(before), placed[PART] == before["__of"])  # a row a range


def row_numbers(df: DataFrame, order: list[Column | str], name: str = "n", start: int = 1, partitions: int | None = None) -> DataFrame:
    """df with the place of each row in the whole order."""
    placed = in_order(df, order, partitions=partitions)
    both = _with(placed, _before(placed, {"n": F.count(F.lit(1))}))
    return both.select(*df.columns, (F.col(AT) + F.col("__b_n") + start).alias(name))


def running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with running totals over the whole order, each row's own included."""
    values = {f"__v_{n}": c for n, c in sums.items()}
    placed = in_order(df.withColumns(values), order, partitions=partitions)
    both = _with(placed, _before(placed, {n: F.sum(f"__v_{n}") for n in sums}))
    here = Window.partitionBy(PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    return both.select(*df.columns, *[(F.sum(f"__v_{n}").over(here) + F.col(f"__b_{n}")).alias(n) for n in sums])


def numbers_within(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "n", partitions: int | None = None) -> DataFrame:
    """df with each row's number from 1 within its key, by ``order``; one key may fill any number of ranges.

    A range counts its own rows of a key. What a key has in earlier ranges is
    not zero for the first key of a range alone, so it is a row a range.
    """
    placed = in_order(df, [*keys, *order], partitions=partitions)
    counts = placed.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__more", F.sum("__n").over(earlier)).where("__more > 0").select(F.col(PART).alias("__of"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__more")
    same = placed[PART] == before["__of"]
    for i, k in enumerate(keys):
        same = same & placed[k].eqNullSafe(before[f"__k{i}"])
    both = placed.join(F.broadcast(before), same, "left")  # at most a row a range
    own = F.row_number().over(Window.partitionBy(PART, *keys).orderBy(AT))
    return both.select(*df.columns, (own + F.coalesce("__more", F.lit(0))).cast("bigint").alias(name))
