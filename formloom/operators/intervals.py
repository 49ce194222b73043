"""Which intervals hold which points, by equality on cells.

An interval belongs to the level whose cells, of a power of two, are at least as
long as it is: it touches two cells of that level at most.  A point looks up its
own cell on each level that is in use, of which there are no more than bits in
the longest interval.  What meets in a cell is tested exactly; a cell is under
four times as long as its intervals, so few of these tests fail.  A cell that
many points meet in is an ordinary hot key of an equi-join, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def containing(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Pairs of a point and an interval with low < at < high (whole numbers); columns of both, which must differ in name."""
    level = F.ceil(F.log2((F.col(high) - F.col(low)).cast("double"))).cast("int")
    cells = lambda name: F.expr(f"shiftright(cast(`{name}` as bigint), __level)")
    held = intervals.where(F.col(high) - F.col(low) > 1).withColumn("__level", level)
    spans = held.withColumn("__cell", F.explode(F.array_distinct(F.array(cells(low), cells(high)))))
    levels = sorted(r[0] for r in held.select("__level").distinct().collect())  # at most 63
    looked = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("__cell", cells(at))
    both = looked.join(spans, ["__level", "__cell"])
    return both.where((F.col(low) < F.col(at)) & (F.col(at) < F.col(high))).drop("__level", "__cell")
