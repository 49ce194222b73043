"""The most frequent values, exactly, in bounded memory.

One aggregation keeps a mergeable frequent-items summary (Misra-Gries counters)
of the values' digests: tasks summarise what they read, summaries are merged,
and no distinct value is shuffled.  The candidates it returns are recounted
exactly by a second pass that drops all other rows before its shuffle.  A
summary of n values misses none that occurs more than ``3.5 * n / counters``
times, so the k-th candidate's exact count tells whether the answer is certain.
Where it is not (values that hardly repeat), digests are counted in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that a summary tracks, and counters that this gives it: the next power of two of 4/3 as many.
TRACKED, COUNTERS = 10_000, 16_384
_ERROR = 3.5


def candidates(values: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(digest) of at most ``tracked`` values of the column digest, all of those that are frequent."""
    found = values.agg(F.expr(f"approx_top_k(digest, {tracked}, {tracked})").alias("found"))
    return found.select(F.explode("found").alias("f")).select(F.col("f.item").alias("digest"))


def top_values(data: DataFrame, value: Column, k: int = 10, tracked: int = TRACKED) -> DataFrame:
    """(value, n, percent) of the k most frequent values that are not blank, ties by value; percent is of those not blank."""
    text = value.cast("string")
    rows = data.where(text.isNotNull() & (text != "")).select(text.alias("value"))
    digests = rows.select(F.md5("value").alias("digest"))
    few = candidates(digests, tracked).withColumnRenamed("digest", "of")
    hits = rows.withColumn("digest", F.md5("value")).join(F.broadcast(few), F.col("digest") == F.col("of"))  # at most ``tracked`` digests
    counted = hits.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    best = [r[0] for r in counted.orderBy(F.desc("n")).limit(k).select("n").collect()]
    all_seen = total and counted.agg(F.sum("n")).first()[0] == total
    counters = 1 << max(1, -(-tracked * 4 // 3) - 1).bit_length()
    sure = all_seen or (len(best) == k and best[-1] > _ERROR * total / counters)
    counts = counted if sure else digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return _named(rows, counts, k, total)


def _named(rows: DataFrame, counts: DataFrame, k: int, total: int) -> DataFrame:
    """The values of the best digests. Values of the k-th count are all fetched, for ties go by value."""
    least = counts.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("least"))
    best = counts.join(F.broadcast(least), F.col("n") >= F.col("least")).select(F.col("digest").alias("of"), "n")
    found = rows.join(best, F.md5("value") == F.col("of")).groupBy("of", "n").agg(F.min("value").alias("value"))
    return found.select("value", "n", (F.lit(100.0) * F.col("n") / F.lit(max(1, total))).alias("percent")).orderBy(F.desc("n"), "value").limit(k)
