"""Ranked text search over a table of texts (BM25), all in DataFrame operations.

Terms are letter and digit runs in lower case.  The corpus needs two numbers
(rows, mean length) and a count for each query term; rows without any query
term are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75  # the customary constants
DEFAULT, MOST = 5, 20  # fixed values: hits by default and at most


def _times(term: str) -> Column:
    return F.size(F.filter("w", lambda w: w == term))


def query_terms(query: str) -> list[str]:
    terms = sorted({t for t in "".join(c.lower() if c.isalnum() else " " for c in query).split()})
    if not terms:
        raise ValueError("no term to search for")
    return terms


def words(text: str) -> Column:
    """The terms of a text, in order."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def search(texts: DataFrame, key: str, text: str, query: str, top_k: int = DEFAULT) -> DataFrame:
    """(key, score) of the best rows; ties go to the smaller key."""
    if not 0 < top_k <= MOST:
        raise ValueError(f"top_k is 1 to {MOST}")
    terms = query_terms(query)
    rows = texts.select(F.col(key).alias("key"), words(text).alias("w")).select("key", F.size("w").alias("size"), *[_times(t).alias(f"n{k}") for k, t in enumerate(terms)])
    found = [F.count_if(F.col(f"n{k}") > 0).alias(f"df{k}") for k in range(len(terms))]
    corpus = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg("size").alias("mean"), *found)
    some = F.greatest(*[F.col(f"n{k}") for k in range(len(terms))], F.lit(0)) > 0
    joined = rows.where(some).join(F.broadcast(corpus), F.lit(True))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        n, df = F.col(f"n{k}"), F.col(f"df{k}")
        score = score + F.ln(1 + (F.col("rows") - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return joined.select(F.col("key").alias(key), score.alias("score")).orderBy(F.desc("score"), key).limit(top_k)
