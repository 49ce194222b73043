"""Ranked text search through an inverted index, with pruning by block maxima.

``text_search.search`` reads every text for every query.  The index is built
once: a posting for each term of each text with its BM25 impact, in order of
term and block (texts are dealt to blocks by a hash of their key), and for each
term and block the greatest impact.  A query adds up the maxima of its terms for
each block; no text of a block scores higher than that.  Postings are read block
by block in descending order of these bounds, until the k-th best score found is
above the next bound: the answer is exact, and most postings are never read.
"""

from __future__ import annotations

from math import log1p

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .text_search import B, DEFAULT, K1, MOST, query_terms, words

#: Texts of a block, about; blocks read at first.
BLOCK, FIRST = 2048, 16


class TextIndex:
    def __init__(self, texts: DataFrame, key: str, text: str, block: int = BLOCK):
        self.key = key
        rows = texts.select(F.col(key).alias("key"), words(text).alias("w"))
        self.rows, mean = rows.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
        blocks = max(1, -(-self.rows // block))
        size = rows.select("key", F.size("w").alias("size"), F.explode("w").alias("term")).groupBy("key", "size", "term").agg(F.count(F.lit(1)).alias("n"))
        impact = F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
        posts = size.select("term", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", impact.alias("impact"))
        tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.postings = stored(posts.repartitionByRange(tasks, "term", "block").sortWithinPartitions("term", "block"), "postings")
        maxima = self.postings.groupBy("term", "block").agg(F.max("impact").alias("most"), F.count(F.lit(1)).alias("texts"))
        self.maxima = stored(maxima.repartitionByRange(tasks, "term", "block").sortWithinPartitions("term", "block"), "maxima")

    def search(self, query: str, top_k: int = DEFAULT) -> DataFrame:
        """(key, score) of the best texts; ties go to the smaller key."""
        if not 0 < top_k <= MOST:
            raise ValueError(f"top_k is 1 to {MOST}")
        terms = query_terms(query)
        mine = self.maxima.where(F.col("term").isin(terms))
        found = dict(mine.groupBy("term").agg(F.sum("texts")).collect())  # a number a term of the query
        weight = F.lit(0.0)
        for term, n in sorted(found.items()):
            weight = F.when(F.col("term") == term, log1p((self.rows - n + 0.5) / (n + 0.5))).otherwise(weight)
        bounds = mine.groupBy("block").agg(F.sum(weight * F.col("most")).alias("bound"))
        width = FIRST
        while True:
            top = bounds.orderBy(F.desc("bound"), "block").limit(width + 1).collect()
            here = F.col("term").isin(terms) & F.col("block").isin([r["block"] for r in top[:width]])
            scored = self.postings.where(here).groupBy("key").agg(F.sum(weight * F.col("impact")).alias("score"))
            best = scored.orderBy(F.desc("score"), "key").limit(top_k).select(F.col("key").alias(self.key), "score")
            if len(top) <= width:
                return best
            scores = [r["score"] for r in best.select("score").collect()]
            if len(scores) == top_k and scores[-1] > top[width]["bound"] * (1 + 1e-9):
                return best
            width *= 8
