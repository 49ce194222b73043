"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits at the median of a random projection.  The trees are fitted on a
bounded sample (at most about ``sample`` rows, chosen by a hash of id and
vector) and are as deep as the table asks for: leaves of ``leaf_rows`` rows, as
far as the sample can place their splits.  Every row is then dealt to one leaf
of each tree.  A query goes down all trees at once: one priority queue, shared
by the trees, holds the branches not taken, by their distance from the query;
leaves are visited in its order.  Candidates in visited leaves are ranked by
the exact distance on the original vectors.

How many leaves are visited is not fixed but measured: for at most ``probes``
queries the true neighbours among all rows are found, and the visits are the
fewest that meet ``recall`` of them.  So vectors without structure, where no
index helps (uniform directions in 64 dimensions need two thirds of the rows as
candidates), get what they need, and structured ones do with much less.

A leaf's rows stay in blocks of bounded size (a leaf full of copies is just
more blocks), once for each tree; queries are sent to the blocks and stream
past the rows, so no row is copied for queries however many there are.  Each
block returns its best ``k`` for a query, and the last step merges those.

Defined results: rows whose id is null, or whose vector is null, zero, of
another length than the table's most frequent (of equally frequent ones the
shorter), or holds a null or non-finite component, take no part; ties go to the
smaller id; a repeated id counts once, at its smaller distance; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_io import bound_batches

#: Rows of a leaf in one block, and queries compared with it at once.
ROW_BLOCK, QUERIES = 16_384, 256


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls and of one length as an n x d array of doubles."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def vector_salt(x: np.ndarray) -> np.ndarray:
    """A hash of each row's components."""
    weights = np.random.default_rng(0).integers(0, 1 << 63, x.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.ascontiguousarray(x).view(np.uint64)
    return ((bits ^ bits >> np.uint64(29)) * weights).sum(axis=1, dtype=np.uint64)


class Forest:
    """Trees as arrays: projection, threshold, and the two children (a leaf has its number below zero)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.planes, self.cuts, self.children, self.roots, self.n_leaves = [], [], [], [], 0
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng))
        self.planes = np.array(self.planes).reshape(len(self.cuts), sample.shape[1])

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        if len(rows) > leaf:
            w = rng.standard_normal(x.shape[1])
            w /= np.linalg.norm(w)
            p = x[rows] @ w
            cut = float(np.median(p))
            low = p <= cut
            if not low.all():
                me = len(self.cuts)
                self.planes.append(w)
                self.cuts.append(cut)
                self.children.append(None)
                self.children[me] = self._grow(x, rows[low], leaf, rng), self._grow(x, rows[~low], leaf, rng)
                return me
        self.n_leaves += 1
        return -self.n_leaves

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """For each row and tree, the leaf (from 1)."""
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if node < 0:
                    out[rows, t] = -node
                elif len(rows):
                    low = x[rows] @ self.planes[node] <= self.cuts[node]
                    todo += [(self.children[node][0], rows[low]), (self.children[node][1], rows[~low])]
        return out

    def visit(self, q: np.ndarray, n: int) -> list[int]:
        """The first n leaves (from 1) of the shared queue."""
        side = self.planes @ q - self.cuts if len(self.cuts) else np.zeros(0)
        queue, found = [(0.0, root) for root in self.roots], []
        heapq.heapify(queue)
        while queue and len(found) < n:
            far, node = heapq.heappop(queue)
            while node >= 0:
                s = float(side[node])
                near, away = self.children[node] if s <= 0 else self.children[node][::-1]
                heapq.heappush(queue, (max(far, abs(s)), away))
                node = near
            found.append(-node)
        return found


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: id, and the k nearest other ids with their exact distances; of an id's rows the nearest counts."""
    rough = (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
    rough[q_ids[:, None] == ids[None, :]] = np.inf
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0]) if len(ids) else np.zeros(0, np.int64)
    least = rough if len(starts) == len(ids) else np.minimum.reduceat(rough[:, by_id], starts, axis=1)
    for row, low, one, me in zip(rough, least, q, q_ids, strict=True):
        if len(low) > k:
            edge = np.partition(low, k - 1)[k - 1]
            near = np.flatnonzero(row <= edge + 1e-9 * (1 + abs(edge) + one @ one))
        else:
            near = np.arange(len(row))
        near = near[ids[near] != me]
        d = np.sqrt(((x[near] - one) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], d))
        order = order[np.sort(np.unique(ids[near][order], return_index=True)[1])][:k]
        yield int(me), ids[near][order], d[order]


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The first place of each different (id, vector), ascending: exact copies add nothing."""
    whole = np.ascontiguousarray(np.column_stack([ids.view(np.float64), x]))
    return np.sort(np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_index=True)[1])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The rows (id, v) that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0))


def true_neighbours(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int, forest: Forest) -> list:
    """(query_id, leaves of the neighbour in each tree) of the k nearest among all rows, for a bounded number of queries."""
    spark = rows.sparkSession
    asked, trees = spark.sparkContext.broadcast((q_ids, q)), spark.sparkContext.broadcast(forest)

    def each(batches) -> Iterator[pa.RecordBatch]:
        (of, points), kept, held = asked.value, None, []

        def merge(kept):
            ids, x = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            if kept is not None:
                ids, x = np.concatenate([kept[0], ids]), np.concatenate([kept[1], x])
            got = list(best(points, of, x, ids, k))
            # only rows that are near some query go on
            near = np.isin(ids, np.unique(np.concatenate([g[1] for g in got]))) if got else np.zeros(len(ids), bool)
            return (ids[near][(one := distinct_rows(ids[near], x[near]))], x[near][one]) if near.any() else None

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), matrix(batch.column(1))))
                if sum(len(h[0]) for h in held) >= ROW_BLOCK:
                    kept, held = merge(kept), []
        if held:
            kept = merge(kept)
        if kept is None:
            return
        ids, x = kept
        at = trees.value.leaves(x)
        for me, point in zip(of, points, strict=True):
            d = np.sqrt(((x - point) ** 2).sum(axis=1))
            order = np.lexsort((ids, d))
            order = order[ids[order] != me]
            order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), me)), pa.array(ids[order]), pa.array(d[order]), pa.array(at[order].tolist(), pa.list_(pa.int64()))], names=["query_id", "vec_id", "score", "leaves"])

    found = rows.mapInArrow(each, "query_id bigint, vec_id bigint, score double, leaves array<bigint>")
    found = found.groupBy("query_id", "vec_id").agg(F.min_by("leaves", "score").alias("leaves"), F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "leaves").collect()


def visits_for(rows: DataFrame, forest: Forest, k: int, every: int, probes: int, recall: float) -> int:
    """The fewest leaf visits that meet ``recall`` of the true neighbours of at most ``probes`` queries."""
    some = rows.where(F.col("id") % every == 0).orderBy(F.xxhash64("id", "v"), "id").limit(probes).toArrow()
    q_ids, q = some.column("id").to_numpy(), matrix(some.column("v").combine_chunks())
    q_ids, first = np.unique(q_ids, return_index=True)
    q = q[first]
    if not len(q):
        return 1
    place = {}
    for me, point in zip(q_ids.tolist(), q, strict=True):
        place[me] = np.zeros(forest.n_leaves + 1, np.int64)
        place[me][forest.visit(point, forest.n_leaves)] = np.arange(1, forest.n_leaves + 1)
    need = sorted(int(place[r["query_id"]][r["leaves"]].min()) for r in true_neighbours(rows, q_ids, q, k, forest))
    return need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)] if need else 1


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, trees: int = 4, recall: float = 0.96, probes: int = 128, sample: int = 65_536, leaf_rows: int = 1024, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose id is divisible by ``every``, against all rows.

    The driver gets the sample, the neighbours of ``probes`` queries and a
    count for each leaf; what is broadcast is the forest (at most a split for
    16 rows of the sample), those queries and the counts: all of a size set by
    the parameters.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["v"].dataType.simpleString()
    lengths = sorted(((-r["n"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()))
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    total, dim = -lengths[0][0], lengths[0][1]
    rows = rows.where(F.size("v") == dim)
    drawn = rows
    if total > sample:
        drawn = rows.where(F.shiftrightunsigned(F.xxhash64("id", "v"), 33) < int(sample / total * 2**31))
    fit = matrix(drawn.distinct().limit(2 * sample).toArrow().column("v").combine_chunks()).reshape(-1, dim)
    fit = fit[np.lexsort(fit.T[::-1])] if len(fit) else fit
    leaf = max(32, -(-len(fit) * leaf_rows // max(total, 1)), 1)
    forest = Forest(fit, trees, min(leaf, max(32, len(fit) // 32)), seed)
    n_visit = visits_for(rows, forest, k, every, probes, recall)
    shared = spark.sparkContext.broadcast(forest)

    def count(batches) -> Iterator[pa.RecordBatch]:
        f = shared.value
        n = np.zeros(f.n_leaves + 1, np.int64)
        for batch in batches:
            if batch.num_rows:
                np.add.at(n, f.leaves(matrix(batch.column(1))).ravel(), 1)
        leaf_of = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(leaf_of), pa.array(n[leaf_of])], names=["leaf", "n"])

    parts = np.ones(forest.n_leaves + 1, np.int64)
    if total > ROW_BLOCK:  # else one block holds any leaf
        for r in rows.mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
            parts[r["leaf"]] = -(-r["n"] // ROW_BLOCK)
    blocks = spark.sparkContext.broadcast(parts)

    def deal(batches) -> Iterator[pa.RecordBatch]:
        f, part = shared.value, blocks.value

        def out(batch: pa.RecordBatch, which: np.ndarray, leaf: np.ndarray, block: np.ndarray, role: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(block), pa.array(np.full(len(leaf), role)), *batch.take(pa.array(which)).columns], names=["leaf", "block", "role", "id", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            first = distinct_rows(ids, x)
            batch, ids, x = batch.take(pa.array(first)), ids[first], x[first]
            # an id's rows are dealt to several blocks by their vectors
            salt = (vector_salt(x) ^ ids.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            salt = (salt >> np.uint64(33)).astype(np.int64)
            at, which = f.leaves(x).ravel(), np.repeat(np.arange(len(ids)), trees)
            yield out(batch, which, at, salt[which] % part[at], 0)
            for w in np.flatnonzero(ids % every == 0).tolist():
                leaf = np.repeat(seen := np.array(f.visit(x[w], n_visit)), part[seen])
                block = np.arange(len(leaf)) - np.repeat(np.cumsum(part[seen]) - part[seen], part[seen])
                yield out(batch, np.full(len(leaf), w), leaf, block, 1)

    met = rows.mapInArrow(deal, f"leaf bigint, block bigint, role bigint, id bigint, v {kind}").repartition("leaf", "block").sortWithinPartitions("leaf", "block", "role", "id")

    def search(batches) -> Iterator[pa.RecordBatch]:
        key, ids, x, held = None, None, None, []

        def rows_of() -> tuple[np.ndarray, np.ndarray]:
            if not held:
                return np.zeros(0, np.int64), np.zeros((0, dim))
            ids, x = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            return ids[(one := distinct_rows(ids, x))], x[one]

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            all_ids, points = batch.column("id").to_numpy(), matrix(batch.column("v"))
            for a, b in zip(cuts, cuts[1:]):
                if (now := tuple(keys[a, :2].tolist())) != key:
                    key, ids, held = now, None, []
                if keys[a, 2] == 0:
                    one = distinct_rows(all_ids[a:b], points[a:b])
                    held.append((all_ids[a:b][one], points[a:b][one]))
                    if sum(len(h[0]) for h in held) > 2 * ROW_BLOCK:
                        held = [rows_of()]
                    continue
                if ids is None:
                    (ids, x), held = rows_of(), []
                for c in range(a, b if len(ids) else a, QUERIES):
                    got = list(best(points[c : min(b, c + QUERIES)], all_ids[c : min(b, c + QUERIES)], x, ids, k))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))],
                        names=["query_id", "vec_id", "score"],
                    )

    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
