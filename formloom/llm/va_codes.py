"""Product codes of vectors, each part's nearest entry found by a VA-file.

Vectors become integers, floor(scale * x), and are cut into ``parts`` equal
consecutive parts.  Each part position has a codebook of at most ``entries``
entries, started from the rows of smallest id and moved ``rounds`` times to the
floored mean of the parts nearest to them.  A codebook is held as a VA-file:
every coordinate of an entry is quantised to ``bits`` bits, the cells of a
dimension holding equally many entries.  A query part makes one table a
dimension, the least and greatest squared distance to each cell; sums of looked
up values bound its distance to every entry from both sides, and only entries
whose lower bound does not exceed the least upper bound are measured exactly, in
integers.  Rows never move: a round sends (part, entry) counts and sums, at most
``parts * entries`` rows a task, and so many reach the driver.

Defined results: rows whose vector is null or holds null or non-finite
components are left out; null ids come last among the smallest, repeated ids go
by their vectors and are coded row by row; vectors are filled up with zeros to
the longest length, and that to a multiple of ``parts`` (an empty vector is all
zeros); with fewer rows than ``entries`` the codebooks are as short; integers
beyond +-2**27 (components beyond +-524,288 at scale 256) count as that, and a
sum of errors beyond a long is null; ties go to the lower index; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_io import bound_batches, keep, map_rows

LIMIT = 1 << 27


class VaFile:
    """Entries (rows of integers) with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = 3):
        self.entries = entries
        n, width = entries.shape
        cells = max(1, min(1 << bits, n))
        self.cell = np.zeros((width, n), np.intp)
        self.low, self.high = np.zeros((2, width, cells), np.int64)
        for j in range(width):
            for c, held in enumerate(np.array_split(np.argsort(entries[:, j], kind="stable"), cells)):
                self.cell[j, held] = c
                self.low[j, c], self.high[j, c] = entries[held, j].min(), entries[held, j].max()

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every query's squared distance to every entry, by one table a query and dimension."""
        lower, upper = np.zeros((2, len(queries), len(self.entries)), np.int64)
        for j in range(queries.shape[1]):
            x = queries[:, j, None]
            above, below = self.low[j] - x, x - self.high[j]
            least = np.maximum(np.maximum(above, below), 0)
            most = np.maximum(np.abs(above), np.abs(below))
            lower += (least * least)[:, self.cell[j]]
            upper += (most * most)[:, self.cell[j]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query: the nearest entry's index (ties to the lower), its squared distance, and how many entries were measured."""
        lower, upper = self.bounds(queries)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = ((queries[row] - self.entries[entry]) ** 2).sum(axis=1)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(len(queries)), best], np.bincount(row, minlength=len(queries))


class Codebooks:
    """One VA-file a part position."""

    def __init__(self, entries: np.ndarray, scale: int, bits: int):
        """``entries``: integers by part, entry and position within the part."""
        self.scale, self.parts, self.width = scale, entries.shape[0], entries.shape[2]
        self.files = [VaFile(x, bits) for x in entries]

    @property
    def entries(self) -> np.ndarray:
        return np.stack([f.entries for f in self.files])

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def cut(self, vectors: pa.Array) -> np.ndarray:
        """A batch's vectors as integers by row, part and position."""
        return integers(vectors, self.scale, self.parts * self.width).reshape(len(vectors), self.parts, self.width)

    def assign(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The cut vectors; index, squared distance and entries measured by row and part."""
        cut = self.cut(vectors)
        found = [f.nearest(cut[:, p]) for p, f in enumerate(self.files)]
        return cut, *(np.stack(x, axis=1) for x in zip(*found, strict=True))


def integers(vectors: pa.Array, scale: int, size: int) -> np.ndarray:
    """floor(scale * x) of a batch of valid vectors, with zeros up to ``size``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), size), np.int64)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(values)) - starts] = np.clip(np.floor(scale * values), -LIMIT, LIMIT)
    return out


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~odd


def moved(rows: DataFrame, books: Codebooks, entries: int) -> np.ndarray:
    """The entries after one round; ``rows`` has the column vector."""
    parts, width = books.parts, books.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                cut, index, _, _ = books.assign(batch.column(0))
                at = (index + entries * np.arange(parts)).ravel()
                count += np.bincount(at, minlength=len(count))
                flat = cut.reshape(-1, width)
                for j in range(width):  # exact: a batch has at most 1000 rows of integers below 2**28
                    total[:, j] += np.bincount(at, flat[:, j], len(count)).astype(np.int64)
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["at", "n", "total"])

    bound_batches(rows.sparkSession)
    told = rows.select("vector").mapInArrow(sums, "at bigint, n bigint, total array<bigint>")
    out = books.entries.reshape(parts * entries, width).copy()
    for r in told.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(width)]).alias("total")).collect():
        out[r["at"]] = [x // r["n"] for x in r["total"]]
    return out.reshape(parts, entries, width)


def fit_codebooks(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, bits: int = 3) -> Codebooks | None:
    """Codebooks of valid ``rows`` (id, vector); none where there are none. Two numbers, ``entries`` vectors and the sums of each round reach the driver."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    size = max(1, -(-longest // parts)) * parts
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), scale, size)
    books = Codebooks(start.reshape(len(first), parts, -1).transpose(1, 0, 2).copy(), scale, bits)
    for _ in range(rounds):
        books = Codebooks(moved(rows, books, len(first)), scale, bits)
    return books


def vector_codes(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, bits: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per valid row: id, code (two hex digits a part), error, label_error, codebooks_sha256, n_measured (exact distances taken, of parts * entries)."""
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold up to 256 entries")
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("vector"), df[label_col].alias("label")).where(whole(F.col("vector")))
    books = fit_codebooks(rows, parts, entries, rounds, scale, bits)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def coded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, index, error, measured = books.assign(batch.column(1))
        codes = [x.tobytes().hex() for x in index.astype(np.uint8)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(codes), pa.array(error.sum(axis=1)), pa.array(measured.sum(axis=1))], names=["id", "label", "code", "error", "n_measured"]
        )

    out = keep(map_rows(rows, ["id", "vector", "label"], coded, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint, n_measured bigint"), "codes")
    totals = out.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return out.join(totals, out["label"].eqNullSafe(totals["of"])).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256 if books else "").alias("codebooks_sha256"), "n_measured"
    )
