"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprints: a bit is set if it is set in over half of the XXH64 hashes of the
text's word shingles.

Links: a fingerprint's 64 bits are 32 segments of two; its embedding is their
bit counts, written as thermometer codes (0: 00, 1: 01, 2: 11) so that the
Manhattan distance of two embeddings is the popcount of their xor.  It never
exceeds the Hamming distance, so it bounds it from below.  The range join over
the embedding works on a grid: the segments form six groups, and of two
embeddings at most 3 apart at least three groups are equal, so they share one
of the 20 cells made by the choice of three groups.  In a cell the bound is
tested first, the exact distance after it.

Only distinct fingerprints enter, so copies cost nothing.  A cell passes on a
spanning forest of its links (fewer links than members, the same components).
A cell with more than ``block`` members is cut into blocks, and each pair of
blocks is a group of its own: bounded memory, no link lost.  Components come
from randomised contraction in a logarithmic number of rounds, as tables in the
shared folder.

Defined results: null, empty and wordless texts have fingerprint zero and link
like any other; rows with the same text share a component; null ids are kept
and never are a component's id unless it has no other; a bit set in exactly half
the hashes is 0; long texts are read whole, a part at a time; an empty table
gives no rows; further columns are not read (``one_of_each`` passes them
through).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_io import keep, map_rows

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_LOW = 0x5555555555555555


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time."""
    at = 0
    while at < len(data):
        m = _SPACE.search(data, at + size)
        end = m.start() if m else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text.encode().lower() if text else b""):
        words = carry + words
        if len(words) >= width:
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            line = b" ".join(words)
            cut = [line[a:b] for a, b in zip((end - size)[: len(end) - width + 1].tolist(), end[width - 1 :].tolist())]
            h = np.fromiter(map(digest, cut, repeat(seed)), "<u8", len(cut))
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(cut)
        carry = words[max(0, len(words) - width + 1) :]
    if not total:
        return digest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fp (the fingerprint as a signed long)."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return map_rows(docs, [id_col, text_col], rows, f"`{id_col}` bigint, fp bigint")


def thermometer(fp: Column) -> Column:
    """The embedding: each two-bit segment's bit count as a thermometer code."""
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW)), 1))


def groups_for(n: int, most: int = 3) -> int:
    """How many groups make the least work for n fingerprints: the cells each is put into, and the strangers met there.

    Two bits' count is worth 1.5 bits of surprise on even fingerprints; 1.3 are
    reckoned here, since texts share phrases.
    """
    work = lambda g: comb(g, most) * (1 + n / 2 ** (1.3 * 32 * (g - most) / g))
    return min(range(2 * most, 5 * most), key=work)


def grid_masks(groups: int = 6, most: int = 3) -> list[int]:
    """For each choice of all but ``most`` groups, the bits of their segments (as signed longs)."""
    ends = [round(32 * k / groups) for k in range(groups + 1)]
    parts = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(ends, ends[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, groups - most)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over fingerprints at most ``most`` bits apart: bound first, then the exact distance."""
    if len(fp) == 2:
        a, b = fp.tolist()
        return [(a, b)] if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= most else []
    x = fp.view(np.uint64)
    low = np.uint64(_LOW)
    up = x >> np.uint64(1)
    code = ((x | up) & low) | ((x & up & low) << np.uint64(1))
    open_ = np.arange(len(x))
    links, front = [], []
    while len(open_):
        if front:
            k = front.pop()
        else:
            k, open_ = open_[0], open_[1:]
        near = np.flatnonzero(np.bitwise_count(code[open_] ^ code[k]) <= most)
        near = near[np.bitwise_count(x[open_[near]] ^ x[k]) <= most]
        if len(near):
            found = open_[near]
            links += zip(repeat(int(fp[k])), fp[found].tolist())
            front += found.tolist()
            open_ = np.delete(open_, near)
    return links


def links_between(classes: DataFrame, most: int = 3, block: int = 4096, groups: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all links within ``most`` bits."""
    groups = groups or groups_for(classes.count(), most)
    code = thermometer(F.col("fp"))
    cells = classes.select("fp", code.alias("code")).select(
        "fp", F.explode(F.array(*[F.struct(F.lit(k).alias("grid"), F.col("code").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(grid_masks(groups, most))])).alias("at")
    ).select("at.grid", "at.cell", "fp")
    sizes = cells.groupBy("grid", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cells.join(sizes, ["grid", "cell"]).withColumn("k", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    dealt = shared.select("grid", "cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    dealt = dealt.select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    key = ["grid", "cell", "i", "j"]

    def search(batches) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def group(run: np.ndarray) -> list[tuple[int, int]]:
            return forest(np.ascontiguousarray(run[:, 4]), most)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            held.append(rows)
            if batch.num_rows and len(held) == 1 and (rows[0, :4] == rows[-1, :4]).all():
                continue
            rows = np.concatenate(held)
            cut = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            if not len(cut):
                held = [rows]
                continue
            links = [x for run in np.split(rows[: cut[-1]], cut[:-1]) for x in group(run)]
            held = [rows[cut[-1] :]]
            if links:
                a = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=["a", "b"])
        if held and len(rows := np.concatenate(held)):
            links = group(rows)
            if links:
                a = np.array(links, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())], names=["a", "b"])

    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    found = dealt.mapInArrow(search, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Per node of the links (a, b): node and label, one label for each connected component.

    Randomised contraction: in each round the nodes are put in a new order by a
    hash, every node is replaced by the first of itself and its neighbours, and
    links inside one are dropped.  The expected number of nodes left falls by a
    constant factor a round whatever the shape (chains, stars), so the rounds
    are logarithmic.  Each round's replacements are written to the shared
    folder; they are then followed from the last, smallest one back, so every
    node is joined once.
    """
    links, hops = keep(links, "links"), []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, turn=len(hops): F.xxhash64(F.lit(turn), c)
        first = both.groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        up = keep(first.select("a", F.when(order("b") < order("a"), F.col("b")).otherwise(F.col("a")).alias("up")), "hooks")
        hops.append(up)
        other = up.select(F.col("a").alias("b"), F.col("up").alias("up_b"))
        links = links.join(up, "a").join(other, "b").where("up <> up_b")
        links = keep(links.select(F.least("up", "up_b").alias("a"), F.greatest("up", "up_b").alias("b")).distinct(), "links")
    if not hops:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = hops.pop().select(F.col("a").alias("node"), F.col("up").alias("label"))
    while hops:
        later = labels.select(F.col("node").alias("up"), "label")
        labels = keep(hops.pop().join(later, "up", "left").select(F.col("a").alias("node"), F.coalesce("label", "up").alias("label")), "labels")
    return labels


def _classes(docs: DataFrame, most: int, width: int, seed: int, id_col: str, text_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, fp), and per fingerprint: fp, first (its smallest id), component (a label), component_id."""
    fps = keep(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    classes = keep(fps.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    labels = components(links_between(classes, most, block))
    linked = labels.join(classes, F.col("node") == F.col("fp")).select("fp", "label", "first")
    lowest = linked.groupBy("label").agg(F.min("first").alias("lowest"))
    lowest = linked.join(lowest, "label").select("fp", "label", "lowest")
    # stored, so that a join with it stands alone and a fingerprint shared by very many rows can be split at run time
    of = classes.join(lowest, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("component"), F.coalesce("lowest", "first").alias("component_id"))
    return fps, keep(of, "components")


def near_duplicates(docs: DataFrame, most: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    fps, of = _classes(docs, most, width, seed, id_col, text_col, block)
    return fps.join(of.select("fp", "component_id"), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, name: str, width: int, seed: int, text_col: str) -> DataFrame:
    """docs with its fingerprints as a further column."""
    at = docs.columns.index(text_col)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.array([fingerprint(t, width, seed) for t in batch.column(at).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp.view(np.int64))], names=[*batch.schema.names, name])

    return map_rows(docs, docs.columns, rows, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def free_name(columns: list[str], wish: str) -> str:
    """``wish``, or it with underscores before it, that names none of the columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    while wish in taken:
        wish = f"_{wish}"
    return wish


def one_of_each(docs: DataFrame, most: int = 3, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block: int = 4096) -> DataFrame:
    """One row of docs, with all its columns, for each component: that of smallest id.

    A null id comes last, and of rows that share id and fingerprint any one
    stays.  The rows that stay are found on ids and fingerprints alone; the
    texts are filtered by a join on the id where only one row has it.  Rows
    that share their id, or have none, are told apart by their fingerprints too.
    """
    fps, of = _classes(docs, most, width, seed, id_col, text_col, block)
    one_id, fp = free_name(docs.columns, "stays_id"), free_name(docs.columns, "stays_fp")
    lowest = of.groupBy("component").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("one"))
    one = keep(lowest.select(F.col("one.first").alias(one_id), F.col("one.fp").alias(fp)), "representatives")
    shared = keep(fps.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(id_col).alias(one_id)), "shared-ids")
    alone = one.join(shared, one_id, "left_anti").where(F.col(one_id).isNotNull())
    own = docs.join(alone, docs[id_col] == alone[one_id], "left_semi")
    unsure = docs.where(docs[id_col].isNull()).unionAll(docs.join(shared, docs[id_col] == shared[one_id], "left_semi"))
    # joined and told apart by the same columns, so these texts are dealt out once
    unsure = with_fingerprint(unsure, fp, width, seed, text_col).withColumn(one_id, F.col(id_col))
    told = unsure.join(one, unsure[one_id].eqNullSafe(one[one_id]) & (unsure[fp] == one[fp]), "left_semi").dropDuplicates([one_id, fp])
    return own.unionAll(told.drop(one_id, fp))
