"""Best-fit packing of token sequences by minimum bin slack.

A bin starts with the longest piece left.  A subset-sum dynamic programme on a
bitset (bit s: s tokens can be filled) runs over the lengths still available,
longest first, until the rest of the bin is filled exactly or the lengths are
used up; the fullest combination is removed.  Pieces of equal length are alike,
so the state of the whole corpus is one count for each length: the plan needs
at most ``capacity`` counts on the driver whatever the number of documents,
and a combination is taken as often as the counts allow.

The plan is then dealt out without any further shuffle of texts: every task
numbers its pieces within their length while it tokenises, the counts of each
(task, length) turn that into a corpus-wide number, and the number's place in
the plan gives sequence and offset.

Defined results: null text is empty (one piece, the end id); repeated rows and
null ids are packed like any other row; a text of more than ``capacity`` tokens
is cut into pieces of it and a shorter rest; of pieces of one length any may
take a place, so sequence and offset of such ties may differ between runs, the
number and fill of sequences may not; an empty table gives no pieces; further
columns, also ones named like the results, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_io import bound_batches, keep
from .word_ids import encoder

Pattern = tuple[int, list[tuple[int, int]]]  # how often, [(length, pieces of it)]


def fullest(available: dict[int, int], room: int, lengths: list[int]) -> list[tuple[int, int]]:
    """The combination of available lengths that fills most of ``room``; ``lengths`` are the keys, longest first."""
    reach, mask, steps = 1, (2 << room) - 1, []
    full = 1 << room
    for length in lengths:
        if length > room:
            continue
        left, take = min(available[length], room // length), 1
        while left > 0:  # copies in powers of two
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left, take = left - take, take * 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def minimum_slack_plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up all counts; lengths are 1 to capacity."""
    left = {n: k for n, k in counts.items() if k > 0}
    order, plan = sorted(left, reverse=True), []
    while order:
        seed = order[0]
        left[seed] -= 1
        rest = fullest(left, capacity - seed, order)
        left[seed] += 1
        used = dict(rest)
        used[seed] = used.get(seed, 0) + 1
        often = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * often
            if not left[n]:
                del left[n]
        order = [n for n in order if n in left]
        plan.append((often, sorted(used.items(), reverse=True)))
    return plan


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and its task and number among that task's pieces of this length."""
    bound_batches(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            doc, rows = [], []
            for k, ids in enumerate(encoder(path).encode(batch.column(1).to_pylist())):
                ids += tail
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    n = len(part) // 4
                    doc.append(k)
                    rows.append((piece, start // 4, n, zlib.crc32(part), seen[n]))
                    seen[n] += 1
            a = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(a[:, 0].astype(np.int32)), *(pa.array(a[:, k].copy()) for k in range(1, 5)), pa.array(np.full(len(a), task, np.int32))],
                names=[id_col, "piece", "start", "length", "ids_crc32", "nth", "task"],
            )

    schema = f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, task int"
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(cut, schema)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces' table (no texts, no ids) is written once to the shared folder;
    what follows reads that.  The driver gets one count per length; what is
    broadcast is the plan, at most a few entries for each length.
    """
    pieces = keep(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    first: dict[int, int] = {}
    entries, sequence = [], 0
    for often, used in minimum_slack_plan(counts, capacity):
        offset = 0
        for length, each in used:
            begin = first.get(length, 0)
            entries.append((length, begin, each, sequence, offset))
            first[length] = begin + often * each
            offset += length * each
        sequence += often
    entries.sort()
    table = np.array(entries, np.int64).reshape(-1, 5)
    plan = pieces.sparkSession.sparkContext.broadcast(table)

    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    numbered = pieces.join(offsets, ["length", "task"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("nth")).alias("number"))

    def place(batches) -> Iterator[pa.RecordBatch]:
        p = plan.value
        key = p[:, 0] << 44 | p[:, 1]
        for batch in batches:
            length, number = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = p[np.searchsorted(key, length << 44 | number, side="right") - 1]
            turn, slot = np.divmod(number - at[:, 1], at[:, 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(at[:, 3] + turn), pa.array(at[:, 4] + slot * length)],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.mapInArrow(place, f"`{id_col}` bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
