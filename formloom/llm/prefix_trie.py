"""The prefix trie of conversations, by an external mergesort that carries LCPs.

A conversation is rebuilt, then becomes one row: sixteen bytes (of SHA-256) and
the number of code points for each turn.  Every task sorts such rows into runs
of bounded size, each row with the number of turns that it shares with the one
before it (its LCP); the runs are stored.  They are dealt by ranges of (turns,
id), so that any number of equal conversations is split over tasks, and each
task merges its share of all runs by a loser tree: of two rows the one that
shares more turns with the row last output is the smaller, and turns are only
compared where both share equally many, from there on.  The merged rows, with
their LCPs, walk a stack of open nodes: what a row does not share with its
predecessor is finished and output.

A task leaves open the path of its first and of its last row, which other tasks
may share.  These paths, two a task, go through the same stack in the order of
the tasks.  Ids of conversations that end in a node are hashed as they come; if
they are many, or the node is left open, they leave in parts, which are dealt by
node and hashed as a sorted stream.

Defined results: rows with a null id form no conversation; null roles and texts
are empty; turns of one number go by role and digest, repeated rows are as many
turns; ``c - c % 100`` of a negative id is the hundred below it; of an empty
table there is no trie; further columns are not read.  Bounds: a conversation is
24 bytes a turn in one row; a task holds some 8 MB of them, the open path and
the finished children of its nodes; the last stack holds two paths a task.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow_io import bound_batches, keep

#: Bytes of a turn in a key; rows and key bytes of a run; key bytes of a merging task; ids that a node holds.
TURN, RUN_ROWS, RUN_BYTES, MERGE_BYTES, HELD_IDS = 16, 20_000, 4 << 20, 8 << 20, 5000
NO_IDS = hashlib.sha256(b"").hexdigest()
#: Nodes that are broadcast at most.
FEW = 100_000


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_id, key (the turns' digests, joined), chars (code points of the turns' texts).

    The first h turns of the conversation that begins its hundred (h by the id's
    CRC-32), then its own turns after its first h.
    """
    c = conversations
    role, text = (F.coalesce(c[x].cast("string"), F.lit("")) for x in (role_col, text_col))
    digest = F.substring(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256), 1, 2 * TURN)
    turns = c.where(c[conv_col].isNotNull()).select(
        c[conv_col].cast("bigint").alias("conv_id"), F.struct(c[turn_col].alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).alias("chars")).alias("t")
    )
    own = keep(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own")).select("conv_id", F.transform("own", lambda t: F.struct(t["digest"], t["chars"])).alias("own")), "own_turns")
    heads = own.where(F.pmod("conv_id", F.lit(100)) == 0).select(F.col("conv_id").alias("of"), F.slice("own", 1, 5).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(6)).cast("int")
    after = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    whole = F.when(F.col("head").isNull(), after).otherwise(F.concat(F.slice("head", F.lit(1), h), after))
    joined = own.join(heads, F.col("conv_id") - F.pmod("conv_id", F.lit(100)) == F.col("of"), "left").select("conv_id", whole.alias("t"))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("key"), F.transform("t", lambda t: t["chars"]).alias("chars"))


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that two keys share, where the first ``at`` are known to be shared."""
    n = min(len(a), len(b)) // TURN
    if a[at * TURN : n * TURN] == b[at * TURN : n * TURN]:
        return n
    while a[at * TURN : (at + 1) * TURN] == b[at * TURN : (at + 1) * TURN]:
        at += 1
    return at


class LoserTree:
    """Merges runs, lists of (key, id, turns shared with the run's row before, further values).

    Inner nodes hold the loser of their match and the turns that it shares with
    the row that beat it. When a row is output, the losers on its way to the
    root all lost to it, so their counts and that of the next row of its run are
    counts against the same row.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.compared = runs, [0] * len(runs), 0
        self.losers: list[tuple[int, int]] = [(-1, -1)] * len(runs)
        self.top = self._play(1) if runs else (-1, -1)

    def _play(self, node: int) -> tuple[int, int]:
        """(run, turns shared with the row last output) of the least row below a node; leaves are nodes k, k+1, ... 2k-1."""
        k = len(self.runs)
        if node >= k:
            return node - k, 0
        winner, self.losers[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return winner

    def _match(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser of two; -1 turns: the run is at its end."""
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        if a[1] < 0:
            return a, b
        x, y = self.runs[a[0]][self.at[a[0]]], self.runs[b[0]][self.at[b[0]]]
        self.compared += 1
        n = shared(x[0], y[0], a[1])
        mine, other = x[0][n * TURN : (n + 1) * TURN], y[0][n * TURN : (n + 1) * TURN]
        first = mine < other if mine != other else x[1] <= y[1]
        return (a, (b[0], n)) if first else (b, (a[0], n))

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """Rows in order, each with the turns that it shares with the one before."""
        k = len(self.runs)
        while self.top[1] >= 0:
            run, lcp = self.top
            row = self.runs[run][self.at[run]]
            yield row, lcp
            self.at[run] += 1
            now = (run, self.runs[run][self.at[run]][2] if self.at[run] < len(self.runs[run]) else -1)
            node = (k + run) // 2
            while node:
                now, self.losers[node] = self._match(now, self.losers[node])
                node //= 2
            self.top = now


class Node:
    """An open node: sums over what is finished below it, and over the conversations that end in it."""

    __slots__ = ("chars", "convs", "ends", "finished", "kids", "least", "leaves", "open_before", "parted", "saved")

    def __init__(self, chars: int, open_before: bool = False):
        self.chars, self.open_before = chars, open_before
        self.least, self.convs, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.parted = False
        self.finished: list[tuple] = []

    def add(self, least: int | None, convs: int, kids: int, leaves: int, saved: int) -> None:
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.convs += convs
        self.kids += kids
        self.leaves += leaves
        self.saved += saved


NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, node binary, parent binary"
PATH = "part int, side int, key binary, chars array<int>, sums array<struct<least:bigint,convs:bigint,kids:bigint,leaves:bigint,saved:bigint>>"
PART = "first bigint, ids string"
MERGED = f"kind string, {NODE}, {PATH}, {PART}"


def named(key: bytes, depth: int) -> bytes:
    return hashlib.blake2b(key[: depth * TURN], digest_size=TURN).digest()


class Walk:
    """The stack of open nodes, and what has left it."""

    def __init__(self):
        self.path: list[Node] = [Node(0, True)]
        self.key = b""
        self.rows: list[dict] = []

    def ids_leave(self, node: Node, depth: int) -> None:
        if node.ends:
            self.rows.append({"kind": "ids", "node": named(self.key, depth), "first": node.ends[0], "ids": ",".join(map(str, node.ends))})
            node.ends = []
        node.parted = True

    def children_leave(self, node: Node, depth: int, known: bool) -> None:
        """The finished children's rows; where the node is left open, with its name in place of its least id."""
        parent = named(self.key, depth) if node.finished and not known else None
        for row in node.finished:
            self.rows.append(row | {"parent_conv_id": node.least if known else None, "parent": parent})
        node.finished = []

    def close(self) -> None:
        """The deepest open node is finished, and its parent learns of it."""
        depth = len(self.path) - 1
        node = self.path.pop()
        if node.kids == 0:
            node.leaves = 1
        node.saved += (node.convs - 1) * node.chars
        if node.ends and node.parted:
            self.ids_leave(node, depth)
        self.children_leave(node, depth, True)
        ends = None if node.parted else hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()
        row = {"kind": "node", "conv_id": node.least, "depth": depth, "n_convs": node.convs, "n_children": node.kids, "n_leaves": node.leaves, "saved_tokens": node.saved}
        row |= {"ends_sha256": ends, "node": named(self.key, depth) if node.parted else None}
        if depth:
            self.path[-1].finished.append(row)
            self.path[-1].add(node.least, node.convs, 1, node.leaves, node.saved)
        else:
            self.rows.append(row)

    def leave(self) -> tuple[int, dict]:
        """The deepest open node leaves unfinished: its depth and its sums."""
        depth = len(self.path) - 1
        node = self.path.pop()
        self.ids_leave(node, depth)
        self.children_leave(node, depth, False)
        return depth, {"least": node.least, "convs": node.convs, "kids": node.kids, "leaves": node.leaves, "saved": node.saved}

    def open(self, key: bytes, chars: list[int], open_before: bool = False) -> None:
        self.key = key
        for n in chars[len(self.path) - 1 :]:
            self.path.append(Node(n, open_before))


def walked(merged: Iterable[tuple[tuple, int]], part: int, held_ids: int = HELD_IDS) -> Iterator[list[dict]]:
    """Nodes, parts of ids and the two open paths of a task's merged rows."""
    walk, first, before = Walk(), None, {}
    key = chars = None
    for (key, conv, _, chars), lcp in merged:
        while len(walk.path) - 1 > lcp:
            if walk.path[-1].open_before:
                depth, sums = walk.leave()
                before[depth] = sums
            else:
                walk.close()
        walk.open(key, chars, first is None)
        first = first or (key, chars)
        end = walk.path[-1]
        end.add(conv, 1, 0, 0, 0)
        end.ends.append(conv)
        if len(end.ends) >= held_ids:
            walk.ids_leave(end, len(walk.path) - 1)
        if len(walk.rows) >= HELD_IDS:
            yield walk.rows
            walk.rows = []
    if first is None:
        return
    last = dict(walk.leave() for _ in walk.path[:])
    none = {"least": None, "convs": 0, "kids": 0, "leaves": 0, "saved": 0}
    for side, (k, c), sums in ((0, first, before), (1, (key, chars), last)):
        walk.rows.append({"kind": "path", "part": part, "side": side, "key": k, "chars": c, "sums": [sums.get(d, none) for d in range(len(c) + 1)]})
    yield walk.rows


def _batches(rows: Iterator[list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for some in rows:
        for at in range(0, len(some), HELD_IDS):
            yield pa.RecordBatch.from_pylist(some[at : at + HELD_IDS], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def sorted_runs(items: DataFrame) -> DataFrame:
    """Rows of ``items`` in sorted runs: run, at (place in it), key, conv_id, lcp (turns shared with the run's row before), chars."""

    def run(number: int, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[:2])
        keys = [r[0] for r in rows]
        lcp = [0, *map(shared, keys, keys[1:])]
        ids = [(TaskContext.get().partitionId() << 32) + number] * len(rows)
        own = [pa.array(ids, pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array(keys, pa.binary()), pa.array([r[1] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays([*own, pa.array(lcp, pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["run", "at", "key", "conv_id", "lcp", "chars"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append(row)
                size += len(row[0])
                if len(rows) >= RUN_ROWS or size >= RUN_BYTES:
                    yield run(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield run(number, rows)

    return items.select("key", "conv_id", "chars").mapInArrow(runs, "run bigint, at int, key binary, conv_id bigint, lcp int, chars array<int>")


def merged_ranges(runs: DataFrame, tasks: int, held_ids: int = HELD_IDS) -> DataFrame:
    """Each range of (key, conv_id) merged and walked by one task."""
    schema = _arrow(MERGED)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for run, at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[run].append((at, *row))
        ordered = []
        for run in sorted(held):
            rows = sorted(held.pop(run), key=lambda r: r[0])
            ordered.append([(key, conv, lcp if n else 0, chars) for n, (_, key, conv, lcp, chars) in enumerate(rows)])
        yield from _batches(walked(LoserTree(ordered), TaskContext.get().partitionId(), held_ids), schema)

    return runs.repartitionByRange(tasks, "key", "conv_id").mapInArrow(merge, MERGED)


def closed_paths(paths: DataFrame) -> DataFrame:
    """The nodes that tasks left open: their paths, in the order of the tasks, through one stack. Two rows a task."""
    schema = _arrow(NODE)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, begun = Walk(), False
        for batch in batches:
            for row in batch.to_pylist():
                lcp = shared(walk.key, row["key"]) if begun else 0
                begun = True
                while len(walk.path) - 1 > lcp:
                    walk.close()
                walk.open(row["key"], row["chars"])
                for node, sums in zip(walk.path, row["sums"], strict=True):
                    node.add(**sums)
                    node.parted = True
                yield from _batches(iter([walk.rows]), schema)
                walk.rows = []
        while begun and walk.path:
            walk.close()
        yield from _batches(iter([walk.rows]), schema)

    return paths.select("part", "side", "key", "chars", "sums").repartition(1).sortWithinPartitions("part", "side").mapInArrow(close, NODE)


def hashed_ids(parts: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ids that left in parts; a node's parts are one sorted stream, of which only the hash's state is held."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if node is not None:
            done.append((node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["of", "sha"])

    return parts.select("node", "first", "ids").repartition("node").sortWithinPartitions("node", "first").mapInArrow(stream, "of binary, sha string")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where it is counted to be small."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def prefix_trie(items: DataFrame, merge_bytes: int = MERGE_BYTES, held_ids: int = HELD_IDS) -> DataFrame:
    """Per node of the trie of ``items`` (conv_id, key, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    bound_batches(items.sparkSession)
    runs = keep(sorted_runs(items), "runs")
    size = runs.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    merged = keep(merged_ranges(runs, -(-size // merge_bytes) or 1, held_ids), "merged")
    border = keep(closed_paths(merged.where("kind = 'path'")), "border")
    hashes = hashed_ids(merged.where("kind = 'ids'"))
    nodes = merged.where("kind = 'node'")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    done = nodes.where("parent is null and ends_sha256 is not null").select(*columns)
    late = nodes.where("parent is not null or ends_sha256 is null").select(*columns, "node", "parent").unionByName(border.select(*columns, "node", "parent"))
    parents = border.select(F.col("node").alias("at"), F.col("conv_id").alias("least"))
    late = late.join(_small(parents), late["parent"] == F.col("at"), "left").join(hashes, late["node"] == hashes["of"], "left")
    known: dict[str, Column] = {"parent_conv_id": F.coalesce("parent_conv_id", "least"), "ends_sha256": F.coalesce("ends_sha256", "sha", F.lit(NO_IDS))}
    return done.unionByName(late.select(*[known[c].alias(c) if c in known else F.col(c) for c in columns]))


def conversation_trie(conversations: DataFrame, merge_bytes: int = MERGE_BYTES, held_ids: int = HELD_IDS) -> DataFrame:
    """The trie of rebuilt conversations (conv_id, turn, role, text)."""
    return prefix_trie(rebuilt(conversations), merge_bytes, held_ids)
