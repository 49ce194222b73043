"""Exact token counts by a compiled finite-state tokenizer.

Method: the byte-level BPE and its pre-tokeniser are compiled, on demand, to
one deterministic transducer whose transitions carry emitted-token counts
(:mod:`.bpe_machine`).  A text is cut into chunks of ``chunk_chars``.  A chunk
is summed up as a *state map*: entry state -> (exit state, tokens counted).
Its entry states are those that the text before it can lead to: the ``lead``
characters before the chunk are run from states of every kind, and as a word's
beginning settles the state whatever came before, nearly always one entry is
left.  Maps compose associatively (a state the next map does not know has no
image), and the counts of long texts come from a parallel prefix scan over
their chunks' maps.  Where the scan gives the start no image (a run without any
boundary, longer than the lead), the chunks from there on are entered by the
state that was really reached, so counts are exact in every case, and nothing
but states and numbers is held for a chunk.  The compiled part is bounded: it is
asked for its size before each chunk, and compiled anew beyond the bound.

Defined results: a null or empty text has 0 bytes and 0 tokens; the file's
special string inside a text counts as one token, as the library's default
has it; a very long text is run in chunks, one after another in its
row's task; an empty table gives no rows; rows are independent, so repeated
rows, ties, null ids and further columns (also ones named like the results)
change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_io import map_rows
from .bpe_machine import CountingTransducer, MergeTable

_LOADED: dict[str, "TokenCounter"] = {}

StateMap = dict  # entry state: (exit state, tokens)


def scan(items: Sequence, combine: Callable) -> list:
    """Inclusive prefix scan of an associative ``combine`` by pairing: logarithmic depth."""
    n = len(items)
    if n < 2:
        return list(items)
    pairs = [combine(items[k], items[k + 1]) for k in range(0, n - 1, 2)]
    inner = scan(pairs, combine)
    return [items[0] if k == 0 else inner[k // 2] if k % 2 else combine(inner[k // 2 - 1], items[k]) for k in range(n)]


class TokenCounter:
    """Counts for one byte-level BPE file."""

    def __init__(self, path: str, chunk_chars: int = 1 << 16, lead: int = 256):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        self.special = [re.escape(t.content) for t in library.get_added_tokens_decoder().values()]
        self.special_at = re.compile("|".join(sorted(self.special, key=len, reverse=True))) if self.special else None
        self.chunk_chars, self.lead = chunk_chars, min(lead, chunk_chars)
        self.machine = CountingTransducer(MergeTable(path), self._classify)

    def _classify(self, c: str) -> str:
        """The library's own character classes, asked of its pre-tokeniser."""
        for beside, kind in (("a", "L"), ("1", "N"), ("!", "O")):
            if len(self.pieces(beside + c)) == 1:
                return kind
        return "S"

    def entries(self, lead: str) -> list:
        """The states that a text ending in ``lead`` can be in, as far as the lead settles it."""
        found = {}
        for seed in ("", " ", "a", "1", "!"):
            node = self.machine.run(self.machine.run(self.machine.start, seed)[0], lead)[0]
            found[self.machine.key(node)] = None
        return list(found)

    def chunk_map(self, entries: list, chunk: str) -> StateMap:
        """Nothing in it holds on to the compiled part, which may be compiled anew between any two chunks."""
        machine, out = self.machine, {}
        for entry in entries:
            if machine.full():
                machine.reset()
            node, tokens = machine.run(machine.of_key(entry), chunk)
            out[entry] = machine.key(node), tokens
        return out

    @staticmethod
    def compose(first: StateMap, second: StateMap) -> StateMap:
        return {e: (second[x][0], n + second[x][1]) for e, (x, n) in first.items() if x in second}

    def count_plain(self, text: str) -> int:
        machine = self.machine
        if machine.full():
            machine.reset()
        size = self.chunk_chars
        if len(text) <= size:
            return machine.run(machine.start, text)[1]
        chunks, start = range(0, len(text), size), machine.key(machine.start)
        maps = [self.chunk_map(self.entries(text[k - self.lead : k]) if k else [start], text[k : k + size]) for k in chunks]
        whole = scan(maps, self.compose)[-1].get(start)
        if whole is not None:
            return whole[1]
        state, total = start, 0
        for k, known in zip(chunks, maps, strict=True):
            state, gain = known.get(state) or self.chunk_map([state], text[k : k + size])[state]
            total += gain
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special_at is None or self.special_at.search(text) is None:
            return self.count_plain(text)
        parts = self.special_at.split(text)
        return len(parts) - 1 + sum(map(self.count_plain, parts))


def counter(path: str) -> TokenCounter:
    """The counter of a file, compiled once in each Python worker."""
    got = _LOADED.get(path)
    if got is None:
        got = _LOADED[path] = TokenCounter(path)
    return got


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). One pass, no shuffle."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        count = counter(path).count
        n = [count(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    return map_rows(docs, [id_col, text_col], rows, f"`{id_col}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
