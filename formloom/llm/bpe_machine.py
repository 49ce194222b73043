"""A lazily compiled finite-state counter for byte-level BPE.

Two facts make byte-pair encoding finite-state.

* The encoding of a prefix is found from its *last token* alone, and a token
  can follow another exactly when no merge crosses their border
  (:meth:`MergeTable.apart`).  So the last token of every prefix is unique.
* Only starts whose bytes up to here still begin some vocabulary token can
  matter later.  A state therefore holds those starts, each with the token
  before it and the relative number of tokens: a finite set.

Transitions carry the *change* of the number of tokens the text would have if
it ended here, so the sum along a run is the token count and no flush is
needed.  States are determinised on demand and shared by key.
"""

from __future__ import annotations

import json

_FREE = 1 << 40  # rank above any merge


class MergeTable:
    """Merges of a byte-level BPE file, by token number (a merge's rank orders its result)."""

    def __init__(self, vocab_json_path: str):
        with open(vocab_json_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = byte_alphabet()
        raw = {t: bytes(printable[c] for c in t) for t in model["vocab"] if all(c in printable for c in t)}
        self.id_of = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, whole = (self.id_of[raw[x]] for x in (a, b, a + b))
            self.rank[left, right] = r
            parts.setdefault(whole, (left, right, r))
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for t in self.id_of.values():
            self.right[t], self.left[t] = self._spine(parts, t, 1), self._spine(parts, t, 0)
        self.known: dict[tuple[int, int], bool] = {}
        # A token that its own bytes are not encoded to never occurs.
        whole_ok: dict[int, bool] = {}
        for t in sorted(self.id_of.values(), key=lambda t: parts[t][2] if t in parts else -1):
            p = parts.get(t)
            whole_ok[t] = p is None or whole_ok[p[0]] and whole_ok[p[1]] and self._border(p[0], p[1], p[2])
        self.token = {b: t for b, t in self.id_of.items() if whole_ok[t]}
        self.begins = {b[:k] for b in self.token for k in range(1, len(b))}

    @staticmethod
    def _spine(parts: dict, t: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token while it is built, each with the rank of the merge that absorbs it."""
        out, absorbed = [(t, _FREE)], _FREE
        while t in parts:
            absorbed, t = parts[t][2], parts[t][side]
            out.append((t, absorbed))
        return out

    def _border(self, a: int, b: int, until: int) -> bool:
        rank = self.rank
        for x, x_gone in self.right[a]:
            for y, y_gone in self.left[b]:
                m = rank.get((x, y))
                # equal ranks apply from the left: x's own merge lies left of the border, y's right of it
                if m is not None and m < until and m < x_gone and m <= y_gone:
                    return False
        return True

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b may stand side by side in an encoding: no merge ever crosses their border."""
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            got = self.known[a, b] = self._border(a, b, _FREE)
        return got


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Bpe:
    """A state inside one pre-token: what of its end may still grow, and what stands before each such start."""

    __slots__ = ("next", "starts", "suffix")

    def __init__(self, suffix: bytes, starts: tuple):
        self.suffix, self.starts, self.next = suffix, starts, {}


class _Node(dict):
    """A state of the whole counter; a missing transition is compiled when it is first taken."""

    __slots__ = ("bpe", "kind", "last", "machine", "owed")

    def __missing__(self, c: str):
        got = self[c] = self.machine.compile(self, c)
        self.machine.edges += 1
        return got


class CountingTransducer:
    """Deterministic transducer from characters to net token counts (pre-tokeniser and merges in one).

    ``classify`` gives the class of a character: L letter, N number, S white
    space, O other.  ``max_edges`` bounds the compiled part: whoever runs it asks
    ``full`` between chunks and then resets, and compilation begins anew.  States
    are carried over by their keys, so the counts stay the same.
    """

    CONTRACTED = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}  # after an apostrophe

    def __init__(self, merges: MergeTable, classify, max_edges: int = 1_200_000):
        self.merges, self.classify, self.max_edges = merges, classify, max_edges
        self.classes: dict[str, str] = {}
        self.reset()

    def reset(self) -> None:
        self.edges = 0
        self.nodes: dict[tuple, _Node] = {}
        self.states: dict[tuple, _Bpe] = {}
        self.empty = self._state(b"", ((0, -1, 0),))
        self.start = self._node("start", self.empty)
        self.space = self._white(self.empty, " ")[0]

    # ---- inside a pre-token
    def _state(self, suffix: bytes, starts: tuple) -> _Bpe:
        key = (suffix, starts)
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = _Bpe(suffix, starts)
        return got

    def _byte(self, state: _Bpe, b: int) -> tuple[_Bpe, int]:
        got = state.next.get(b)
        if got is not None:
            return got
        self.edges += 1
        token, begins, apart = self.merges.token, self.merges.begins, self.merges.apart
        grown, last, gain, n = state.suffix + bytes((b,)), -1, 0, len(state.suffix)
        for back, before, rel in state.starts:
            t = token.get(grown[n - back:])
            if t is not None and (before < 0 or apart(before, t)):
                last, gain = t, rel + 1
                break
        kept = tuple((back + 1, before, rel - gain) for back, before, rel in state.starts if grown[n - back:] in begins)
        suffix = grown[n - kept[0][0] + 1:] if kept else b""
        got = state.next[b] = (self._state(suffix, (*kept, (0, last, 0))), gain)
        return got

    def _feed(self, state: _Bpe, text: str) -> tuple[_Bpe, int]:
        total = 0
        for b in text.encode():
            state, gain = self._byte(state, b)
            total += gain
        return state, total

    # ---- between pre-tokens
    def _node(self, kind: str, bpe: _Bpe, last: str = "", owed: int = 0) -> _Node:
        key = (kind, id(bpe), last, owed)
        got = self.nodes.get(key)
        if got is None:
            got = self.nodes[key] = _Node()
            got.machine, got.kind, got.bpe, got.last, got.owed = self, kind, bpe, last, owed
        return got

    def _white(self, run: _Bpe, c: str) -> tuple[_Node, int]:
        """A run of white space whose last character is still open; owed: what that character adds if the text ends here."""
        _, owed = self._feed(run, c)
        return self._node("white", run, c, owed), owed

    def _first(self, c: str) -> tuple[_Node, int]:
        kind = self.kind(c)
        if kind == "S":
            return self._white(self.empty, c)
        state, gain = self._feed(self.empty, c)
        return self._node("quote" if c == "'" else kind, state), gain

    def kind(self, c: str) -> str:
        got = self.classes.get(c)
        if got is None:
            got = self.classes[c] = self.classify(c)
        return got

    def compile(self, node: _Node, c: str) -> tuple[_Node, int]:
        at, kind = node.kind, self.kind(c)
        if at == "start":
            return self._first(c)
        if at == "white":
            if kind == "S":
                run, owed = self._feed(node.bpe, node.last)
                then, gain = self._white(run, c)
                return then, gain
            if node.last == " ":
                state, gain = self._feed(self.empty, " " + c)
                return self._node(kind, state), gain - node.owed
            alone = self._feed(self.empty, node.last)[1]
            then, gain = self._first(c)
            return then, gain + alone - node.owed
        if at == "quote":
            tail = self.CONTRACTED.get(c)
            if tail == "":
                return self.start, self._feed(self.empty, "'" + c)[1] - 1
            if tail:
                state, gain = self._feed(self.empty, c)
                return self._node("pair", state, c, gain), gain
            at = "O"
        if at == "pair":
            if c == self.CONTRACTED[node.last]:
                return self.start, self._feed(self.empty, "'" + node.last + c)[1] - 1 - node.owed
            at = "L"
        if at == kind:
            state, gain = self._feed(node.bpe, c)
            return self._node(kind, state), gain
        return self._first(c)

    # ---- chunks
    @staticmethod
    def key(node: _Node) -> tuple:
        """What a state is, whatever has been compiled: it outlives a reset."""
        return node.kind, node.bpe.suffix, node.bpe.starts, node.last, node.owed

    def of_key(self, key: tuple) -> _Node:
        kind, suffix, starts, last, owed = key
        return self._node(kind, self._state(suffix, starts), last, owed)

    def run(self, node: _Node, text: str) -> tuple[_Node, int]:
        total = 0
        for c in text:
            node, gain = node[c]
            total += gain
        return node, total

    def full(self) -> bool:
        return self.edges > self.max_edges
