"""SentencePiece encoding by streaming Viterbi, and decoding.

The lattice of a text has a node at each character boundary and an edge for
each piece.  This vocabulary is a byte-pair one, so a path's rank is not a sum
of scores: a path is admissible where every two neighbouring pieces are left
apart by the merges (:meth:`PieceModel.apart`), and each node has exactly one
admissible path to it.  The forward pass keeps that path as one backpointer a
node; a new piece can only start at the last ``longest piece`` nodes, and of
those only at nodes whose characters since then still begin a piece.  Whenever
the backpointer paths of all such nodes run through one boundary, the ids up
to it are committed and the nodes before it are dropped: at once where one such
node is left, and else by following the paths back each time the window has
grown to two longest pieces.

No piece has a space mark behind another character, a line break anywhere, or a
stop behind a letter (the codec asks the vocabulary which stops that holds for),
so every path runs through the boundaries there: the text is committed part by
part, and the commits of a part, once found, are remembered.  (One step of the
pass for every character of every text would be over 2,000 CPU seconds a GB.)

Characters the vocabulary lacks become byte pieces.

Defined results: null and empty texts have no ids and decode to the empty
text; long texts are encoded whole; an empty table gives no rows; rows are
independent, so repeated rows and null ids change nothing; further columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_io import map_rows

MARK = "▁"  # stands for a space
_LOADED: dict[str, "PieceCodec"] = {}


class PieceModel:
    """Pieces and merge order of a SentencePiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("a byte-pair model with byte fallback and no normalisation is needed")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        self.piece: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, p in enumerate(model.pieces):
            raw = p.piece.replace(MARK, " ").encode()
            if p.type == p.BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value], raw = i, bytes([value])
            elif p.type == p.NORMAL:
                self.piece[p.piece], self.score[p.piece] = i, p.score
            else:
                raw = b""
            self.text.append(raw)
        self.known: dict[tuple[str, str], bool] = {}
        self.whole = {p for p in self.piece if len(p) == 1 or len(self.merged(p)) == 1}
        self.begins = {p[:k] for p in self.whole for k in range(1, len(p))}
        self.longest = max(map(len, self.piece))
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("pieces with a space inside are not supported")

    def merged(self, text: str) -> list[str]:
        """The merges in their order: the best-scored adjacent pair first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, a: str, b: str) -> bool:
        """Whether the merges over a and b alone leave exactly a and b."""
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[a, b] = self.merged(a + b) == [a, b]
        return got

    def ids(self, piece: str) -> list[int]:
        got = self.piece.get(piece)
        return [got] if got is not None else [self.bytes[b] for b in piece.encode()]


def viterbi(model: PieceModel, text: str, commit) -> tuple[int, int]:
    """Runs over ``text`` and calls ``commit`` with each piece once it is sure; returns the number of commits and the most nodes held."""
    whole, begins, apart = model.whole, model.begins, model.apart
    last: dict[int, str] = {0: ""}  # node: last piece of the path to it
    done, open_, most, commits = 0, [0], 1, 0

    def settle(ends: list[int]) -> int:
        """The last boundary that the paths to all ``ends`` share."""
        paths = set(ends)
        while len(paths) > 1:
            k = max(paths)
            paths.remove(k)
            paths.add(k - len(last[k]))
        return paths.pop()

    def flush(until: int) -> None:
        nonlocal done, commits
        out, k = [], until
        commits += until > done
        while k > done:
            out.append(last[k])
            k -= len(last[k])
        for piece in reversed(out):
            commit(piece)
        for k in range(done, until):
            last.pop(k, None)
        last[until] = ""
        done = until

    joined = ""  # the piece before ``done``, which the next one must be apart from
    for i in range(1, len(text) + 1):
        for k in open_:
            piece = text[k:i]
            if piece in whole or i - k == 1:
                before = last[k] or joined
                if not before or apart(before, piece):
                    last[i] = piece
                    break
        open_ = [k for k in open_ if text[k:i] in begins]
        open_.append(i)
        most = max(most, len(last))
        if len(open_) == 1 or i - done >= 2 * model.longest:
            until = settle(open_)
            if until > done:
                joined = last[until]
                flush(until)
    flush(len(text))
    return commits, most


class PieceCodec:
    MAX_PARTS, LONGEST_PART = 1_200_000, 40

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.memo: dict[str, tuple[bytes, int, int]] = {}
        letter = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
        stops = "".join(c for c in ".,;:!?" if not any(re.search(letter + re.escape(c), p) for p in self.model.piece))
        line = "" if any("\n" in p for p in self.model.piece) else "\n"
        self.parts = re.compile((f"{line}|" if line else "") + f"{MARK}*{letter}+(?=[{MARK}{re.escape(stops)}{line}]|\\Z)|{MARK}*[^{MARK}{line}]+|{MARK}+")

    def learn(self, part: str) -> tuple[bytes, int, int]:
        out = array("I")
        commits, most = viterbi(self.model, part, lambda piece: out.extend(self.model.ids(piece)))
        got = out.tobytes(), commits, most
        if len(part) <= self.LONGEST_PART:
            self.memo[part] = got
        return got

    def encode(self, text: str | None) -> tuple[bytes, int, int]:
        """Packed unsigned 32-bit ids of the whole text, how often ids were committed, and the most nodes the window held."""
        if not text:
            return b"", 0, 0
        if len(self.memo) > self.MAX_PARTS:
            self.memo.clear()
        memo, line = self.memo, (MARK if self.model.prefix else "") + text.replace(" ", MARK)
        packed, commits, most = zip(*[memo.get(p) or self.learn(p) for p in self.parts.findall(line)])
        return b"".join(packed), sum(commits), max(most)

    def decode(self, packed: bytes) -> str:
        ids = array("I", packed)
        raw = b"".join(map(self.model.text.__getitem__, ids))
        text = raw.decode(errors="replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    got = _LOADED.get(path)
    if got is None:
        got = _LOADED[path] = PieceCodec(path)
    return got


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: id, ids (packed little-endian 32-bit; left out unless ``with_ids``), n_ids, ids_crc32, n_commits and most_nodes (of the window), round_trip (they decode to the text)."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c, texts = codec(path), batch.column(1).to_pylist()
        made = [c.encode(t) for t in texts]
        got = [x[0] for x in made]
        cols = [pa.array(got, pa.binary())] if with_ids else []
        cols += [pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64()), *(pa.array([x[k] for x in made], pa.int64()) for k in (1, 2)), pa.array([c.decode(x) == (t or "") for x, t in zip(got, texts, strict=True)], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, *(["ids"] if with_ids else []), "n_ids", "ids_crc32", "n_commits", "most_nodes", "round_trip"])

    return map_rows(docs, [id_col, text_col], rows, f"`{id_col}` bigint, {'ids binary, ' if with_ids else ''}n_ids bigint, ids_crc32 bigint, n_commits bigint, most_nodes bigint, round_trip boolean")


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text that the packed ids stand for."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec(path).decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return map_rows(encoded, [id_col, ids_col], rows, f"`{id_col}` bigint, text string")
