"""Token ids of whole texts from the tokenizers library, asked once for each distinct word.

The word-level vocabulary drops white space and never joins across it, so a
text's ids are its words' ids in order.  Texts are cut at ASCII white space
(any other white space stays inside a "word" and is the library's to drop);
ASCII letters are lowered first, as the vocabulary's normaliser does - but not
in texts that may hold a special string.  New words are encoded by the library
and remembered as packed little-endian 32-bit ids.  Words of small ASCII letters
pass its normaliser and pattern unchanged and go straight to its model; signs
behind letters are a piece of their own by its pattern; other words of letters go
to it in lines, whose ids are parted at word ends; the rest one by one.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

_LETTERS_AND_SIGNS = re.compile(rb"([a-z]+)([^a-zA-Z0-9\x80-\xff]*)")
_ANY_LETTERS_AND_SIGNS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
_LOADED: dict[str, "WordEncoder"] = {}


class WordEncoder:
    #: Words remembered at once; beyond it the memory is emptied (the ids stay the same).
    MAX_WORDS = 1_000_000
    #: Words of a line sent to the library, and characters of texts looked at together.
    LINE, PART_CHARS = 256, 1 << 20

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.memo: dict[bytes, bytes] = {}
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.marks = {x[:2] for x in self.specials}
        self.word_end = np.zeros(self.vocab_size, bool)
        self.word_end[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def words(self, text: str) -> list[bytes]:
        data = text.encode()
        return data.split() if any(m in data for m in self.marks) else data.lower().split()

    def learn(self, new: set[bytes]) -> None:
        """Remembers words that are not in the memory yet."""
        memo, tokenize, split = self.memo, self.library.model.tokenize, _LETTERS_AND_SIGNS.fullmatch
        joined, plain, rest = [], {}, []
        for w in new:
            m = split(w)
            if m is not None:
                stem, signs = m.groups()
                if stem not in memo:
                    memo[stem] = array("I", [t.id for t in tokenize(stem.decode())]).tobytes()
            else:
                text = w.decode()
                m = _ANY_LETTERS_AND_SIGNS.fullmatch(text)
                if m is None or not m[1].isalpha() or m[1] != m[1].lower():
                    rest.append((w, text))
                    continue
                stem, signs = m[1].encode(), m[2].encode()
                if stem not in memo:
                    plain[stem] = m[1]
            if signs:
                joined.append((w, stem, signs))
        plain = list(plain.items())
        rest += [(x, x.decode()) for x in {x for *_, x in joined if x not in memo}]
        lines = [plain[k : k + self.LINE] for k in range(0, len(plain), self.LINE)]
        for line, e in zip(lines, self.library.encode_batch_fast([" ".join([t for _, t in x]) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(line) and ends[-1] == len(ids):
                packed, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                memo.update((w, packed[a:b]) for (w, _), a, b in zip(line, cuts, cuts[1:]))
            else:
                rest += line
        for (w, _), e in zip(rest, self.library.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            memo[w] = np.array(e.ids, "<u4").tobytes()
        memo.update((w, memo[a] + memo[b]) for w, a, b in joined)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed uint32 ids per text; null and empty texts have none."""
        out, at = [], 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and size < self.PART_CHARS:
                part.append(texts[at] or "")
                size += len(part[-1])
                at += 1
            if len(self.memo) > self.MAX_WORDS:
                self.memo.clear()
            lists = [self.words(t) for t in part]
            new = set().union(*lists).difference(self.memo)
            if new:
                self.learn(new)
            out += [b"".join(map(self.memo.__getitem__, w)) for w in lists]
        return out


def encoder(path: str) -> WordEncoder:
    got = _LOADED.get(path)
    if got is None:
        got = _LOADED[path] = WordEncoder(path)
    return got
