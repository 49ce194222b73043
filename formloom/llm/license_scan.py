"""License scans by patience alignment with license texts.

A template (a name, a notice or a text of a license) is found at a place where
enough of its words align with the text in order, and few others stand between
them.  Alignment is patience alignment: words that occur once in the text part
and once in the template are anchors, the longest increasing subsequence of
them is kept, and the gaps between kept anchors are aligned the same way; a gap
without anchors is settled by its longest common subsequence (bit-parallel).
Coverage is the share of the template's words that are aligned.

Coverage alone cannot tell a license from its neighbour, so words decide too.
In names and notices the words that name a license, its version or variant
(*telling* words: apache, lesser, nc, 2.0 ...) must all stand at the place, and
no other telling word may stand there.  Templates have marked passages of
which nine words in ten must be there.  Where several templates fit one place
the one of most aligned words wins, weighed by the words left over on both
sides; every place is reported.

An SPDX expression (``SPDX-License-Identifier: (MIT OR Apache-2.0+)``) names each
of its licenses; its identifiers are read as they stand, those without "only" or
"or later" as they were meant before there were these, and ``+`` as or later.
The German word "mit" is not the license: in small letters it counts only beside
a word for a license, or in an address.

Where to align: a template is tried only in texts that hold its telling words,
or enough of its others, in windows of twice its length around them, then in closer ones.

Defined results: null and empty texts have no license; of equally good
templates the name decides; a license at several places has one place each;
long texts are scanned whole, in windows; an empty table gives no rows; rows are independent, so repeated rows and null ids change nothing; further
columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_io import map_rows

_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
_MARKED = re.compile(r"\[\[(.*?)\]\]", re.DOTALL)
_VERSION = re.compile(r"v?(\d{1,2}(?:\.\d{1,2})*)")
_SPDX = re.compile(r"SPDX-License-Identifier:[\x20\t]*", re.IGNORECASE)
_SPDX_TOKEN = re.compile(r"[\x20\t]*([A-Za-z0-9][A-Za-z0-9.\-]*\+?|[()])")
_SHORT = re.compile(r"(?:[al]?gpl|mpl|epl)v?\d[\d.]*")
#: Words that name a license or tell its variants apart.
TELLING = frozenset(
    """mit isc bsd 0bsd apache mozilla mpl eclipse epl boost bsl zlib unlicense unencumbered gnu gpl lgpl agpl gfdl affero lesser library
    cc cc0 creative commons by nc sa nd noncommercial sharealike noderivatives noderivs attribution zero simplified new modified later newer only style rights reserved spdx""".split()
)
#: Words that are telling only in names: elsewhere they are everyday words.
_EVERYDAY = frozenset("by new newer only style library later zero rights reserved modified simplified creative commons attribution".split())


@dataclass(frozen=True)
class Template:
    license: str
    kind: str  # name, notice or text
    words: tuple[str, ...]
    marked: tuple[tuple[str, ...], ...] = ()

    def telling(self) -> frozenset[str]:
        return frozenset(w for w in self.words if is_telling(w, self.kind)) if self.kind != "text" else frozenset()


def is_telling(word: str, kind: str) -> bool:
    return bool(_VERSION.fullmatch(word) or _SHORT.fullmatch(word)) or word in TELLING and (kind == "name" or word not in _EVERYDAY)


_LICENSED = re.compile(r"[\s\-]+(?:(?i:licen[sc]e|lizenz)|style)")
_LICENSED_BEFORE = re.compile(r"(?i:licen[sc]e[ds]?|lizenz|under)[\s:\-]+\Z|/\Z")


def split_words(text: str) -> list[tuple[int, int, str]]:
    """(start, end, word) in lower case; a version's leading v is left out, and a plus behind it is "later"."""
    out = []
    for m in _WORD.finditer(text):
        w = m[0].lower()
        v = _VERSION.fullmatch(w)
        if w == "mit" and m[0] != "MIT" and not _LICENSED.match(text, m.end()) and not _LICENSED_BEFORE.search(text, max(0, m.start() - 16), m.start()):
            w = "mit-"
        out.append((m.start(), m.end(), v[1] if v else w))
        if text[m.end() : m.end() + 1] == "+" and w[-1].isdigit():
            out.append((m.end(), m.end() + 1, "later"))
    return out


def template(license: str, kind: str, text: str) -> Template:
    words = lambda t: tuple(w for _, _, w in split_words(t))
    return Template(license, kind, words(text.replace("[[", "").replace("]]", "")), tuple(words(m) for m in _MARKED.findall(text)))


def written(text: str) -> list[Template]:
    """Templates of a file in which "@ id kind" begins each."""
    out = []
    for part in re.split(r"^@ ", text, flags=re.MULTILINE)[1:]:
        head, _, body = part.partition("\n")
        out.append(template(*head.split(), body))
    return out


def families() -> list[Template]:
    """Names of licenses that come in versions and variants, by rule, and the short identifiers of all."""
    out = []
    for (short, name), v in product({"": "", "L": "Lesser ", "A": "Affero "}.items(), ("2", "2.1", "3")):
        if (v == "2.1") != (short == "L" and v != "3") or (short == "A" and v != "3"):
            continue
        id_, full = f"{short}GPL-{v}{'' if '.' in v else '.0'}", f"GNU {name}General Public License"
        dotted = () if "." in v else (f"{full}, version {v}.0", f"{full} v{v}.0", f"{short}GPL v{v}.0", f"{short}GPLv{v}.0")
        for text in (*dotted, f"{full}, version {v}", f"{full} v{v}", f"{full} {v}", f"GNU {short}GPL v{v}", f"{short}GPL version {v}", f"{short}GPL {v}", f"{short}GPLv{v}"):
            out.append(template(f"{id_}-only", "name", text))
            for later in (", or later", ", or newer", ", or any later version", ", or (at your option) any later version", "+"):
                out.append(template(f"{id_}-or-later", "name", f"{text}{later}"))
        for host, end in product(("gnu.org", "www.gnu.org"), ("", ".html", ".txt", ".en.html")):
            out.append(template(f"{id_}-only", "name", f"{host}/licenses/{short.lower()}gpl-{v}{'' if '.' in v else '.0'}{end}"))
        out.append(template(f"{id_}-only", "name", f"This work is licensed under the {full}, version {v}."))
        out.append(
            template(
                f"{id_}-or-later", "notice",
                f"This program is free software: you can redistribute it and/or modify it under the terms of the [[{full}]] as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.",
            )
        )
        date = {"GPL-2.0": "June 1991", "GPL-3.0": "29 June 2007", "LGPL-2.1": "February 1999", "LGPL-3.0": "29 June 2007", "AGPL-3.0": "19 November 2007"}[id_]
        out.append(
            template(
                f"{id_}-text", "notice",
                f"{full} Version {v}, {date} Copyright (C) Free Software Foundation, Inc. [[Everyone is permitted to copy and distribute verbatim copies of this license document]], but changing it is not allowed.",
            )
        )
    for v in ("1.1", "2.0"):
        out += [template(f"MPL-{v}", "name", t) for t in (f"Mozilla Public License, version {v}", f"Mozilla Public License {v}", f"MPL {v}")]
    for v in ("1.0", "2.0"):
        out += [template(f"EPL-{v}", "name", t) for t in (f"Eclipse Public License, version {v}", f"Eclipse Public License {v}", f"Eclipse Public License - v {v}", f"EPL {v}")]
    long = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
    for parts, v in product(("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"), ("2.0", "2.5", "3.0", "4.0")):
        full = "-".join(long[p] for p in parts.split("-"))
        where = {"4.0": "International", "3.0": "Unported"}.get(v, "Generic")
        texts = [f"CC {parts} {v}", f"CC {parts} version {v}", f"Licensed under CC {parts} {v}.", f"Creative Commons {full} {v}", f"Creative Commons {full} {v} {where} License", f"{full} {v} {where}", f"{full} {v}"]
        texts.append(f"This work is licensed under a Creative Commons {full} {v} {where} License.")
        texts.append(f"creativecommons.org/licenses/{parts.lower()}/{v}")
        out += [template(f"CC-{parts}-{v}", "name", t) for t in texts]
    zero = ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0", "creativecommons.org/publicdomain/zero/1.0")
    names = {
        "CC0-1.0": zero,
        "MIT": ("License: MIT", "MIT licensed", "licensed under MIT", "opensource.org/licenses/MIT", "opensource.org/license/mit"),
        "Apache-2.0": ("Apache 2.0", "License: Apache 2.0", "www.apache.org/licenses/LICENSE-2.0", "apache.org/licenses/LICENSE-2.0", "opensource.org/licenses/Apache-2.0"),
        "BSD-3-Clause": ("3-Clause BSD License", "BSD 3-Clause", "opensource.org/licenses/BSD-3-Clause"), "BSD-2-Clause": ("2-Clause BSD License", "BSD 2-Clause", "opensource.org/licenses/BSD-2-Clause"),
        "ISC": ("License: ISC", "opensource.org/licenses/ISC"), "MPL-2.0": ("mozilla.org/MPL/2.0", "www.mozilla.org/MPL/2.0", "opensource.org/licenses/MPL-2.0"),
    }
    return out + [template(i, "name", t) for i, texts in names.items() for t in texts]


def identifiers(known: list[Template]) -> dict[str, str]:
    """SPDX identifiers in small letters, older ones among them, and what they are called here."""
    ids = {t.license for t in known if t.license not in ("all-rights-reserved", "BSD") and not t.license.endswith("-text")}
    out = {i.lower(): i for i in ids}
    for i in ids:
        if i.endswith("-or-later"):
            stem = i.removesuffix("-or-later")
            out[f"{stem}+".lower()] = i
            out[stem.lower()] = f"{stem}-only"
    return out


def expression_ids(text: str, at: int) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of an SPDX expression that begins at a place, as far as it is one."""
    out, wanted, depth = [], True, 0
    while m := _SPDX_TOKEN.match(text, at):
        t = m[1]
        if wanted and t == "(":
            depth += 1
        elif wanted and t != ")" and t.upper() not in ("AND", "OR", "WITH"):
            out.append((m.start(1), m.end(1), t))
            wanted = False
        elif not wanted and t == ")" and depth:
            depth -= 1
        elif not wanted and t in ("AND", "OR", "and", "or"):
            wanted = True
        elif not wanted and t in ("WITH", "with") and (e := _SPDX_TOKEN.match(text, m.end())):
            m = e  # an exception's name
        else:
            break
        at = m.end()
    return out


def templates() -> list[Template]:
    known = written(files(__package__).joinpath("licenses.txt").read_text(encoding="utf-8")) + families()
    return known


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (by first) whose second increases, by patience piles."""
    tops, top_at, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(top_at[pile - 1] if pile else -1)
        tops[pile : pile + 1], top_at[pile : pile + 1] = [j], [k]
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, a bit for each word of b."""
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]  # a zero: the length grows at this word of b
    for w in a:
        free = rows[-1]
        hit = free & where.get(w, 0)
        rows.append((free + hit | free - hit) & full)
    out, i, j = [], len(a), len(b) - 1
    while i and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif rows[i - 1] >> j & 1:
            i -= 1
            out.append((i, j))
            j -= 1
        else:
            i -= 1
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of words of a aligned with words of b, both ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i == i2 or j == j2:
            continue
        once_a, once_b = ({w for w, c in Counter(x).items() if c == 1} for x in (a[i:i2], b[j:j2]))
        at = {w: k for k, w in enumerate(b[j:j2], j) if w in once_b}
        anchors = increasing([(k, at[w]) for k, w in enumerate(a[i:i2], i) if w in once_a and w in at])
        if anchors:
            out += anchors
            ends = [(i - 1, j - 1), *anchors, (i2, j2)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:]) if p + 1 < q and r + 1 < s]
        else:
            out += [(i + p, j + q) for p, q in common(a[i:i2], b[j:j2])]
    return sorted(out)


def densest(pairs: list[tuple[int, int]], size: int, need: int) -> tuple[float, int, int, int]:
    """Of runs of at least ``need`` aligned pairs: (weight, pairs, first word, last word) of the best.

    The weight is the number of pairs, times their share of all words that the
    template and the place have between them. For long templates the run is the
    one of the greatest sum of a point a pair less a quarter of one for each other
    word between: one pass, and near the heaviest.
    """
    if len(pairs) > 400:
        return _run(pairs, size, need)
    best = (0.0, 0, 0, 0)
    for p in range(len(pairs) - need + 1):
        for q in range(len(pairs), p + need - 1, -1):
            n, first, last = q - p, pairs[p][0], pairs[q - 1][0]
            best = max(best, (n * n / (size + last - first + 1 - n), n, first, last))
    return best


def _run(pairs: list[tuple[int, int]], size: int, need: int) -> tuple[float, int, int, int]:
    score, start, best = 0.0, 0, (0.0, 0, 0)
    for k, (at, _) in enumerate(pairs):
        gap = (at - pairs[k - 1][0] - 1) / 4 if k else 0.0
        if score <= gap:
            score, start = 0.0, k
        else:
            score -= gap
        score += 1
        best = max(best, (score, start, k))
    _, p, q = best
    p, q = min(p, max(0, q + 1 - need)), max(q, min(len(pairs) - 1, p + need - 1))
    n, first, last = q - p + 1, pairs[p][0], pairs[q][0]
    return (n * n / (size + last - first + 1 - n), n, first, last) if n >= need else (0.0, 0, 0, 0)


@dataclass(frozen=True)
class Found:
    weight: float
    coverage: float
    matched: int
    license: str
    first: int
    last: int


class Matcher:
    """One template made ready."""

    def __init__(self, t: Template, least: float):
        self.t, self.size, self.least = t, len(t.words), least
        self.need = -(-len(t.words) * round(1000 * least) // 1000)
        self.telling = t.telling()
        marked = [w for m in t.marked for w in m]
        if not self.telling and not marked:
            raise ValueError(f"{t.license}: a template needs telling words or a marked passage")
        self.spare = [len(m) // 10 for m in t.marked]
        # words one of which any text that fits must hold, and words near which it lies
        self.hubs = set(t.words) if t.kind == "text" else self.telling or set(marked)
        self.roots = {max(self.telling, key=lambda w: (w not in _EVERYDAY, len(w), w))} if self.telling else set(sorted(set(t.marked[0]), key=lambda w: (-len(w), w))[: self.spare[0] + 1])

    def fits(self, part: list[str], pairs: list[tuple[int, int]]) -> Found | None:
        if len(pairs) < self.need:
            return None
        weight, n, first, last = densest(pairs, self.size, self.need)
        place = part[first : last + 1]
        if n < (self.least if self.t.kind != "text" else self.least - 0.2) * len(place):
            return None
        here = set(place)
        if not self.telling <= here or self.telling and any(w not in self.telling and is_telling(w, self.t.kind) for w in here):
            return None
        for m, spare in zip(self.t.marked, self.spare, strict=True):
            if len(common(place, list(m))) < len(m) - spare:
                return None
        return Found(weight, n / self.size, n, self.t.license, first, last)

    def places(self, words: list[str], at: dict[str, list[int]]) -> list[Found]:
        hits = sorted(k for w in self.hubs for k in at.get(w, ()))
        found, size = [], self.size
        cuts = [0, *(k for k in range(1, len(hits)) if hits[k] - hits[k - 1] > size), len(hits)] if hits else [0]
        for p, q in zip(cuts, cuts[1:]):
            a, b = max(0, hits[p] - size), min(len(words), hits[q - 1] + size + 1)
            # windows of twice the template meet every copy; a worn one between others' words needs the closest windows
            for length, step in ((2 * size, max(1, size // 2)), (int(size / self.least), max(1, size // 8))):
                here = []
                for start in range(a, max(a + 1, b - length + step), step):
                    part = words[start : start + length]
                    if self.telling <= set(part) and (got := self.fits(part, aligned(part, list(self.t.words)))):
                        here.append(Found(got.weight, got.coverage, got.matched, got.license, got.first + start, got.last + start))
                found += here
                if here:
                    break
        return found


class LicenseScanner:
    def __init__(self, known: list[Template], least: float = 0.8):
        self.matchers = [Matcher(t, least) for t in dict.fromkeys(known)]
        self.ids = identifiers(known)
        self.roots = set().union(*(m.roots for m in self.matchers))
        # a root is looked for only if no other root lies inside it
        self.inside = sorted(r for r in self.roots if not any(o != r and o in r for o in self.roots))

    def scan(self, text: str | None) -> list[tuple[float, int, str, int, int]]:
        """(coverage, aligned words, license, start, end) of each place, the heaviest first; places do not overlap."""
        low = (text or "").lower()
        named = [x for m in _SPDX.finditer(text or "") for x in expression_ids(text, m.end()) if x[2].lower() in self.ids]
        if not named and not any(r in low for r in self.inside):
            return []
        parts = split_words(text)
        words = [w for _, _, w in parts]
        at: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            at.setdefault(w, []).append(k)
        starts = [a for a, _, _ in parts]
        found = []
        for a, b, i in named:  # heavier than any name
            first, last = bisect_left(starts, a), bisect_left(starts, b) - 1
            found.append(Found(float("inf"), 1.0, last - first + 1, self.ids[i.lower()], first, last))
        for m in self.matchers:
            if (m.telling <= at.keys() if m.telling else not m.roots.isdisjoint(at.keys())) and sum(w in at for w in m.t.words) >= m.need:
                found += m.places(words, at)
        taken, out = [], []
        for f in sorted(set(found), key=lambda f: (-f.weight, f.license, f.first)):
            if all(f.last < a or f.first > b for a, b in taken):
                taken.append((f.first, f.last))
                out.append((f.coverage, f.matched, f.license, parts[f.first][0], parts[f.last][1]))
        return out


_SCANNERS: dict[tuple, LicenseScanner] = {}


def license_scan(docs: DataFrame, known: list[Template] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, license (the best, null for none), coverage, n_matched, start, end (of its aligned words), licenses (all found, best first), places (license:start:end of each, in the order of the text)."""
    known = templates() if known is None else known
    which = (least, *known)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if which not in _SCANNERS:
            _SCANNERS[which] = LicenseScanner(known, least)
        got = [_SCANNERS[which].scan(t) for t in batch.column(1).to_pylist()]
        best = [g[0] if g else (0.0, 0, None, None, None) for g in got]
        cols = [pa.array([b[k] for b in best], kind) for k, kind in ((2, pa.string()), (0, pa.float64()), (1, pa.int64()), (3, pa.int64()), (4, pa.int64()))]
        cols += [pa.array([",".join(dict.fromkeys(f[2] for f in g)) for g in got], pa.string()), pa.array([",".join(f"{f[2]}:{f[3]}:{f[4]}" for f in sorted(g, key=lambda f: f[3])) for g in got], pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "license", "coverage", "n_matched", "start", "end", "licenses", "places"])

    return map_rows(docs, [id_col, text_col], rows, f"`{id_col}` bigint, license string, coverage double, n_matched bigint, start bigint, end bigint, licenses string, places string")
