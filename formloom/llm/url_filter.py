"""URL filters: rules by host and path, and a logistic regression for all other URLs.

A rule names a host and the beginning of a path; it fits that host and all its
subdomains, and the longest fitting rule decides.  URLs without one are judged
by a logistic regression on hashed character n-grams of host and path (three to
five code points, the ends marked, host and path told apart), trained from a
small table of labelled URLs (``url_labels`` holds one).  Rules are found by looking up the host's
suffixes, so their number does not slow a row down.  The trained weights are one
vector of ``2**BITS`` numbers.

Bounds: the labelled table gives at most ``train_rows`` rows (those of smallest
URL hash) and the rules are a parameter; both and the weights reach the driver,
nothing else does.

Defined results: a null URL, or one without ``://``, has empty host and path, no
rule fits it unless it names the empty host, and the model judges it by the
marked ends alone; ids may be null or repeated; URLs of any length are read
whole; equally likely is ``allow``; of rules alike in length the longer host
wins, of equal ones ``block``; without labelled rows every other URL is allowed;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_io import map_rows

BITS = 18
SIZES = (3, 4, 5)
#: Code points of URLs that are hashed at once.
PIECE = 1 << 19
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (then up to ``?``, ``#`` or the end)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


class Rules:
    """Rules such as ("block", "example.org/es/"), looked up by host."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, dict[str, tuple[str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            held = self.by_host.setdefault(host.translate(str.maketrans(_UPPER, _LOWER)), {})
            if held.get(slash + path, ("",))[0] != "block":
                held[slash + path] = verdict, rule
        self.longest = max(map(len, self.by_host), default=0)
        self.sizes = {h: sorted({len(p) for p in held}, reverse=True) for h, held in self.by_host.items()}

    def suffixes(self, host: str) -> Iterator[str]:
        """Hosts that a rule for this host may name, shortest first."""
        at = len(host)
        while at >= 0 and len(host) - at <= self.longest:
            at = host.rfind(".", 0, at)
            if len(host) - at - 1 <= self.longest:
                yield host[at + 1 :]

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest rule that fits."""
        best, most = None, (-1, -1)
        for h in self.suffixes(host):
            for n in self.sizes.get(h, ()):
                if (hit := self.by_host[h].get(path[:n])) and (len(h) + n, len(h)) > most:
                    best, most = hit, (len(h) + n, len(h))
                    break
        return best


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts of about PIECE code points at once; longer texts in pieces that share SIZES[-1] - 1 code points."""
    rows, held, size = [], [], 0
    for row, t in enumerate(texts):
        for at in range(0, max(1, len(t) - SIZES[-1] + 1), PIECE):
            part = t[at : at + PIECE + SIZES[-1] - 1]
            rows.append(row)
            held.append(part)
            size += len(part)
            if size >= PIECE:
                yield rows, held
                rows, held, size = [], [], 0
    if held:
        yield rows, held


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram bucket that a row has, by row and bucket."""
    keys = [np.empty(0, np.uint64)]
    for salt, texts in enumerate((hosts, paths), 1):
        for rows, held in pieces([f"\x02{t}\x03" for t in texts]):
            code = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            of = np.repeat(np.arange(len(held)), [len(t) for t in held])
            row = np.array(rows, np.uint64)[of]
            for n in SIZES:
                if len(code) < n:
                    continue
                last = len(code) - n + 1
                h = np.full(last, salt * 16 + n, np.uint64)
                for k in range(n):
                    h = (h ^ code[k : last + k]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                inside = of[:last] == of[n - 1 :]
                keys.append(np.unique(row[:last][inside] << np.uint64(BITS) | h[inside] >> np.uint64(64 - BITS)))
    key = np.unique(np.concatenate(keys))
    return (key >> np.uint64(BITS)).astype(np.intp), (key & np.uint64((1 << BITS) - 1)).astype(np.intp)


class UrlModel:
    """Weights of the hashed n-grams; a row's n-grams weigh 1 / sqrt(their number) each."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def __call__(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        row, at = grams(hosts, paths)
        n = np.bincount(row, minlength=len(hosts)).clip(1)
        logit = np.bincount(row, self.weight[at], len(hosts)) / np.sqrt(n) + self.bias
        return 1 / (1 + np.exp(-logit.clip(-500, 500)))


def fit_urls(hosts: list[str], paths: list[str], block: list[int], epochs: int = 12, batch: int = 256, rate: float = 0.5) -> UrlModel:
    """Logistic regression by adaptive gradient steps. The same rows in the same order give the same weights."""
    weight, square = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    y = np.asarray(block, float)
    if not len(y):
        return UrlModel(weight, 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    row, at = grams(hosts, paths)
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    scale = 1 / np.sqrt(np.diff(ends).clip(1))
    turns = np.random.default_rng(0)
    for _ in range(epochs):
        for part in np.array_split(turns.permutation(len(y)), -(-len(y) // batch)):
            own = np.concatenate([at[ends[r] : ends[r + 1]] for r in part])
            of = np.repeat(np.arange(len(part)), ends[part + 1] - ends[part])
            logit = np.bincount(of, weight[own], len(part)) * scale[part] + bias
            off = (1 / (1 + np.exp(-logit)) - y[part]) / len(part)
            which, back = np.unique(own, return_inverse=True)
            grad = np.bincount(back, (off * scale[part])[of], len(which))
            square[which] += grad**2
            weight[which] -= rate * grad / np.sqrt(square[which])
            bias -= rate * float(off.sum())
    return UrlModel(weight, bias)


def split(df: DataFrame, url_col: str, *more: Column) -> DataFrame:
    host, path = host_and_path(df[url_col].cast("string"))
    return df.select(*more, host.alias("host"), path.alias("path"))


def train(labelled: DataFrame, train_rows: int = 20_000) -> UrlModel:
    """The model of ``labelled`` (url, block 0/1); rows without either are not used."""
    known = labelled.where("url is not null and block is not null")
    some = split(known, "url", known["url"], known["block"].cast("int").alias("block")).orderBy(F.xxhash64("url"), "url", "block").limit(train_rows)
    rows = some.select("host", "path", "block").collect()
    return fit_urls(*([r[k] for r in rows] for k in range(3)))


def url_verdicts(pages: DataFrame, rules: Iterable[tuple[str, str]], labelled: DataFrame, train_rows: int = 20_000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (null where none fits), verdict (allow or block), p_block (the model's, whatever the rule)."""
    known = Rules(rules)
    model = pages.sparkSession.sparkContext.broadcast(train(labelled, train_rows))
    rows = split(pages, url_col, pages[id_col].alias(id_col))
    kind = rows.schema[0].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hosts, paths = (batch.column(k).to_pylist() for k in (1, 2))
        p = model.value(hosts, paths)
        hit = [known.find(h, t) for h, t in zip(hosts, paths, strict=True)]
        verdict = [x[0] if x else "block" if q > 0.5 else "allow" for x, q in zip(hit, p.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([x and x[1] for x in hit], pa.string()), pa.array(verdict, pa.string()), pa.array(p)], names=[id_col, "host", "path", "rule", "verdict", "p_block"]
        )

    return map_rows(rows, rows.columns, each, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, p_block double")
