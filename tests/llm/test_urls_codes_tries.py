"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from formloom.llm.prefix_trie import TURN, LoserTree, conversation_trie, rebuilt, shared
from formloom.llm.registry import URL_RULES, op12_vector_codes, op13_prefix_trie
from formloom.llm.url_filter import PIECE, SIZES, Rules, fit_urls, grams, url_verdicts
from formloom.llm.url_labels import labelled_urls
from formloom.llm.va_codes import VaFile, vector_codes

URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "http://example.org/en/12", "http://xexample.org/en/12", "https://ORG/a?b#c", "ftp://fr.com/fr/x", "http://com/de/", "http://net?x=http://org/", "a://b://c/d", "http://É.Example.com/de/\n1#x", "http://user@x.com:80/fr/", "http://casino-win.net/" + "a" * 30_000, "http://x.org/en/1" * 2]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def test_urls_by_hand(spark):
    rows = [(k if k else None, u, "x") for k, u in enumerate(URLS)] + [(4, URLS[4], "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    labelled = spark.createDataFrame([*labelled_urls(), (None, 1), ("http://x.com/", None)], "url string, block int")
    out = url_verdicts(pages, URL_RULES, labelled).collect()
    assert len(out) == len(rows) and out[0].__fields__[:5] == ["page_id", "host", "path", "rule", "verdict"]
    for r, (i, u, _) in zip(out, rows):
        host, path = host_path(u)
        rule, verdict = rule_of(host, path)
        assert (r.page_id, r.host, r.path, r.rule) == (i, host, path, rule), u
        assert r.verdict == (verdict or ("block" if r.p_block > 0.5 else "allow"))
    assert out[14].verdict == "block" and not url_verdicts(pages.limit(0), URL_RULES, labelled).collect()
    assert {r.verdict for r in url_verdicts(pages, [], labelled.limit(0)).collect()} == {"allow"}


def test_rules_longest_wins():
    rules = Rules([("allow", "org/"), ("block", "b.org/x"), ("allow", "a.b.org/"), ("allow", "b.org/xy"), ("block", "b.org/xy"), ("block", "plain")])
    assert rules.find("c.b.org", "/xyz") == ("block", "b.org/xy")
    assert rules.find("a.b.org", "/q") == ("allow", "a.b.org/")
    assert rules.find("ab.org", "/xy")[1] == "org/" and rules.find("org", "") is None and rules.find("q.plain", "")[0] == "block"
    assert rules.find("." * 100_000 + "plain", "/") == ("block", "plain")


def test_grams_by_hand():
    texts = [("ab", "/c"), ("", ""), ("ab", "/c"), ("x" * (PIECE + 3), "/" + "y" * PIECE)]
    row, at = grams([a for a, _ in texts], [b for _, b in texts])
    per = [set(at[row == k].tolist()) for k in range(len(texts))]
    assert per[0] == per[2] and not per[1]
    marked = ["\x02ab\x03", "\x02/c\x03"]
    assert len(per[0]) == len({(s, m[k : k + n]) for s, m in enumerate(marked) for n in SIZES for k in range(len(m) - n + 1)})
    assert len(per[3]) == 2 * (1 + 1 + 1) * 3 or len(per[3]) >= 15  # ends and the middle, of each size


def test_url_model_on_pages(spark):
    """Hosts of unwanted words are blocked, all others stay; words in no training URL but their parts."""
    urls = [r.url for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()]
    pairs = [host_path(u) for u in urls]
    train = [(*host_path(u), b) for u, b in labelled_urls()]
    p = fit_urls(*([x[k] for x in train] for k in range(3)))([a for a, _ in pairs], [b for _, b in pairs])
    bad = np.array([bool(re.search("casino|bets|ads-|spam|pills|adult", h)) for h, _ in pairs])
    assert bad.sum() > 100 and (p[bad] > 0.5).mean() > 0.98 and (p[~bad] <= 0.5).mean() > 0.995


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) in the order of ids."""
    cut = [[[int(np.floor(256 * np.float64(x))) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)] for _, v, _ in rows]
    book = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((square(x, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        new = [list(b) for b in book]
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[near(p, c[p])[1]].append(c[p])
            for k, xs in held.items():
                new[p][k] = [sum(col) // len(col) for col in zip(*xs)]
        book = new
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by = defaultdict(int)
    for (_, _, label), e in zip(rows, errors):
        by[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, by[label], sha) for (i, _, label), f, e in zip(rows, found, errors)]


@pytest.mark.parametrize("n", [3, 64, 300])
def test_codes_by_hand(spark, n):
    rng = random.Random(n)
    rows = [(k, [rng.choice([0.0, rng.uniform(-1, 1), 0.25]) for _ in range(32)], rng.choice([None, 1, 2])) for k in range(n)]
    odd = [(1000, None, 1), (1001, [0.1] * 31 + [None], 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id bigint, embedding array<float>, label int, code string").repartition(5)
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    got = vector_codes(df).collect()
    assert sorted(tuple(r)[:5] for r in got) == codes_by_hand(rows)
    assert all(r.n_measured <= 16 * min(64, n) for r in got)
    if n == 300:
        assert sum(r.n_measured for r in got) < 0.6 * n * 16 * 64  # the bounds settle the rest


def test_codes_odd_rows(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert vector_codes(spark.createDataFrame([], kind)).collect() == []
    rows = [(None, [1.0] * 16, 1), (1, [], 1), (1, [2.0] * 20, 1), (1, [3e38] * 20, None)]
    got = vector_codes(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 4 and all(r.error == 0 for r in got)  # each is an entry of its own


def test_va_file_bounds():
    rng = np.random.default_rng(1)
    entries, queries = rng.integers(-300, 300, (64, 4)), rng.integers(-400, 400, (500, 4))
    entries[10] = entries[3]
    f = VaFile(entries)
    exact = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    lower, upper = f.bounds(queries)
    assert (lower <= exact).all() and (exact <= upper).all()
    best, error, measured = f.nearest(queries)
    assert (best == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all() and measured.mean() < 32


def trie_by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            nodes[tuple(seqs[c][:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, members in nodes.items():
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(members) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, members in nodes.items():
        ends = hashlib.sha256(",".join(str(c) for c in members if len(seqs[c]) == len(path)).encode()).hexdigest()
        out.append((members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), kids[path], leaves[path], saved[path], ends))
    return sorted(out)


def conversations(seed, n, hot):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        script = rng.choice(["abcabc", "abd", "", "aab"]) if rng.random() < hot else [rng.choice("abc") for _ in range(rng.randrange(9))]
        rows += [(c, k, "user" if k % 2 else None, {"a": "é😀", "b": None, "c": "word " * 3, "d": "x"}[t]) for k, t in enumerate(script)]
    rows += [(None, 1, "a", "b"), (7, None, "system", "first"), (7, 3, "r", "t"), (7, 3, "r", "t"), (100, 0, "", ""), (100, 0, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "hot", "merge_bytes"), [(60, 0.0, 1 << 20), (400, 0.5, 3000), (700, 0.9, 900)])
def test_trie_by_hand(spark, n, hot, merge_bytes):
    """Many tasks for few rows, so that equal conversations and their paths straddle several."""
    rows = conversations(n, n, hot)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, key string").repartition(5)
    for held in (5000, 3):
        got = sorted((tuple(r) for r in conversation_trie(df, merge_bytes, held).collect()), key=lambda r: r[:2])
        assert got == trie_by_hand(rows)
    assert conversation_trie(df.limit(0)).collect() == []


def test_rebuilt_turns(spark):
    rows = [(200, k, "u", f"t{k}") for k in range(8)] + [(201, 0, "u", "own")]
    got = {r.conv_id: r for r in rebuilt(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    h = zlib.crc32(b"201") % 6
    assert len(got[201].chars) == (h + max(0, 1 - h)) and len(got[200].chars) == 8 and len(got[200].key) == 8 * TURN
    assert shared(got[200].key, got[201].key) == min(h, 8)


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    key = lambda: b"".join(bytes([rng.randrange(3)] * TURN) for _ in range(rng.randrange(6)))
    runs = []
    for r in range(k):
        rows = sorted((key(), rng.randrange(50)) for _ in range(rng.randrange(1, 40)))
        runs.append([(x, c, shared(rows[n - 1][0], x) if n else 0) for n, (x, c) in enumerate(rows)])
    tree = LoserTree(runs)
    out = list(tree)
    assert [r[:2] for r, _ in out] == sorted(x[:2] for r in runs for x in r)
    assert all(lcp == (shared(out[n - 1][0][0], r[0]) if n else 0) for n, (r, lcp) in enumerate(out))


@pytest.mark.parametrize(("op", "sql"), [(op12_vector_codes, "op12_vector_codes"), (op13_prefix_trie, "op13_prefix_trie")])
def test_sql(spark, data, op, sql):
    from compare import assert_same, connect

    from formloom.llm.registry import ORACLES

    assert_same(op(spark, data), connect(data), ORACLES[sql])
