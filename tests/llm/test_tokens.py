import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from formloom.llm.packing import fullest, minimum_slack_plan, pack
from formloom.llm.piece_codec import PieceCodec, decode_pieces, encode_pieces, viterbi
from formloom.llm.token_counts import TokenCounter, count_tokens, scan
from formloom.llm.token_files import TokenFile, read_token_files, write_token_files
from formloom.llm.word_ids import WordEncoder

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["a", "B", " ", "  ", ". ", ", ", "\n", "'", "s", "re", "'ll", "ve", "1", "23", "!", "...", "é", "É", "İ", "K", "ß", "中", " ", " ", "\t", "The", "ing", "<|endoftext|>", "<|STARTOFTEXT|>", "ſ", "Ⅷ", "😀", "\x1c", "\x85", "é", "́", "한", "ᄒ", "ᅡ", "Σ", "<|", "▁", "\x00"]


def texts(n, size=25):
    rng = random.Random(n)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, size))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_counts_are_the_librarys(library, chunk):
    c = TokenCounter(BYTES, chunk)
    for t in texts(1500):
        assert c.count(t) == len(library.encode(t, add_special_tokens=False)), repr(t)


def test_long_text_in_bounded_memory(library):
    """Words that never occur twice: the compiled part begins anew many times within the text."""
    import resource

    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randrange(4, 12))) for _ in range(250_000))
    want = len(library.encode(text, add_special_tokens=False).ids)
    c = TokenCounter(public_tokenizers.path("byte_bpe_50k.json"))
    c.machine.max_edges, most, reset, begun = 100_000, 0, c.machine.reset, 0

    def counted_reset():
        nonlocal most, begun
        most, begun = max(most, c.machine.edges), begun + 1
        reset()

    c.machine.reset = counted_reset
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert c.count(text) == want and begun > 5
    assert most < 100_000 + 4 * c.chunk_chars and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_counts_survive_a_reset(library):
    c = TokenCounter(BYTES)
    c.machine.max_edges = 200
    for t in texts(300):
        assert c.count(t) == len(library.encode(t, add_special_tokens=False))


def test_state_maps(library, monkeypatch):
    """Maps of chunks compose to the whole text's, and no chunk of ordinary text is entered twice."""
    c = TokenCounter(BYTES, 100)
    text = "Some words, 12 numbers and more: naïve café – don't you think so?  中文字符 also. " * 60
    c.count(text)
    maps = [c.chunk_map(c.entries(text[k - 100 : k]) if k else [c.machine.key(c.machine.start)], text[k : k + 100]) for k in range(0, len(text), 100)]
    assert sum(map(len, maps)) <= 1.1 * len(maps)
    one, two = c.compose(c.compose(maps[0], maps[1]), maps[2]), c.compose(maps[0], c.compose(maps[1], maps[2]))
    assert one == two and one[c.machine.key(c.machine.start)][1] == len(library.encode(text[:300], add_special_tokens=False))
    ran = []
    run = c.machine.run
    monkeypatch.setattr(c.machine, "run", lambda node, t: (ran.append(len(t)), run(node, t))[1])
    assert c.count(text) == len(library.encode(text, add_special_tokens=False)) and ran.count(100) <= 1.1 * len(maps) + 5 * len(maps)


def test_scan():
    for n in range(20):
        assert scan([chr(97 + k) for k in range(n)], lambda a, b: a + b) == ["abcdefghijklmnopqrst"[: k + 1] for k in range(n)]


def test_count_tokens(odd, none, library):
    got = sorted(map(tuple, count_tokens(odd, BYTES).collect()), key=repr)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(library.encode(r["text"] or "", add_special_tokens=False)), n > 512) for r in odd.collect()), key=repr)
    assert got == want and count_tokens(none, BYTES).count() == 0


def test_word_ids_are_the_librarys():
    e, t = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for x in texts(3000):
        assert array("I", e.encode([x])[0]).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_fullest_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(0, 25)
        used = fullest(counts, room, sorted(counts, reverse=True))
        total = sum(n * k for n, k in used)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        assert total == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in used)


def test_plan_uses_everything_in_few_bins():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 101), 60)}
    plan = minimum_slack_plan(counts, 100)
    back: dict[int, int] = {}
    for often, used in plan:
        assert sum(n * k for n, k in used) <= 100
        for n, k in used:
            back[n] = back.get(n, 0) + often * k
    assert back == counts
    bins: list[int] = []  # first fit, longest first
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        at = next((j for j, free in enumerate(bins) if free >= n), None)
        if at is None:
            bins.append(100 - n)
        else:
            bins[at] -= n
    assert sum(o for o, _ in plan) <= len(bins)


def test_pack(odd, none):
    t = Tokenizer.from_file(WORDS)
    out = pack(odd, WORDS, 64).toPandas()
    want = []
    for r in odd.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    got = [(None if x.doc_id != x.doc_id else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in out.itertuples()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64
    assert pack(none, WORDS).count() == 0


def test_token_files(odd, none, tmp_path):
    t = Tokenizer.from_file(WORDS)
    uri = f"file://{tmp_path}"
    manifest = write_token_files(odd, WORDS, uri, row_len=16)
    got = sorted(read_token_files(manifest, uri).collect(), key=lambda r: r["start"])
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at = 0
    for g, r in zip(got, rows, strict=True):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    m = max(manifest.collect(), key=lambda r: r["n_ids"])
    f = TokenFile(uri, (m["ids_file"], m["index_file"]))
    n_rows = -(-m["n_ids"] // 16)
    whole = np.concatenate([f.row(k)[0][f.row(k)[1]] for k in range(n_rows)])
    assert len(whole) == m["n_ids"] and np.array_equal(whole, np.concatenate(list(f.ids(0, m["n_ids"]))))
    assert np.array_equal(whole[5:300], np.concatenate(list(f.ids(5, 295))))
    empty = write_token_files(none, WORDS, f"{uri}/none")
    assert empty.count() == 0 and read_token_files(empty, f"{uri}/none").count() == 0


def test_pieces_are_the_librarys(odd, none):
    c, s = PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for x in texts(3000):
        packed = c.encode(x)[0]
        assert array("I", packed).tolist() == s.encode(x), repr(x)
        assert c.decode(packed) == s.decode(s.encode(x)) == x.replace("▁", " ")
    enc = encode_pieces(odd, PIECES)
    assert all(r["round_trip"] and r["n_ids"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in enc.collect())
    assert sorted((r["text"] for r in decode_pieces(enc, PIECES).collect())) == sorted(r["text"] or "" for r in odd.collect())
    assert encode_pieces(none, PIECES).count() == 0


def test_viterbi_window_is_bounded():
    c, s = PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    for text in ("".join(rng.choice("thenation") for _ in range(5000)), "ab" * 2000, "中文" * 1000):
        out: list[str] = []
        commits, most = viterbi(c.model, text, out.append)
        assert most <= 2 * c.model.longest + 2 and commits > len(text) / 200
        assert "".join(out) == text and array("I", c.encode(text)[0]).tolist() == s.encode(text)
