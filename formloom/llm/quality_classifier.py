"""A quality classifier from weak labels.

Overlapping heuristic labellers each vote for a class (clean, junk, toxic) or
abstain, and so does a table of reviewed labels where it covers a text.  Three
of them look for abuse by words that the reviewed rows themselves teach: those
whose beginnings or whole forms occur in toxic texts far more often than in
clean ones of the same language (an excess added up over languages, in standard
errors).  A text's rate of such words is held against the rate that best parts
toxic from clean rows.  Rows that taught are voted on with words learnt from the
other folds only, so no labeller has seen the rows it is measured on.

How often each labeller is right is not known beforehand: expectation
maximisation over the counts of vote patterns (all texts; a bounded number of
patterns, however many texts) estimates for each labeller how it votes on each
class, and the posterior of every pattern.  The posteriors are the soft labels
of a linear scorer over hashed words, beginnings of words and labellers' votes,
fitted on ``train_rows`` texts: reviewed ones where there are any, those of
smallest id hash.  The scorer judges every whole text; a text stays if it is
more likely clean than not.

Defined results: null and empty texts have no words; no word speaks against
them and the scorer's bias decides; repeated rows and null ids are judged like
any other; long texts are judged whole; a text exactly as likely clean as not
stays, and of equally likely classes the first named is the label; reviewed rows
without id, quality and toxic have no say, and of several for one id the graver
counts; an empty table gives no rows; without reviewed labels the heuristics
label alone, and as none of them knows abuse, nothing is called toxic; without a
column of languages, or where it is null, texts are of one language; further
columns are not read (``quality_kept`` passes them through).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_io import bound_batches, map_rows

CLASSES = ("clean", "junk", "toxic")
ABSTAIN = 3
BITS = 19
#: Hashes of a word: itself, and its first three, four and five letters.
STRIDE = 4
#: Texts that the label model's start counts for.
PRIOR = 20.0
#: Parts of the reviewed rows; words remembered in a task; languages with words of their own.
FOLDS, REMEMBERED, LANGUAGES = 4, 300_000, 64
_LETTERS = re.compile(r"[^\W\d_]+")
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_MARKS = b"#*$%&|<>!"


class Measured:
    """What labellers and scorer read of one text."""

    __slots__ = ("again", "capitals", "letters", "lines", "lines_again", "n", "per_word", "shouts", "vocabulary")

    def __init__(self, text: str | None):
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = _LETTERS.findall(text.lower())
        self.vocabulary = set(words)
        self.n = n = len(words)
        self.again = 1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0
        without = lambda x: len(data) - len(data.translate(None, x))
        self.per_word, self.shouts = without(_MARKS) / max(1, n), without(b"!") / max(1, n)
        upper, lower = without(_CAPITALS), without(_SMALL)
        self.capitals = upper / max(1, upper + lower)
        self.letters = sum(map(len, words)) / max(1, len(text) - without(b" \t\n\r"))
        lines = [x for x in data.split(b"\n") if x.strip()]
        self.lines, self.lines_again = len(lines), (len(lines) - len(set(lines))) / max(1, len(lines))


def _junk(bad: bool) -> int:
    return 1 if bad else ABSTAIN


#: Each labeller of form: name and vote. They overlap: marks and letters, capitals and shouts, repetition and lines.
LABELLERS = {
    "marks": lambda m: _junk(m.per_word > 0.2),
    "letters": lambda m: ABSTAIN if m.n < 15 else 1 if m.letters < 0.76 else 0 if m.letters > 0.88 else ABSTAIN,
    "capitals": lambda m: _junk(m.n > 4 and m.capitals > 0.4),
    "shouts": lambda m: _junk(m.n > 4 and m.shouts > 0.3),
    "repetition": lambda m: _junk(m.n > 20 and m.again > 0.5),
    "lines": lambda m: _junk(m.lines > 3 and m.lines_again > 0.45),
    "prose": lambda m: 0 if m.per_word < 0.05 and m.capitals < 0.2 and m.shouts < 0.05 and m.again < 0.4 else ABSTAIN,
}
#: Those of learnt words: their rate, twice that rate, and whole words.
LEARNT = ("abuse", "abuse_much", "abuse_words")
#: Reviewed labels vote last.
N_VOTES = len(LABELLERS) + len(LEARNT) + 1
NAMES = (*LABELLERS, *LEARNT)


def word_hashes(word: str) -> tuple[int, int, int, int]:
    """STRIDE hashes; -1 where the word is no longer than that beginning."""
    mask, n, crc = (1 << BITS) - 1, len(word), zlib.crc32
    return (
        crc(word.encode()) & mask, crc(word[:3].encode(), 3) & mask if n > 3 else -1,
        crc(word[:4].encode(), 4) & mask if n > 4 else -1, crc(word[:5].encode(), 5) & mask if n > 5 else -1,
    )


class Telling:
    """What a function of words finds, of the few words where it finds anything; the others are remembered, so many at most."""

    def __init__(self, made):
        self.made, self.found, self.nothing = made, {}, set()

    def __call__(self, words: set[str]) -> list:
        out = []
        for w in words - self.nothing:
            got = self.found.get(w)
            if got is None:
                got = self.made(w)
                if got is None:
                    if len(self.nothing) >= REMEMBERED:
                        self.nothing.clear()
                    self.nothing.add(w)
                    continue
                if len(self.found) < REMEMBERED:
                    self.found[w] = got
            out.append(got)
        return out


@dataclass
class Abuse:
    """Hashes that tell abuse, learnt from all reviewed rows, or without each fold of them; the rate that parts toxic from clean."""

    words: list[frozenset] = field(default_factory=lambda: [frozenset()] * (FOLDS + 1))
    rate: float = 1.0
    folds: dict = field(default_factory=dict)  # of the rows that taught, by id

    def votes(self, hits: int, whole: int, n: int, known: bool) -> tuple[int, ...]:
        """hits: words with a telling hash; whole: those telling as a whole; n: different words; known: whether any word could tell."""
        if not known:
            return (ABSTAIN,) * len(LEARNT)
        share = hits / max(1, n)
        toxic = lambda yes: 2 if yes else ABSTAIN
        if hits == 1 and not whole and share >= self.rate:  # one beginning may be chance
            return (ABSTAIN,) * len(LEARNT)
        return 2 if hits and share >= self.rate else 0, toxic(hits and share >= 2 * self.rate), toxic(whole and share >= self.rate / 2)

    def tells(self, fold: int = FOLDS) -> Telling:
        """Of words that tell abuse, as far as the fold may know: whether as a whole."""
        telling = self.words[fold]

        def made(word: str) -> bool | None:
            own = word_hashes(word)
            return None if telling.isdisjoint(own) else own[0] in telling

        return Telling(made)

    def of_text(self, m: Measured, tells: Telling, fold: int = FOLDS) -> tuple[int, ...]:
        told = tells(m.vocabulary) if self.words[fold] else []
        return self.votes(len(told), sum(told), len(m.vocabulary), bool(self.words[fold]))


def packed(votes: Iterator[int]) -> int:
    """A vote pattern: two bits a labeller."""
    return sum(v << 2 * k for k, v in enumerate(votes))


def once(rows: list[np.ndarray], kinds: list) -> np.ndarray:
    """Which rows to count: of those of a kind that share nearly all words, linked by six least hashes at once, the first; ``rows`` as in ``learn_abuse``."""
    turns = np.random.default_rng(1)
    times = [(turns.integers(1 << 31, size=6, dtype=np.uint32) * 2 + 1, turns.integers(1 << 31, size=6, dtype=np.uint32)) for _ in range(6)]
    out, seen = np.zeros(len(rows), bool), set()
    for k in sorted(range(len(rows)), key=lambda k: rows[k].tobytes()):  # whatever the order they came in
        w = rows[k][::STRIDE].astype(np.uint32)
        keys = {(kinds[k], j, (w[:, None] * a + b).min(axis=0).tobytes() if len(w) else b"") for j, (a, b) in enumerate(times)}
        out[k] = seen.isdisjoint(keys)
        seen |= keys
    return out


def learn_abuse(rows: list[np.ndarray], label: np.ndarray, lang: np.ndarray, fold: np.ndarray, ids: list, first: np.ndarray | None = None, sure: float = 6.0, lift: float = 2.5, least: int = 6) -> Abuse:
    """``rows``: the hashes of each text's words, STRIDE a word.

    A hash tells abuse if toxic rows have it ``lift`` times as often as by the
    share of toxic rows in their language, by ``sure`` standard errors, and
    ``least`` of them do.  Rows of nearly the same words count once (``first``), and
    where there are too few examples for that, nothing is learnt.
    """
    size = 1 << BITS
    first = once(rows, list(zip(lang, label))) if first is None else first
    groups = sorted(set(lang.tolist()), key=lambda g: -(lang == g).sum())

    def count(at: np.ndarray) -> np.ndarray:
        out = np.zeros(size, np.int32)
        for k in range(0, len(at), 500):
            out += np.bincount(np.concatenate([np.unique(rows[j][rows[j] >= 0]) for j in at[k : k + 500]]), minlength=size).astype(np.int32)
        return out

    seen, expected, spread = (np.zeros((FOLDS + 1, size), np.float32) for _ in range(3))
    for n, g in enumerate([*groups[:LANGUAGES], None]):
        here = lang == g if g is not None else ~np.isin(lang, groups[:LANGUAGES])
        held = [[np.nonzero(here & first & (label == c) & (fold == f))[0] for f in range(FOLDS)] for c in (2, 0)]
        toxic, clean = ([count(at) for at in x] for x in held)
        for f in range(FOLDS + 1):
            others = [k for k in range(FOLDS) if k != f]
            n_toxic, n_clean = (sum(len(x[k]) for k in others) for x in held)
            if n_toxic and n_clean:
                share, a = n_toxic / (n_toxic + n_clean), sum(toxic[k] for k in others)
                both = a + sum(clean[k] for k in others)
                seen[f] += a
                expected[f] += share * both
                spread[f] += share * (1 - share) * both
    tells = (seen >= least) & (seen - expected >= sure * np.sqrt(spread)) & (seen + 0.5 >= lift * (expected + 0.5))
    words = [frozenset(np.nonzero(t)[0].tolist()) for t in tells]
    out = Abuse(words, 1.0, dict(zip(ids, fold.tolist())))
    shares = np.array([tells[f][r.reshape(-1, STRIDE)].any(axis=1, where=r.reshape(-1, STRIDE) >= 0).mean() if len(r) else 0.0 for r, f in zip(rows, fold)])
    bad, good = np.sort(shares[(label == 2) & (shares > 0)]), np.sort(shares[label == 0])
    if len(bad) and len(good):
        gain = (len(bad) - np.arange(len(bad))) / len(bad) - (len(good) - np.searchsorted(good, bad)) / len(good)
        best = int(gain.argmax())
        below = good[good < bad[best]]
        out.rate = float((bad[best] + (below[-1] if len(below) else 0.0)) / 2)
    return out


def speaking(cast: np.ndarray, say: np.ndarray) -> np.ndarray:
    """Who has a say on each pattern: those that ever vote, the reviewer where there is a review, the learnt ones where words were learnt."""
    out = np.broadcast_to(say[None, :], cast.shape).copy()
    out[:, -1] &= cast[:, -1] != ABSTAIN
    learnt = slice(len(LABELLERS), len(LABELLERS) + len(LEARNT))
    out[:, learnt] &= (cast[:, len(LABELLERS)] != ABSTAIN)[:, None]
    return out


def posteriors(patterns: np.ndarray, share: np.ndarray, vote: np.ndarray, say: np.ndarray) -> np.ndarray:
    """Of each class for each pattern; ``say``: labellers that ever vote."""
    cast = patterns[:, None] >> 2 * np.arange(N_VOTES)[None, :] & 3
    has_say = speaking(cast, say)
    score = np.log(share)[None, :] + sum(np.log(vote[k][:, cast[:, k]]).T * has_say[:, k : k + 1] for k in range(N_VOTES))
    post = np.exp(score - score.max(axis=1, keepdims=True))
    return post / post.sum(axis=1, keepdims=True)


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class shares, each labeller's vote probabilities by class, and which labellers have a say.

    The start says that a labeller is seldom wrong and often silent, and counts as
    PRIOR texts of each class; what each is worth, silence included, is then read
    off the patterns it had a say on.
    A labeller that never votes has no say, and a class that none votes for no share.
    """
    n_class = len(CLASSES)
    cast = patterns[:, None] >> 2 * np.arange(N_VOTES)[None, :] & 3
    say = (cast != ABSTAIN).any(axis=0)
    named = np.array([(cast == c).any() for c in range(n_class)])
    has_say = speaking(cast, say)
    first = np.full((N_VOTES, n_class, 4), 0.02)
    first[:, np.arange(n_class), np.arange(n_class)] = 0.3
    first[:, :, ABSTAIN] = 1 - first[:, :, :n_class].sum(axis=2)
    first[-1] = 0.02
    first[-1, np.arange(n_class), np.arange(n_class)] = 0.94
    only = lambda x: np.where(named, x, 1e-9) if named.any() else x
    vote, begin = first, np.array([0.7, 0.15, 0.15])
    share = only(begin)
    for _ in range(rounds):
        weight = posteriors(patterns, share / share.sum(), vote, say) * counts[:, None]
        share = only((weight.sum(axis=0) + PRIOR * begin) / (weight.sum() + PRIOR))
        seen = np.stack([np.stack([weight[(cast[:, k] == v) & has_say[:, k]].sum(axis=0) for v in range(4)], axis=1) for k in range(N_VOTES)])
        vote = (seen + PRIOR * first) / (seen.sum(axis=2, keepdims=True) + PRIOR)
    return share / share.sum(), vote, say


def against(votes: list[int]) -> list[int]:
    """Hashes of the votes against a text."""
    return [zlib.crc32(f"={name}{v}!".encode()) & ((1 << BITS) - 1) for name, v in zip(NAMES, votes) if v in (1, 2)]


def telling(rows: list[np.ndarray], target: np.ndarray, sure: float = 4.0, least: float = 6.0) -> np.ndarray:
    """Log-odds of each hash for each class against the first, where above none by ``sure`` standard errors and ``least`` texts of the class have it; else zero.

    Shares of a class start from those of all texts, which count as PRIOR texts of
    it: of a class that hardly any text is of, nothing is known, so nothing tells it.
    Words found alike in all classes would only drown the few that tell, the
    more so the longer the text, and so would words that speak for clean.
    """
    size, k = 1 << BITS, len(CLASSES)
    n = np.zeros((size, k), np.float32)
    for part in np.array_split(np.arange(len(rows)), max(1, -(-len(rows) // 500))):
        of = np.repeat(part, [len(rows[r]) for r in part])
        at = np.concatenate([rows[r] for r in part])
        n += np.stack([np.bincount(at, target[of, c], size) for c in range(k)], axis=1)
    total = target.sum(axis=0)
    pooled = n.sum(axis=1, keepdims=True) / total.sum()
    share = ((n + PRIOR * pooled) / (total + PRIOR)).clip(1e-9, 1 - 1e-6)
    odds = np.log(share / (1 - share))
    error = np.sqrt(1 / (n + 0.5) + 1 / (n[:, :1] + 0.5))
    lift = odds - odds[:, :1]
    return np.where((lift > sure * error) & (n >= least), lift, 0.0)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, epochs: int = 10, batch: int = 256, rate: float = 0.05) -> np.ndarray:
    """Weights (hash, class) of a multinomial logistic scorer; the last row is the bias. The same rows in the same order give the same weights.

    It starts from the telling hashes' log-odds and moves those only.
    """
    size, k = 1 << BITS, len(CLASSES)
    weight, square = np.zeros((size + 1, k)), np.full(size + 1, 1e-6)
    if not rows:
        return weight
    weight[:size] = 0.3 * telling(rows, target)
    live = weight.any(axis=1)
    weight[size] = np.log(target.mean(axis=0) + 1e-6)
    rows = [r[live[r]] for r in rows]
    turns = np.random.default_rng(0)
    for _ in range(epochs):
        for part in np.array_split(turns.permutation(len(rows)), -(-len(rows) // batch)):
            of = np.repeat(np.arange(len(part)), [len(rows[r]) for r in part])
            at = np.concatenate([rows[r] for r in part])
            logit = np.stack([np.bincount(of, weight[at, c], len(part)) for c in range(k)], axis=1) + weight[size]
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = (p - target[part]) / len(part)
            which, back = np.unique(at, return_inverse=True)
            grad = np.stack([np.bincount(back, off[of, c], len(which)) for c in range(k)], axis=1)
            square[which] += (grad**2).sum(axis=1)
            weight[which] -= rate * grad / np.sqrt(square[which, None])
            weight[size] -= rate * off.sum(axis=0)
    return weight


class Scorer:
    def __init__(self, weight: np.ndarray, abuse: Abuse):
        self.weight, self.abuse = weight.astype(np.float32), abuse
        self.live = frozenset(np.nonzero(self.weight[:-1].any(axis=1))[0].tolist())
        self._words = None

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def _word(self, word: str) -> tuple[frozenset, bool, bool] | None:
        """The hashes with a weight; whether the word tells abuse, and as a whole."""
        own, telling = word_hashes(word), self.abuse.words[FOLDS]
        if self.live.isdisjoint(own) and telling.isdisjoint(own):
            return None
        return self.live.intersection(own), not telling.isdisjoint(own), own[0] in telling

    def __call__(self, text: str | None) -> np.ndarray:
        if self._words is None:
            self._words = Telling(self._word)
        m, found, hits, whole = Measured(text), set(), 0, 0
        for live, hit, word in self._words(m.vocabulary):
            found |= live
            hits += hit
            whole += word
        form = [vote(m) for vote in LABELLERS.values()]
        found.update(against([*form, *self.abuse.votes(hits, whole, len(m.vocabulary), bool(self.abuse.words[FOLDS]))]))
        logit = self.weight[sorted(found)].sum(axis=0, dtype=np.float64) + self.weight[-1]
        p = np.exp(logit - logit.max())
        return p / p.sum()


def _sample(texts: DataFrame, labels: DataFrame | None, train_rows: int) -> pa.Table:
    """Of at most ``train_rows`` texts, reviewed ones where there are any: id, lang, label, the votes on form, and the words' hashes."""
    chosen = texts.withColumn("label", F.lit(ABSTAIN))
    if labels is not None:
        some = labels.where(F.col("label").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(train_rows)
        reviewed = texts.join(F.broadcast(some), "id")  # at most train_rows ids
        chosen = chosen if reviewed.isEmpty() else reviewed
    drawn = chosen.orderBy(F.xxhash64("id"), F.xxhash64("text")).limit(train_rows).repartition(16)

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = [Measured(t) for t in batch.column(2).to_pylist()]
        form = pa.array([packed(vote(x) for vote in LABELLERS.values()) for x in m], pa.int64())
        at = pa.array([[h for w in sorted(x.vocabulary) for h in word_hashes(w)] for x in m], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), batch.column(3), form, at], names=["id", "lang", "label", "form", "at"])

    return map_rows(drawn, ["id", "lang", "text", "label"], hashed, "id string, lang string, label int, form bigint, at array<int>").toArrow()


def _given_away(chunks: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """The rows of chunks, which go one by one."""
    while chunks:
        values, ends = chunks.pop(0)
        yield from (values[a:b] for a, b in zip(ends, ends[1:]))


def fit(docs: DataFrame, reviewed: DataFrame | None = None, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Scorer, dict]:
    """The scorer, and what the label model found: class shares and each labeller's vote probabilities.

    ``reviewed`` has id, quality and toxic (0 or 1). The driver gets the counts
    of vote patterns and ``train_rows`` rows of hashes.
    """
    bound_batches(docs.sparkSession)
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(lang, F.lit("")).alias("lang"), docs[text_col].alias("text"))
    labels = None
    if reviewed is not None:
        label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
        labels = reviewed.select(reviewed[id_col].alias("id"), label.alias("label")).where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    train = _sample(texts, labels, train_rows)
    chunks = [(x.values.to_numpy(), x.offsets.to_numpy()) for x in train.column("at").chunks]
    ids, label, form, langs = (train.column(c).to_pylist() for c in ("id", "label", "form", "lang"))
    del train
    rows = [values[a:b] for values, ends in chunks for a, b in zip(ends, ends[1:])]
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids], int)
    label = np.array(label, int)
    first = once(rows, list(zip(langs, label.tolist())))  # copies would make all words of a text tell
    abuse = learn_abuse(rows, label, np.array(langs, object), fold, ids, first)
    shared = docs.sparkSession.sparkContext.broadcast(abuse)  # some thousand hashes, and train_rows ids

    def cast(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        learnt, out = shared.value, []
        tells = [learnt.tells(f) for f in range(FOLDS + 1)]
        for i, t in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            m, f = Measured(t), learnt.folds.get(i, FOLDS)
            out.append(packed([*(vote(m) for vote in LABELLERS.values()), *learnt.of_text(m, tells[f], f)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["id", "pattern"])

    kind = texts.schema["id"].dataType.simpleString()
    voted = map_rows(texts, ["id", "text"], cast, f"id {kind}, pattern bigint")
    voted = voted.join(labels, "id", "left") if labels is not None else voted.withColumn("label", F.lit(ABSTAIN))
    pattern = F.col("pattern").bitwiseOR(F.shiftleft(F.coalesce("label", F.lit(ABSTAIN)).cast("bigint"), 2 * (N_VOTES - 1)))
    counted = voted.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    patterns, counts = (np.array([r[k] for r in counted], np.int64) for k in (0, 1))
    share, vote, say = em(patterns, counts)

    del rows  # views; the driver holds one copy of the hashes
    own, cast_on = [], np.zeros(len(ids), np.int64)
    for k, r in enumerate(_given_away(chunks)):
        words, telling = r.reshape(-1, STRIDE).tolist(), abuse.words[fold[k]]
        learnt = abuse.votes(sum(not telling.isdisjoint(w) for w in words), sum(w[0] in telling for w in words), len(words), bool(telling))
        form_votes = [form[k] >> 2 * j & 3 for j in range(len(LABELLERS))]
        cast_on[k] = packed([*form_votes, *learnt, int(label[k])])
        own.append(np.unique(np.concatenate([r[r >= 0], np.array(against([*form_votes, *learnt]), np.int32)])))
    target = posteriors(cast_on, share, vote, say) if own else np.zeros((0, len(CLASSES)))
    order = sorted(np.nonzero(first)[0].tolist(), key=lambda k: (own[k].tobytes(), target[k].tobytes()))  # whatever the order they came in
    return Scorer(fit_linear([own[k] for k in order], target[order]), abuse), {"share": share, "vote": vote, "rate": abuse.rate}


def classify(docs: DataFrame, reviewed: DataFrame | None = None, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, p_clean, p_junk, p_toxic, label, kept."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, reviewed, train_rows, id_col, text_col)[0])

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = np.array([scorer.value(t) for t in batch.column(1).to_pylist()])
        label = pa.array([CLASSES[k] for k in p.argmax(axis=1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k].copy()) for k in range(3)), label, pa.array(p[:, 0] >= 0.5)], names=[id_col, "p_clean", "p_junk", "p_toxic", "label", "kept"])

    return map_rows(docs, [id_col, text_col], rows, f"`{id_col}` bigint, p_clean double, p_junk double, p_toxic double, label string, kept boolean")


def quality_kept(docs: DataFrame, reviewed: DataFrame | None = None, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are more likely clean than not, with docs' columns."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, reviewed, train_rows, id_col, text_col)[0])
    at = docs.columns.index(text_col)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array([bool(scorer.value(t)[0] >= 0.5) for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, docs.columns, rows, docs.schema)
