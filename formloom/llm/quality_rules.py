"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Counts of each text (words are runs of anything but ASCII white space) feed
three measures, as integers: symbols in a thousand words, tenths of a
character in the mean word, repeated lines in a thousand.  A sketch of a
measure is its histogram over buckets of ``DIGITS`` leading decimal digits:
single values up to 10,000, within a thousandth beyond, so a bounded number of
counts (9,000 for each further power of ten) whatever the values.  Sketches
merge by adding, the same in whatever order parts arrive; quantiles are exact
to one bucket.  Only the sketch is rounded: a text's own measure meets the
threshold as it is, however large.  Sketches are kept for each language and
source; one with under ``min_rows`` texts is merged into its language's, and
that into the corpus's.  A text fails where a measure lies above the upper
quartile by more than three times the spread of the quartiles (at least
``MARGIN``).  Thresholds are joined to the texts' counts, and the filter reads
both.

Repeated windows: a text whose 5-word windows' hashes are all different has
none.  Otherwise windows are sorted by hash and position, those with equal
neighbours are compared by their words, and the words under equal windows are
counted once.

Defined results: null and empty texts have no words and fail; null language or
source is a group of its own; repeated rows and null ids are judged like any
other; a measure equal to its threshold passes; long texts are counted whole, up
to 2**28 words; an empty table gives no rows; further columns pass through ``quality_filter`` unread, also
ones named like a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_io import keep

_BLANK = " \t\n\x0b\f\r"
_SPLIT, _WORD, _SYMBOL = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]", "[#*$%&|<>]"
_AT = 28  # bits of a window's position
#: Measures of a text: name, value, smallest distance from the upper quartile at which a text fails.
MARGIN = {"symbols": 100, "word_length": 40, "dup_lines": 400}
DIGITS = 4
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _covered(starts: Column, width: int) -> Column:
    """Words under windows that begin at the ascending ``starts``."""
    gaps = F.transform(starts, lambda x, k: F.least(F.coalesce(F.get(starts, k + 1) - x, F.lit(width)), F.lit(width)))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)


def with_counts(docs: DataFrame, text: Column, width: int = 5) -> DataFrame:
    """docs' columns and the counts of ``text``; each array is made once."""
    own = docs.columns
    body = F.coalesce(text, F.lit(""))
    core = F.trim(body, F.lit(_BLANK))
    df = docs.select(*own, body.alias("__t"), F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, _SPLIT)).alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(_WORD))
    hashes = F.transform("__w", lambda x: F.xxhash64(x))
    df = df.select(
        *own, "__w", F.size("__w").cast("bigint").alias("n_words"), F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__t", F.lit(_SYMBOL)).cast("bigint").alias("n_symbols"), lines.alias("__l"), hashes.alias("__h"),
    )
    window = F.when(F.size("__h") >= width, F.transform(F.sequence(F.lit(0), F.size("__h") - width), lambda i: F.xxhash64(*[F.get("__h", i + k) for k in range(width)])))
    df = df.select(
        *own, "__w", "n_words", "word_chars", "n_symbols", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.size("__l").cast("bigint").alias("n_lines"), F.coalesce(window, F.array().cast("array<bigint>")).alias("__g"),
    )
    packed = F.when(
        F.size(F.array_distinct("__g")) < F.size("__g"),
        F.sort_array(F.transform("__g", lambda x, i: F.shiftleft(x, _AT).bitwiseOR(i.cast("bigint")))),
    )
    df = df.select(*own, "__w", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", packed.alias("__p"))
    top = lambda x: F.shiftright(x, _AT)
    twin = F.filter("__p", lambda x, k: (top(x) == top(F.get("__p", k + 1))) | ((k > 0) & (top(x) == top(F.get("__p", F.greatest(k - 1, F.lit(0)))))))
    text_of = F.array_sort(F.transform(twin, lambda x: F.struct(
        F.array_join(F.slice("__w", x.bitwiseAND(F.lit((1 << _AT) - 1)).cast("int") + 1, width), " ").alias("t"), x.bitwiseAND(F.lit((1 << _AT) - 1)).alias("i"))))
    df = df.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.when(F.col("__p").isNotNull(), text_of).alias("__s"))
    same = lambda x, k: x["t"] == F.get("__s", k)["t"]
    equal = F.filter("__s", lambda x, k: same(x, k + 1) | ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))))
    df = df.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", F.sort_array(F.transform(equal, lambda x: x["i"])).alias("__e"))
    return df.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(_covered(F.col("__e"), width), F.lit(0)).cast("bigint").alias("n_repeat_words"), "n_lines")


def _measures() -> dict[str, Column]:
    part = lambda a, b: F.expr(f"{a} div greatest({b}, 1)")
    return {"symbols": part("1000 * n_symbols", "n_words"), "word_length": part("10 * word_chars", "n_words"), "dup_lines": part("1000 * n_dup_lines", "n_lines")}


def bucket(v: Column) -> Column:
    """The least value with the same number of digits and the same ``DIGITS`` leading ones."""
    return v - v % F.pow(F.lit(10), F.greatest(F.length(v.cast("string")) - DIGITS, F.lit(0))).cast("bigint")


def sketches(counts: DataFrame) -> DataFrame:
    """Histograms (lang, source, measure, bucket, n) of texts with words; merged by adding n."""
    at = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in _measures().items()])).alias("at")
    return counts.where("n_words > 0").select("lang", "source", at).groupBy("lang", "source", "at.measure", "at.bucket").agg(F.count(F.lit(1)).alias("n"))


def limits(sketch: DataFrame, min_rows: int = 100) -> DataFrame:
    """Per language and source: the largest value of each measure that passes."""
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), a.alias("l"), b.alias("s")) for k, (a, b) in enumerate([
        (F.col("lang"), F.col("source")), (F.col("lang"), F.lit(None).cast("string")), (F.lit(None).cast("string"), F.lit(None).cast("string"))])])).alias("at")
    merged = sketch.select("measure", "bucket", "n", level).groupBy("at.level", "at.l", "at.s", "measure", "bucket").agg(F.sum("n").alias("n"))
    group = ["level", "l", "s", "measure"]
    by = Window.partitionBy(*group)
    run = merged.select(*group, "bucket", F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("total"))
    quart = run.groupBy(*group).agg(F.max("total").alias("total"), *[F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 3)])
    margin = F.coalesce(*[F.when(F.col("measure") == m, F.lit(v).cast("bigint")) for m, v in MARGIN.items()])
    wide = quart.groupBy("level", "l", "s").agg(F.max("total").alias("total"), *[
        F.max(F.when(F.col("measure") == m, F.col("q3") + F.greatest(3 * (F.col("q3") - F.col("q1")), margin))).alias(f"most_{m}") for m in MARGIN])
    most = [f"most_{m}" for m in MARGIN]
    own, lang, whole = (wide.where(F.col("level") == k).select("level", *(["l", "s"][: 2 - k]), "total", F.struct(*most).alias(f"at{k}")) for k in range(3))
    lang = lang.select(F.col("l").alias("ll"), F.col("total").alias("total1"), "at1")
    joined = own.join(lang, F.col("l").eqNullSafe(F.col("ll")), "left").join(whole.select(F.col("level").alias("top"), "at2"), F.col("level") + 2 == F.col("top"), "left")
    chosen = F.when(F.col("total") >= min_rows, F.col("at0")).when(F.col("total1") >= min_rows, F.col("at1")).otherwise(F.col("at2"))
    return joined.select(F.col("l").alias("__lang"), F.col("s").alias("__source"), chosen.alias("__most")).select("__lang", "__source", "__most.*")


def judged(counts: DataFrame, min_rows: int = 100) -> DataFrame:
    """counts with base_failed and kept; counts must be a stored table, it is read twice."""
    # stored first: its size is then known, and where it is small the texts' rows need no shuffle
    most = keep(limits(sketches(counts), min_rows), "limits")
    joined = counts.join(most, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    over = None
    for m, v in _measures().items():
        one = F.coalesce(v > F.col(f"most_{m}"), F.lit(False))
        over = one if over is None else over | one
    return joined.select(*counts.columns, base.alias("base_failed"), (~base & ~over).alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: id, the counts, base_failed and kept. Texts are read once; the counts are stored in the shared folder."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("__text"))
    counts = with_counts(rows, F.col("__text")).drop("__text")
    out = judged(keep(counts, "counts"))
    return out.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"))
    counts = keep(with_counts(rows, F.col(f"doc.{text_col}")), "counted")
    return judged(counts).where("kept").select("doc.*")
