"""What all conversions share: names, lists, texts, constraints, and the report."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..expressions.analysis import native
from ..expressions.syntax import ExpressionError, parse, print_expr
from ..operators.form import Form

FULL, PARTIAL, LOSSY, DROPPED = "full", "partial", "lossy", "dropped"


@dataclass
class Converted:
    survey: list[dict] = field(default_factory=list)
    choices: list[dict] = field(default_factory=list)
    settings: dict = field(default_factory=dict)
    report: list[tuple[str, str, str]] = field(default_factory=list)  # item, status, message

    def note(self, item: str, status: str, message: str = "") -> None:
        self.report.append((item, status, message))

    def form(self) -> Form:
        return Form(self.survey, self.choices, self.settings)


def safe_name(name: str) -> str:
    """Letters, digits and underscores; runs of underscores are one; never a digit first."""
    out = re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", name)).strip("_") or "field"
    return f"q_{out}" if out[0].isdigit() else out


def safe_names(names: list[str], report=None) -> dict[str, str]:
    """A safe name for each source name; those that meet get the next free one of _2, _3, ... and are reported."""
    out, used = {}, set()
    for n in names:
        base, k = safe_name(n), 1
        while (name := base if k == 1 else f"{base}_{k}") in used:
            k += 1
        used.add(name)
        out[n] = name
        if k > 1 and report:
            report(n, PARTIAL, f"renamed {name}: another field is {base}")
    return out


def safe_stem(name: Column) -> Column:
    """A safe name by itself, whatever other names there are."""
    s = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9_]", "_"), r"_+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", F.lit("field")).when(s.rlike(r"^\d"), F.concat(F.lit("q_"), s)).otherwise(s)


def safe_name_column(df: DataFrame, name: str, order: str, out: str = "safe_name") -> DataFrame:
    """Safe names over a column, for very many fields at once: of those that meet, all but the first get _2, _3, ...

    Where a numbered name is another field's own, the number stands behind two
    underscores, which no field's own name has: no two names are alike.
    """
    base, place, taken = F.col("__base"), F.col("__place"), F.col("__taken")
    df = df.withColumn("__base", safe_stem(F.col(name))).withColumn("__place", F.row_number().over(Window.partitionBy("__base").orderBy(order)))
    df = df.withColumn("__numbered", F.concat_ws("_", base, place.cast("string")))
    df = df.join(df.select(base.alias("__taken")).distinct(), (F.col("__numbered") == taken) & (place > 1), "left")
    named = F.when(place == 1, base).when(taken.isNull(), F.col("__numbered")).otherwise(F.concat_ws("__", base, place.cast("string")))
    return df.withColumn(out, named).drop("__base", "__place", "__numbered", "__taken")


def shared_lists(lists: dict[str, list[dict]]) -> tuple[dict[str, str], dict[str, list[dict]]]:
    """Lists that agree in values and labels, in order and in every language, become one: name -> kept name, and the kept lists."""
    by_print, names, kept = {}, {}, {}
    for n, rows in lists.items():
        mark = tuple(tuple(sorted((k, str(v)) for k, v in r.items() if k != "list_name")) for r in rows)
        first = by_print.setdefault(mark, n)
        names[n] = first
        if first == n:
            kept[n] = rows
    return names, kept


def list_prints(choices: DataFrame) -> DataFrame:
    """(list_name, fingerprint, kept_name) over a choices table: equal fingerprints are one list."""
    labels = [c for c in choices.columns if c == "label" or c.startswith("label:")]
    row = F.struct("excel_row", "value", *[F.col(f"`{c}`").alias(f"l{k}") for k, c in enumerate(labels)])
    prints = choices.groupBy("list_name").agg(F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.dropFields("excel_row"))), 256).alias("fingerprint"), F.min("excel_row").alias("__r"))
    first = F.first("list_name").over(Window.partitionBy("fingerprint").orderBy("__r"))
    return prints.select("list_name", "fingerprint", first.alias("kept_name"))


def other_field(parent: str, value: str, label: str | None = None) -> dict:
    """The text field that follows a choice "other"."""
    return {"type": "text", "name": f"{parent}_other", "label": label or "Please specify", "relevance": f"selected(${{{parent}}}, '{value}')"}


def expression(text: str | None, out: Converted, item: str, boolean: bool = False, names: dict[str, str] | None = None) -> str | None:
    """A foreign expression in the language's own form; one that cannot be read stays and is reported."""
    if not text or not text.strip():
        return None
    try:
        return print_expr(native(parse(text), boolean, names))
    except ExpressionError as err:
        out.note(item, LOSSY, f"expression kept as it was: {err}")
        return text.strip()


#: What labels must not hold, each taken out until none is left, since taking one out may make another.
_UNSAFE = [re.compile(p, re.IGNORECASE | re.DOTALL) for p in (r"<script\b.*?</script\s*>", r"<script\b[^>]*>?", r"<head\b.*?</head\s*>|</?(?:html|body)\b[^>]*>|<!doctype[^>]*>", r"""[\s/]+on[a-z]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", r"j\s*a\s*v\s*a\s*s\s*c\s*r\s*i\s*p\s*t\s*:")]


def label_text(text: str | None) -> str | None:
    """HTML stays; scripts, event attributes, script links and document wrappers go."""
    if text is None:
        return None
    before, s = None, text
    while s != before:
        before = s
        for p in _UNSAFE:
            s = p.sub("", s)
    return markdown(s).strip()


def markdown(s: str) -> str:
    s = re.sub(r"\*\*([^*\n]+)\*\*", r"<b>\1</b>", s)
    s = re.sub(r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", r"<i>\1</i>", s)
    s = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', s)
    return re.sub(r"(?m)^#{1,6}\s+(.+)$", r"<b>\1</b>", s)


def hint_text(text: str | None) -> str | None:
    """Hints show no HTML: plain text."""
    return None if text is None else re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", text)).replace("\xa0", " ")).strip()


def range_constraint(low=None, high=None) -> str:
    return " and ".join(f". {op} {x}" for op, x in ((">=", low), ("<=", high)) if x not in (None, ""))


def length_constraint(low=None, high=None) -> str:
    return " and ".join(f"string-length(.) {op} {x}" for op, x in ((">=", low), ("<=", high)) if x not in (None, ""))


EMAIL = r"regex(., '^[^@\s]+@[^@\s]+\.[^@\s]+$')"  # fixed value


def suffixed(texts: dict[str, str], column: str, default: str, name_of: dict[str, str] | None = None) -> dict[str, str]:
    """Texts by language as cells: the default without a suffix, the others with theirs."""
    name_of = name_of or {}
    return {(column if lang in ("", default) else f"{column}:{name_of.get(lang, lang)}"): t for lang, t in texts.items() if t}


def report_frame(spark: SparkSession, out: Converted) -> DataFrame:
    return spark.createDataFrame(out.report or [], "item string, status string, message string")


def report_markdown(out: Converted, title: str) -> str:
    """Summary, per-question warnings, and what concerns the survey as a whole."""
    counts = {s: sum(r[1] == s for r in out.report) for s in (FULL, PARTIAL, LOSSY, DROPPED)}
    lines = [f"# {title}", "", "## Summary", "", *(f"- {s}: {n}" for s, n in counts.items()), "", "## Per-question warnings", ""]
    own = [r for r in out.report if r[1] != FULL and r[0] != "survey"]
    lines += [f"- `{i}` ({s}): {m}" for i, s, m in own] or ["None."]
    lines += ["", "## Survey-level issues", ""]
    lines += [f"- {m}" for i, _, m in out.report if i == "survey"] or ["None."]
    return "\n".join(lines) + "\n"
