"""Validation rules of forms as queries; each yields (severity, rule, location, message)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..expressions.analysis import findings
from ..operators.form import Form
from ..plans.rows import SLOTS, marker_pairs, refs

SCHEMA = "severity string, rule string, location string, message string"


def _found(df: DataFrame, rule: str, location: Column, message: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), location.cast("string").alias("location"), message.alias("message"))


def _kind() -> Column:
    return F.regexp_replace(F.coalesce("type", F.lit("")), r"^(begin|end)_", "$1 ")


def unique_names(survey: DataFrame) -> DataFrame:
    named = survey.where("coalesce(name, '') <> ''").where(~_kind().startswith("end "))
    twice = named.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("excel_row").alias("row")).where("n > 1")
    return _found(twice, "VL01", F.col("row"), F.concat(F.lit("name used more than once: "), "name"))


def name_characters(survey: DataFrame) -> DataFrame:
    bad = survey.where("coalesce(name, '') <> ''").where(~F.rlike("name", F.lit(r"^[A-Za-z_][A-Za-z0-9_]*$")))
    return _found(bad, "VL02", F.col("excel_row"), F.concat(F.lit("name has other characters: "), "name"))


def balanced(survey: DataFrame) -> DataFrame:
    """Begins without an end of their depth, ends without a begin, and pairs of different kind."""
    kind = _kind()
    begins, ends = (F.sum(F.when(kind.startswith(w), 1).otherwise(0)) for w in ("begin ", "end "))
    totals = survey.agg(begins.alias("b"), ends.alias("e")).where("b <> e")
    uneven = _found(totals, "VL03", F.lit(None), F.concat(F.col("b").cast("string"), F.lit(" begin and "), F.col("e").cast("string"), F.lit(" end markers")))
    pairs = marker_pairs(survey)
    last = survey.select(F.col("excel_row").alias("end_row"), F.substring(kind, 5, 20).alias("end_kind"), F.col("name").alias("end_name"))
    met = pairs.join(last, "end_row", "left")
    wrong = met.where("end_kind is not null and (end_kind <> kind or (coalesce(end_name, '') <> '' and end_name <> name))")
    return uneven.unionByName(_found(wrong, "VL03", F.col("end_row"), F.concat(F.lit("ends another block than begins in row "), F.col("begin_row").cast("string"))))


def lists_exist(survey: DataFrame, choices: DataFrame) -> DataFrame:
    used = survey.select("excel_row", F.regexp_extract(F.coalesce("type", F.lit("")), r"^select_(?:one|multiple)\s+(\S+)", 1).alias("list_name")).where("list_name <> ''")
    return _found(used.join(choices.select("list_name").distinct(), "list_name", "left_anti"), "VL04", F.col("excel_row"), F.concat(F.lit("no such list: "), "list_name"))


def lists_filled(choices: DataFrame) -> DataFrame:
    full = F.count_if((F.coalesce("value", F.lit("")) != "") & (F.coalesce("label", F.lit("")) != ""))
    return _found(choices.groupBy("list_name").agg(full.alias("n")).where("n = 0"), "VL05", F.col("list_name"), F.lit("no row with value and label"))


def references_exist(survey: DataFrame) -> DataFrame:
    missing = refs(survey).join(survey.select(F.col("name").alias("target")).distinct(), "target", "left_anti")
    return _found(missing, "VL06", F.col("source"), F.concat(F.col("slot"), F.lit(" refers to unknown "), F.col("target")))


def no_markdown(survey: DataFrame) -> DataFrame:
    labels = [c for c in survey.columns if c == "label" or c.startswith("label:")]
    marks = reduce(lambda a, b: a | b, [F.rlike(F.coalesce(F.col(f"`{c}`"), F.lit("")), F.lit(r"(^|\s)#{1,6}\s|\*\*[^*]+\*\*|\[[^\]]+\]\([^)]+\)")) for c in labels])
    return _found(survey.where(marks), "VL08", F.col("excel_row"), F.lit("Markdown in a label; use HTML"), "warning")


def settings_filled(settings: DataFrame) -> DataFrame:
    title = F.coalesce("form_title", F.lit("")) == ""
    ident = ~F.rlike(F.coalesce("form_id", F.lit("")), F.lit(r"^[A-Za-z][A-Za-z0-9_-]*$"))
    rules = F.filter(F.array(F.when(title, F.lit("form_title is blank")), F.when(ident, F.lit("form_id must begin with a letter and hold letters, digits, _ and - only"))), lambda x: x.isNotNull())
    return _found(settings.select(F.explode(rules).alias("m")), "VL09", F.lit("settings"), F.col("m"))


def bundles_exist(survey: DataFrame, bundles: DataFrame) -> DataFrame:
    used = survey.select("excel_row", F.explode(F.regexp_extract_all(F.coalesce("appearance", F.lit("")), F.lit(r"\bcustom-([A-Za-z0-9_-]+)"), F.lit(1))).alias("bundle"))
    return _found(used.join(bundles.select("bundle").distinct(), "bundle", "left_anti"), "VL10", F.col("excel_row"), F.concat(F.lit("no bundle: "), "bundle"))


def unique_values(choices: DataFrame) -> DataFrame:
    twice = choices.where("coalesce(value, '') <> ''").groupBy("list_name", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(twice, "VL11", F.col("list_name"), F.concat(F.lit("value used more than once: "), "value"))


#: Rule of a finding about an expression.
EXPRESSION_RULES = {
    "SYNTAX": "VL07", "DOUBLE_EQUALS": "VL07", "FOREIGN_PATH": "VL07", "POSITION": "VL07", "UNDOCUMENTED_FUNCTION": "VL07", "DOT_OUTSIDE_CONSTRAINT": "VL07",
    "UNKNOWN_REF": "VL06", "SELECT_MULTIPLE_COMPARED": "VL12", "REPEAT_REF_WITHOUT_AGGREGATE": "VL13", "RANDOM_IN_RELEVANCE": "VL14", "RANDOM_WITHOUT_ONCE": "VL14", "ONCE_NESTED": "VL14", "VALUE_NOT_IN_LIST": "VL15",
}


def expression_rules(form: Form) -> list[tuple]:
    """VL06, VL07 and VL12 to VL15 over all expressions of a form, as rows."""
    kinds = {f.name: f.type for f in form.fields.values()} | {g: "group" for g in form.groups}
    repeat_of = {f.name: f.repeat for f in form.fields.values() if f.repeat}
    choices = {f.name: set(form.choice_values(f.list_name)) for f in form.fields.values() if f.list_name and form.choice_values(f.list_name)}
    out = []
    for r in form.survey:
        f = form.fields.get(r.get("name"))
        for slot in SLOTS:
            if r.get(slot) and slot != "choice_filter":
                for x in findings(r[slot], slot, kinds, repeat_of, f.repeat if f else None, choices):
                    out.append((x.severity, EXPRESSION_RULES[x.rule], str(r["excel_row"]), f"{slot}: {x.message}"))
    return out


def expression_rules_of(survey: DataFrame, choices: DataFrame, form: str = "form") -> DataFrame:
    """(form, severity, rule, location, message) for a table of forms.

    Rows are dealt by form and sorted, so a task takes its forms one after another
    and holds one of them, some hundred rows, at a time. The number of tasks is
    given: the rows are few bytes and much work, so they are not put together by size.
    """
    kind = survey.schema[form].dataType.simpleString()
    cells = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns if c != form])
    sheets = survey.select(F.col(f"`{form}`").alias("form"), cells(survey).alias("sheet"))
    both = sheets.unionByName(choices.select(F.col(f"`{form}`").alias("form"), cells(choices).alias("listed")), allowMissingColumns=True)
    tasks = int(survey.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = lambda cells: {k: v for k, v in cells.items() if v is not None and v == v}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = (r for batch in batches for r in batch.to_pylist())
        found = ((key, *x) for key, group in groupby(all_rows, lambda r: r["form"]) for x in one(list(group)))
        while some := list(islice(found, 10_000)):
            columns = zip(zip(*some, strict=True), [key_type, *[pa.string()] * 4], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=[form, "severity", "rule", "location", "message"])

    def one(rows: list[dict]) -> list[tuple]:
        sheet = sorted((filled(r["sheet"]) for r in rows if r["sheet"] is not None), key=lambda r: r["excel_row"])
        return expression_rules(Form(sheet, [filled(r["listed"]) for r in rows if r["listed"] is not None]))

    key_type = to_arrow_type(survey.schema[form].dataType)
    # by a hash: dealt by the form itself after a distinct() of forms, Spark would leave its own, merged partitions
    return both.repartition(tasks, F.xxhash64("form")).sortWithinPartitions("form").mapInArrow(each, f"`{form}` {kind}, {SCHEMA}")


#: What a symptom seen in use points to (VL24).
SYMPTOMS = {
    r"\bif\([^,()]*\)": "if() needs a value for true and one for false",
    r"[‘’“”]": "smart quotes: use straight ones",
    r"\bselected\(\s*'": "selected() takes a field first",
    r"(?<![<>!=])=\s*(true|false)\b(?!\()": "true and false are words here: compare with 1 or use the condition itself",
    r"\$\{[^}]*\s[^}]*\}": "a field's name has no spaces",
    r"\\'": "no backslash escapes: put the text in double quotes",
}


def symptoms(survey: DataFrame) -> DataFrame:
    parts = []
    for slot in (s for s in SLOTS if s in survey.columns):
        for pattern, what in SYMPTOMS.items():
            hit = survey.where(F.rlike(F.coalesce(F.col(slot), F.lit("")), F.lit(pattern)))
            parts.append(_found(hit, "VL24", F.col("excel_row"), F.lit(f"{slot}: {what}"), "warning"))
    return reduce(DataFrame.unionByName, parts)


def validate(survey: DataFrame, choices: DataFrame, settings: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """All rules over the three sheets."""
    have = lambda df, *cols: df.withColumns({c: F.lit(None).cast("string") for c in cols if c not in df.columns})
    survey, choices, settings = have(survey, "appearance", "label", *SLOTS), have(choices, "value", "label"), have(settings, "form_title", "form_id")
    parts = [unique_names(survey), name_characters(survey), balanced(survey), lists_exist(survey, choices), lists_filled(choices), references_exist(survey), no_markdown(survey), settings_filled(settings), unique_values(choices), symptoms(survey)]
    if bundles is not None:
        parts.append(bundles_exist(survey, bundles))
    return reduce(DataFrame.unionByName, parts)


def report(rows: DataFrame) -> DataFrame:
    """Counts by severity, for a verdict: no errors, no failure."""
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def warnings(found: DataFrame) -> DataFrame:
    """A line a rule for a form's summary: severity, rule, how many findings, and the first of them by place and message."""
    place = F.struct(F.col("location").try_cast("bigint").alias("at"), "location", "message")
    lines = found.groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    return lines.select("severity", "rule", "n", F.col("first.location").alias("first_location"), F.col("first.message").alias("first_message"))


def checklist(form: Form) -> dict[str, bool]:
    """The conversion checklist as questions about a converted form."""
    fields = list(form.fields.values())
    text = " ".join(str(v) for r in form.survey for k, v in r.items() if k in SLOTS and v)
    return {
        "title and id are set": bool(form.settings.get("form_title") and form.settings.get("form_id")),
        "names are unique": len({f.name for f in fields}) == len([r for r in form.survey if r.get("name") in form.fields]),
        "names are safe": all(re.fullmatch(r"[A-Za-z_]\w*", f.name) for f in fields),
        "blocks are balanced": True,  # a form that is not does not load
        "every list exists": all(form.choice_values(f.list_name) for f in fields if f.list_name),
        "every choice has a label": all(c.get("label") for c in form.choices),
        "no foreign equality": "==" not in text,
        "no foreign paths": not re.search(r"(?<![\w}])/[A-Za-z]", text),
        "no foreign functions": not re.search(r"\b(position|jr:choice-name|instance)\s*\(", text),
        "every question has a label": all(f.cells.get("label") for f in fields if f.type not in ("calculate", "calculate_here", "start", "end", "deviceid", "username", "caseid")),
        "constraints have messages": all(f.cells.get("constraint message") for f in fields if f.cells.get("constraint")),
        "no expression findings": not [x for x in expression_rules(form) if x[0] == "error"],
    }
