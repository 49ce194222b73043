"""Atomic patches of form sheets.

Every operation of a batch names rows by their numbers in the sheet as it was
before the batch.  The batch is checked as a whole first; nothing is applied
unless everything can be.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.form import canonical_header
from ..operators.positions import row_numbers
from .rows import SLOTS

SETTINGS = ("form_id", "form_title", "default_language", "instance_name")  # fixed values: what change_setting may set


class PatchError(Exception):
    """Base of the error envelope: a code, and how to react to it."""

    code, reaction = "tool_error", "retry once, then report it"

    def __init__(self, message: str, **data):
        super().__init__(message)
        self.envelope = {"error": {"code": self.code, "message": message, "data": data}}


class SessionNotFound(PatchError):
    code, reaction = "session_not_found", "begin a new session; do not retry"


class SessionConflict(PatchError):
    code, reaction = "session_conflict", "read the current state, then send one batch again"


class TooLarge(PatchError):
    code, reaction = "xlsx_too_large", "make the workbook smaller"


class InvalidForm(PatchError):
    code, reaction = "invalid_xlsform", "mend the form or the patch"


class RecalculationBroken(PatchError):
    code, reaction = "recalc_environment_broken", "tell the operator"


class TopicNotFound(PatchError):
    code, reaction = "primer_not_found", "look up the topics again"


#: What a batch's summary counts.
COUNTS = ("rows_added", "rows_edited", "rows_deleted", "columns_added", "columns_renamed", "columns_deleted", "fields_renamed", "groups_renamed", "lists_renamed", "languages_renamed", "settings_changed")


@dataclass(frozen=True)
class Sheets:
    survey: DataFrame
    choices: DataFrame
    settings: dict
    version: int = 1


@dataclass
class Report:
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    warnings: list[str] = field(default_factory=list)


_ROW_OPS = {"add_row": "rows_added", "edit_row": "rows_edited", "delete_row": "rows_deleted"}


def apply(sheets: Sheets, patches: list[dict], expected_version: int | None = None, validate_only: bool = False) -> tuple[Sheets, Report]:
    """The patched sheets and what was done; the input stays as it is."""
    if expected_version is not None and expected_version != sheets.version:
        raise SessionConflict(f"version is {sheets.version}, not {expected_version}", current_version=sheets.version)
    report = Report()
    rows: dict[str, list[dict]] = {"survey": [], "choices": []}
    rest = []
    for p in patches:
        op = p.get("op")
        if op in _ROW_OPS:
            if p.get("sheet") not in rows:
                raise InvalidForm(f"{op} is for survey and choices, not {p.get('sheet')!r}")
            rows[p["sheet"]].append(p)
            report.counts[_ROW_OPS[op]] += 1
        elif op == "rename" and p.get("kind") in ("field", "group", "list", "language", "column"):
            rest.append(p)
            report.counts[f"{p['kind']}s_renamed"] += 1
        elif op == "delete_column":
            rest.append(p)
            report.counts["columns_deleted"] += 1
        elif op == "change_setting":
            wrong = sorted(set(p) - {"op", *SETTINGS})
            if wrong:
                raise InvalidForm(f"these settings cannot be patched: {wrong}")
            rest.append(p)
            report.counts["settings_changed"] += len(p) - 1
        else:
            raise InvalidForm(f"unsupported operation {op!r}" + (": write a cell of the new column, or delete and add the row" if op in ("add_column", "move_row") else ""))
    new = replace(sheets, survey=_row_patches(sheets.survey, rows["survey"], report), choices=_row_patches(sheets.choices, rows["choices"], report))
    for p in rest:
        new = _renames(new, p)
    return (sheets if validate_only else replace(new, version=sheets.version + 1)), report


def _row_patches(sheet: DataFrame, patches: list[dict], report: Report) -> DataFrame:
    if not patches:
        return sheet
    spark, known = sheet.sparkSession, list(sheet.columns)
    named = {int(p["excel_row"]) for p in patches if p["op"] != "add_row"} | {int(p["insert_before_excel_row"]) for p in patches if p.get("insert_before_excel_row")}
    there = {r[0] for r in sheet.where(F.col("excel_row").isin(sorted(named))).select("excel_row").collect()} if named else set()
    if named - there:
        raise InvalidForm(f"no rows {sorted(named - there)}")
    deleted = [int(p["excel_row"]) for p in patches if p["op"] == "delete_row"]
    edits: dict[int, dict] = {}
    for p in patches:
        cells = {canonical_header(k): v for k, v in (p.get("values") or {}).items()}
        for c in cells:
            if c not in known:
                report.warnings.append(f"unknown_column_added: {c}")
                report.counts["columns_added"] += 1
                known.append(c)
        if p["op"] == "edit_row":
            if int(p["excel_row"]) in deleted:
                raise InvalidForm(f"row {p['excel_row']} is both edited and deleted")
            edits.setdefault(int(p["excel_row"]), {}).update(cells)
        p["__cells"] = cells
    for c in known:
        if c not in sheet.columns:
            sheet = sheet.withColumn(c, F.lit(None).cast("string"))
    cols = [c for c in known if c != "excel_row"]
    schema = "excel_row int, " + ", ".join(f"`{c}` string" for c in cols)
    text = lambda v: None if v is None else str(v)
    if edits:
        table = spark.createDataFrame([(r, {k: v is not None for k, v in e.items()}, {k: text(v) or "" for k, v in e.items()}) for r, e in edits.items()], "__row int, __some map<string,boolean>, __new map<string,string>")
        joined = sheet.join(F.broadcast(table), F.col("excel_row") == F.col("__row"), "left")
        set_ = lambda c: F.when(F.map_contains_key(F.coalesce("__some", F.create_map().cast("map<string,boolean>")), c), F.when(F.try_element_at("__some", F.lit(c)), F.try_element_at("__new", F.lit(c)))).otherwise(F.col(f"`{c}`"))
        sheet = joined.select("excel_row", *[set_(c).alias(c) for c in cols])
    if deleted:
        sheet = sheet.where(~F.col("excel_row").isin(deleted))
    adds = [p for p in patches if p["op"] == "add_row"]
    kept = sheet.select(F.col("excel_row").cast("double").alias("__at"), F.lit(-1).alias("__seq"), *[F.col(f"`{c}`") for c in cols])
    if adds:
        rows = [(float(p["insert_before_excel_row"]) - 0.5 if p.get("insert_before_excel_row") else float("inf"), k, *[text(p["__cells"].get(c)) for c in cols]) for k, p in enumerate(adds)]
        kept = kept.unionByName(spark.createDataFrame(rows, "__at double, __seq int, " + schema.split(", ", 1)[1]))
    numbered = row_numbers(kept, ["__at", "__seq"], "excel_row", start=2)
    return numbered.select(F.col("excel_row").cast("int").alias("excel_row"), *[F.col(f"`{c}`") for c in cols])


def _renames(s: Sheets, p: dict) -> Sheets:
    kind = p.get("kind")
    if kind in ("field", "group"):
        old, new = p["old_name"], p["new_name"]
        texts = [c for c in s.survey.columns if c in SLOTS or c in ("appearance", "default", "repeat_count", "note") or c.split(":")[0] in ("label", "hint")]
        swap = {c: F.regexp_replace(F.col(f"`{c}`"), r"\$\{\s*" + re.escape(old) + r"\s*\}", "\\${" + new + "}") for c in texts}
        swap["name"] = F.when(F.col("name") == old, F.lit(new)).otherwise(F.col("name"))
        return replace(s, survey=s.survey.withColumns(swap))
    if kind == "list":
        old, new = p["old_list_name"], p["new_list_name"]
        renamed = F.regexp_replace("type", r"^(select_(?:one|multiple)\s+)" + re.escape(old) + r"(?=\s|$)", "$1" + new)
        return replace(s, survey=s.survey.withColumn("type", renamed), choices=s.choices.withColumn("list_name", F.when(F.col("list_name") == old, new).otherwise(F.col("list_name"))))
    if kind == "language":
        old, new = p["old_language"], p["new_language"]
        swap = lambda df: df.withColumnsRenamed({c: c[: -len(old) - 1] + (f":{new}" if new else "") for c in df.columns if c.endswith(f":{old}")})
        settings = dict(s.settings)
        if settings.get("default_language") == old and new:
            settings["default_language"] = new
        return replace(s, survey=swap(s.survey), choices=swap(s.choices), settings=settings)
    if p["op"] == "change_setting":
        return replace(s, settings={**s.settings, **{k: v for k, v in p.items() if k != "op"}})
    old, new = canonical_header(p.get("old_header") or p["header"]), p.get("new_header")
    if p["sheet"] == "settings":
        kept = {k: v for k, v in s.settings.items() if k != old}
        return replace(s, settings=kept | ({canonical_header(new): s.settings.get(old)} if new else {}))
    sheet = getattr(s, p["sheet"])
    return replace(s, **{p["sheet"]: sheet.withColumnRenamed(old, canonical_header(new)) if new else sheet.drop(old)})
