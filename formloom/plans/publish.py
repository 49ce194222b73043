"""Publishing submissions into keyed datasets.

A link maps form fields to dataset columns, each with its update: replace
(latest non-blank value), add to number, or concatenate to text.  Incoming rows
are reduced to one row a key first (partial aggregation before the shuffle),
then meet the dataset in one full outer join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number_text

REPLACE, ADD, CONCATENATE = "REPLACE", "ADD_TO_NUMERIC_VALUE", "CONCATENATE_TO_TEXT"


@dataclass(frozen=True)
class FieldMap:
    form_field: str
    column: str
    update: str = REPLACE
    separator: str = ", "
    position: str = "END"

    @classmethod
    def of_json(cls, text: str) -> list[FieldMap]:
        out = []
        for m in json.loads(text):
            options = m.get("updateLogicOptions") or {}
            out.append(cls(m["formField"], m["datasetField"], m.get("updateLogicAction") or REPLACE, options.get("separator", ", "), options.get("position", "END")))
        return out


@dataclass(frozen=True)
class Link:
    joining_field: str  # form field that holds the key
    key: str  # dataset column of the key
    fields: list[FieldMap] = field(default_factory=list)
    relevance_field: str | None = None
    enabled: bool = True
    form: str = ""
    dataset: str = ""
    direction: str = "INCOMING"
    wide: bool = True


def missing_fields(link: Link, known: list[str]) -> list[str]:
    """Mapped names that the form lacks; a starred name needs its stem."""
    return [m.form_field for m in link.fields if m.form_field.rstrip("*") not in known]


def starred(link: Link, most: int) -> Link:
    """field* -> column* maps spelled out for instances 1 to most."""
    out = []
    for m in link.fields:
        if m.form_field.endswith("*"):
            out += [FieldMap(f"{m.form_field[:-1]}_{k}", f"{m.column[:-1]}{k}", m.update, m.separator, m.position) for k in range(1, most + 1)]
        else:
            out.append(m)
    return Link(**{**link.__dict__, "fields": out})


def incoming(submissions: DataFrame, link: Link, order: list[str]) -> DataFrame:
    """One row a key with each map's part: latest value, sum, or text joined in submission order."""
    rows = submissions
    if link.relevance_field:
        rows = rows.where(F.col(link.relevance_field).cast("string") == "1")
    rows = rows.where(F.col(link.joining_field).isNotNull())
    at = F.struct(*[F.col(o) for o in order])
    parts: list[Column] = []
    for k, m in enumerate(link.fields):
        v = F.col(m.form_field)
        text = F.nullif(v.cast("string"), F.lit(""))
        if m.update == ADD:
            parts.append(F.sum(v.try_cast("double")).alias(f"__{k}"))
        elif m.update == CONCATENATE:
            rows_of = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(at.alias("o"), text.alias("v")))))
            if m.position == "BEGINNING":
                rows_of = F.reverse(rows_of)
            parts.append(F.nullif(F.array_join(F.transform(rows_of, lambda x: x["v"]), m.separator), F.lit("")).alias(f"__{k}"))
        else:
            parts.append(F.max_by(text, F.when(text.isNotNull(), at)).alias(f"__{k}"))
    return rows.groupBy(F.col(link.joining_field).cast("string").alias("__key")).agg(*parts)


def publish(submissions: DataFrame, link: Link, dataset: DataFrame, order: list[str]) -> DataFrame:
    """The dataset after the submissions; its key column is text."""
    if not link.enabled:
        return dataset
    return merged(dataset, incoming(submissions, link, order), link)


def merged(dataset: DataFrame, new: DataFrame, link: Link) -> DataFrame:
    """The dataset after one row a key of incoming parts."""
    old = dataset.withColumn(link.key, F.col(link.key).cast("string"))
    joined = old.join(new, old[link.key] == new["__key"], "full")
    out = {c: old[c] for c in dataset.columns if c != link.key}
    for k, m in enumerate(link.fields):
        was, now = out.get(m.column, F.lit(None).cast("string")), new[f"__{k}"]
        if m.update == ADD:
            total = F.coalesce(was.try_cast("double"), F.lit(0.0)) + now
            out[m.column] = F.when(now.isNotNull(), number_text(total)).otherwise(was.cast("string"))
        elif m.update == CONCATENATE:
            was = F.nullif(was.cast("string"), F.lit(""))
            out[m.column] = F.nullif(F.concat_ws(m.separator, *([now, was] if m.position == "BEGINNING" else [was, now])), F.lit(""))
        else:
            out[m.column] = F.coalesce(now, was.cast("string"))
    return joined.select(F.coalesce(old[link.key], new["__key"]).alias(link.key), *[c.alias(n) for n, c in out.items()])


def append(dataset: DataFrame, rows: DataFrame) -> DataFrame:
    """Upload in append mode; missing columns are blank."""
    return dataset.unionByName(rows, allowMissingColumns=True)


def duplicate_keys(dataset: DataFrame, unique: str) -> DataFrame:
    return dataset.groupBy(unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def enumerator_ids(n: Column, prefix: str = "", suffix: str = "", digits: int = 4, capitals: bool = False) -> Column:
    made = F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0"), F.lit(suffix))
    return F.upper(made) if capitals else made


def enumerator_id_pattern(prefix: str = "", suffix: str = "", digits: int = 4, capitals: bool = False) -> str:
    """What a valid id looks like, for rlike."""
    quote = lambda s: "\\Q" + s + "\\E" if s else ""
    return f"^{quote(prefix)}[0-9{'A-Z' if capitals else ''}]{{{digits}}}{quote(suffix)}$"


def publishable(form, encrypted: bool) -> list[str]:
    """Fields that may leave an encrypted form (publishable = yes), or all of another."""
    return [f.name for f in form.fields.values() if not encrypted or (f.cells.get("publishable") or "").lower() == "yes"]


def case_columns(dataset: DataFrame, cases: dict) -> DataFrame:
    """What a case list shows: the columns chosen for tables, or all of it as a tree."""
    shown = [c for c in cases.get("showColumnsWhenTable", []) if c in dataset.columns]
    return dataset.select(*shown) if cases.get("displayMode") == "table" and shown else dataset


def outgoing(dataset: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Spreadsheet publishing: CSV with a header, one file a partition."""
    dataset.select(*(columns or dataset.columns)).write.mode("overwrite").option("header", True).csv(path)
