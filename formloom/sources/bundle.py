"""Field plug-in bundles: any number of them as one row each, and their rules as a table of expressions over that row.

A rule names what is wrong with a bundle as an array of places; the findings
are all rules' places, one row each (bundle, severity, rule, location,
message).  A new rule is one more entry of :func:`rules`.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files, field types, keys and forms that a bundle must keep to.
REQUIRED = ("manifest.json", "template.html", "script.js", "style.css")
FIELD_TYPES = ("text", "integer", "decimal", "select_one", "select_multiple")
TEXT_KEYS, LIST_KEYS, FLAG_KEYS = ("name", "author", "version"), ("externalCss", "externalJs"), ("hideDefaultRequiredMessage", "hideDefaultConstraintMessage")
SUFFIX, LONGEST = ".fieldplugin.zip", 100
_NAME, _VERSION = "^[A-Za-z][A-Za-z0-9._-]*$", r"^\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?$"

FILE = "bundle string, zip_name string, path string, content binary"


# ---- loading
def unpacked(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Path and content of each file in a zip; what systems add of their own is left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if not name.endswith("/") and _own(name):
                yield name, z.read(name)


def _own(path: str) -> bool:
    return not any(step.startswith(".") or step == "__MACOSX" for step in path.split("/"))


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """Rows as in FILE of the zips under a path, opened where they are read."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files = list(unpacked(data)) or [("", b"")]
                name = where.rpartition("/")[2]
                yield pa.RecordBatch.from_pylist([{"bundle": where, "zip_name": name, "path": p, "content": c} for p, c in files], pa.schema([("bundle", pa.string()), ("zip_name", pa.string()), ("path", pa.string()), ("content", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, FILE)


def of_files(spark: SparkSession, files: dict[str, bytes], zip_name: str | None = None, bundle: str = "") -> DataFrame:
    """The same of one bundle at hand."""
    return spark.createDataFrame([(bundle, zip_name, p, bytearray(c)) for p, c in files.items() or [("", b"")]], FILE)


def of_path(spark: SparkSession, path: Path) -> DataFrame:
    """The same of a local folder or zip."""
    if path.is_dir():
        return of_files(spark, {str(f.relative_to(path)): f.read_bytes() for f in sorted(path.rglob("*")) if f.is_file() and _own(str(f.relative_to(path)))}, None, str(path))
    return of_files(spark, dict(unpacked(path.read_bytes())), path.name, str(path))


# ---- rules
def bundles(files: DataFrame) -> DataFrame:
    """One row a bundle: zip_name, top (file names at its root), names (of all files), folders, manifest (variant), whether there is one, its error, script."""
    name = F.element_at(F.split("path", "/"), -1)
    whole = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    real = F.col("path") != ""
    made = files.groupBy("bundle", "zip_name").agg(
        F.array_sort(F.collect_list(F.when(real & ~F.contains("path", F.lit("/")), name))).alias("top"),
        F.array_sort(F.collect_list(F.when(real, name))).alias("names"),
        F.array_sort(F.collect_set(F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")))).alias("folders"),
        F.max(F.when(F.col("path") == "manifest.json", whole)).alias("manifest_text"),
        F.max(F.when(F.col("path") == "script.js", whole)).alias("script"),
    )
    return made.withColumn("manifest", F.try_parse_json("manifest_text"))


@dataclass(frozen=True)
class Rule:
    severity: str
    rule: str
    places: Column  # array of the places that break it
    message: str


def _when(bad: Column, *places: Column) -> Column:
    return F.when(bad, F.array(*places)).otherwise(F.array().cast("array<string>"))


def rules() -> list[Rule]:
    zip_name, names, top = F.col("zip_name"), F.col("names"), F.col("top")
    ends = F.lower(zip_name).endswith(SUFFIX)
    required = F.array(*map(F.lit, REQUIRED))
    missing = F.array_except(required, top)
    others = F.array_except(names, required)
    manifest = F.col("manifest")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("none"))
    key = lambda k: F.try_variant_get(manifest, f"$.{k}", "variant")
    text = lambda k: F.when(kind(key(k)) == "STRING", F.try_variant_get(manifest, f"$.{k}", "string"))
    at = lambda k: F.lit(f"manifest.{k}")
    is_object = kind(manifest).startswith("OBJECT")
    entries = lambda k: F.try_variant_get(manifest, f"$.{k}", "array<variant>")
    string = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    script = F.col("script")

    made = [
        Rule("warning", "VL20", _when(~ends, zip_name), f"does not end in {SUFFIX}, as an upload must"),
        Rule("error", "VL20", _when(ends & (F.length(zip_name) == len(SUFFIX)), zip_name), f"has no name before {SUFFIX}"),
        Rule("error", "VL20", _when(ends & (F.length(zip_name) > LONGEST), zip_name), f"is longer than {LONGEST} characters"),
        Rule("error", "VL20", _when(ends & ~zip_name.rlike(_NAME), zip_name), "begins with a letter and holds letters, digits, '.', '-' and '_' only"),
        Rule("error", "VL17", F.array_intersect(missing, names), "lies in a folder; it must be at the top"),
        Rule("error", "VL17", F.array_except(missing, names), "is missing"),
        Rule("warning", "VL17", _when(F.size("folders") > 0, F.array_join("folders", ", ")), "folders are flattened on upload"),
        Rule("error", "VL21", F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)), "is there more than once after flattening"),
        Rule("error", "VL17", F.filter(others, lambda n: F.length(n) > LONGEST), f"has a name longer than {LONGEST} characters"),
        Rule("error", "VL17", F.filter(others, lambda n: ~n.rlike(_NAME)), "a name begins with a letter and holds letters, digits, '.', '-' and '_' only"),
        Rule("error", "VL18", _when(F.col("manifest_text").isNotNull() & manifest.isNull(), F.lit("manifest.json")), "is no JSON"),
        Rule("error", "VL18", _when(manifest.isNotNull() & ~is_object, F.lit("manifest.json")), "must be an object"),
        Rule("warning", "VL18", _when(is_object & (F.coalesce(text("version"), F.lit("")) != "") & ~text("version").rlike(_VERSION), at("version")), "is no version like 1.2.3"),
        Rule("warning", "VL18", _when(is_object & (F.length(text("name")) > LONGEST), at("name")), f"is longer than {LONGEST} characters"),
        Rule("error", "VL18", _when(is_object & ~F.coalesce(F.size(entries("supportedFieldTypes")) > 0, F.lit(False)), at("supportedFieldTypes")), "is a list that must not be empty"),
        Rule("error", "VL18", F.transform(F.filter(entries("supportedFieldTypes"), lambda v: ~F.coalesce(string(v).isin(*FIELD_TYPES), F.lit(False))), lambda v: F.concat(F.lit("manifest.supportedFieldTypes: "), F.to_json(v))), f"is none of {', '.join(FIELD_TYPES)}"),
        Rule("warning", "VL19", _when(is_object & ~script.rlike(r"\bfunction\s+clearAnswer\b|\bclearAnswer\s*=(?!=)"), F.lit("script.js")), "defines no clearAnswer(), which plug-ins must have"),
        Rule("warning", "VL19", _when(is_object & ~script.rlike(r"\bsetAnswer\s*\("), F.lit("script.js")), "has no call of setAnswer(), by which answers are reported"),
    ]
    made += [Rule("error", "VL18", _when(is_object & (F.coalesce(text(k), F.lit("")) == ""), at(k)), "is a text that must not be blank") for k in TEXT_KEYS]
    made += [Rule("error", "VL18", _when(is_object & key(k).isNotNull() & (kind(key(k)) != "BOOLEAN"), at(k)), "is true or false") for k in FLAG_KEYS]
    for k in LIST_KEYS:
        unknown = F.array_except(F.filter(F.transform(entries(k), string), lambda f: f.isNotNull() & (f != "")), top)
        made += [
            Rule("error", "VL18", _when(is_object & key(k).isNotNull() & entries(k).isNull(), at(k)), "is a list of file names"),
            Rule("error", "VL18", _when(F.exists(entries(k), lambda v: F.coalesce(string(v), F.lit("")) == ""), at(k)), "has an entry that is no text"),
            Rule("error", "VL18", unknown, "names a file that is not in the bundle"),
        ]
    return made


def findings(files: DataFrame) -> DataFrame:
    """bundle, severity, rule, location, message of all that is wrong with the bundles in rows as in FILE."""
    none = F.array().cast("array<string>")

    def said_of(r: Rule) -> Column:
        return F.transform(F.coalesce(r.places, none), lambda p: F.struct(F.lit(r.severity).alias("severity"), F.lit(r.rule).alias("rule"), p.alias("location"), F.lit(r.message).alias("message")))

    said = [said_of(r) for r in rules()]
    return bundles(files).select("bundle", F.explode(F.concat(*said)).alias("f")).select("bundle", "f.*")


def report_json(found: DataFrame) -> DataFrame:
    """One JSON text a bundle: errors and warnings."""
    of = lambda s: F.array_sort(F.collect_list(F.when(F.col("severity") == s, F.struct("rule", "location", "message"))))
    return found.groupBy("bundle").agg(F.to_json(F.struct(of("error").alias("errors"), of("warning").alias("warnings"))).alias("report"))


def parameters(appearance: str) -> dict[str, str]:
    """Parameters of custom-name(key=value, ...): values are expressions or literals, as text."""
    m = re.search(r"custom-[A-Za-z0-9_-]+\((.*)\)\s*$", appearance, re.DOTALL)
    if not m:
        return {}
    parts, depth, quote, start = [], 0, "", 0
    for k, c in enumerate(m[1]):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "({":
            depth += 1
        elif c in ")}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(m[1][start:k])
            start = k + 1
    pairs = (p.partition("=") for p in [*parts, m[1][start:]])
    return {k.strip(): v.strip() for k, eq, v in pairs if eq}


def parameter_map(appearance: str, scope):
    """The parameters as a map column, with their expressions evaluated."""
    from pyspark.sql import functions as F

    from ..expressions.compiler import compile_expr

    pairs = [x for k, v in parameters(appearance).items() for x in (F.lit(k), compile_expr(v, scope).string())]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def answers_valid(answer, field_type: str):
    """Whether stored answers have the form that a plug-in must give for the field's type; blank is fine."""
    from pyspark.sql import functions as F

    shapes = {"integer": r"^-?[0-9]{1,9}$", "decimal": r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", "select_one": r"^\S+$", "select_multiple": r"^\S+( \S+)*$", "text": r"(?s)^.*$"}
    return answer.isNull() | (answer == "") | F.rlike(answer, F.lit(shapes[field_type]))


def field_properties(form, name: str, language: str | None = None) -> dict:
    """What a plug-in is told about its field."""
    f = form.fields[name]
    cell = lambda c: f.cells.get(f"{c}:{language}" if language else c) or f.cells.get(c)
    choices = [{"CHOICE_INDEX": k, "CHOICE_VALUE": v, "CHOICE_LABEL": lab} for k, (v, lab) in enumerate(form.choice_values(f.list_name, language).items())] if f.list_name else []
    return {"FIELDTYPE": f.type.split(" ")[0], "LABEL": cell("label"), "HINT": cell("hint"), "APPEARANCE": f.cells.get("appearance"), "READONLY": f.cells.get("read only") == "yes", "CHOICES": choices, "PARAMETERS": parameters(f.cells.get("appearance") or "")}


def main(args: list[str]) -> int:
    """Reports on a folder or zip; 0: no errors."""
    from ..session import session

    if len(args) != 1 or args[0] in ("-h", "--help"):
        print("usage: python -m formloom.sources.bundle FOLDER|ZIP")
        return 1
    rows = findings(of_path(session(), Path(args[0]))).collect()
    for r in rows:
        print(f"{r['severity']} {r['rule']} {r['location']}: {r['message']}")
    return int(any(r["severity"] == "error" for r in rows))


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
