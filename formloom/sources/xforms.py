"""XForms definitions as tables.

One pass over a file's XML events turns it into rows, one an element, numbered
in document order (:func:`elements`).  All that the format means is said by
joins of that table with itself: binds by path or id, texts by reference,
labels, choices and blocks by the number of the element they stand in.  So any
number of files is read at once, and no step holds more than one file.

Defined results: what is no XForm has an error and no questions; of binds with
one path the last counts; a null or empty file is no XML.
"""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

#: Namespaces, controls and spellings of the format.
XFORMS, CASES = "http://www.w3.org/2002/xforms", "http://commcarehq.org/case/transaction/v2"
CONTROLS = ("input", "select", "select1", "upload", "trigger", "secret", "range")
BLOCKS = ("group", "repeat")
CASE_ACTIONS = ("case", "create", "update", "close")
YES = ("true()", "true", "yes")

ELEMENT = "path string, node int, last int, parent int, tag string, space string, attr map<string,string>, text string, above array<struct<tag:string,ref:string>>, raw string, error string"


def _rows_of(content: bytes | None) -> list[tuple]:
    """Elements of one file, closed from the inside out; the text of an element has its outputs as ${field}."""
    rows, open_, texts, count = [], [], [], 0
    try:
        for event, el in ET.iterparse(io.BytesIO(content or b""), events=("start", "end")):
            if event == "start":
                open_.append((count, el))
                texts.append([])
                count += 1
                continue
            number, _ = open_.pop()
            # what stands behind a child is known by now
            shown = (el.text or "") + "".join(part + (child.tail or "") for child, part in texts.pop())
            space, _, tag = el.tag.rpartition("}")
            attr = {k.rpartition("}")[2]: v for k, v in el.attrib.items()}
            shown = shown.strip()
            if texts:
                name = leaf_of(attr.get("value") or attr.get("ref") or "") if tag == "output" else ""
                texts[-1].append((el, (name and f"${{{name}}}") if tag == "output" else shown))
            above = [(e.tag.rpartition("}")[2], e.get("nodeset") or e.get("ref") or "") for _, e in open_]
            raw = ET.tostring(el, encoding="unicode").strip() if space == f"{{{CASES}" and tag in CASE_ACTIONS else None
            rows.append((number, count - 1, open_[-1][0] if open_ else -1, tag, space.lstrip("{"), attr, shown, above, raw, None))
    except ET.ParseError as err:
        return [(0, 0, -1, "", "", {}, "", [], None, str(err))]
    return rows


def leaf_of(ref: str) -> str:
    return ref.strip().rstrip("/").rpartition("/")[2].partition("[")[0]


def elements(files: DataFrame) -> DataFrame:
    """Rows as in ELEMENT of files (path, content)."""
    names = [c.strip().split(" ")[0] for c in ("path", "node", "last", "parent", "tag", "space", "attr", "text", "above", "raw", "error")]
    above = pa.list_(pa.struct([("tag", pa.string()), ("ref", pa.string())]))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), above, pa.string(), pa.string()]

    def read(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(path, *r[:5], list(r[5].items()), r[6], [dict(zip(("tag", "ref"), a)) for a in r[7]], *r[8:]) for r in _rows_of(content)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(read, ELEMENT)


def leaf(ref: Column) -> Column:
    """The last step of a path, without a predicate."""
    return F.split_part(F.regexp_extract(F.rtrim(F.trim(ref), F.lit("/")), "([^/]*)$", 1), F.lit("["), F.lit(1))


def text_id(ref: Column) -> Column:
    """The id in jr:itext('id'); null for anything else."""
    got = F.regexp_extract(F.trim(ref), r"^jr:itext\(\s*['\"]?(.*?)['\"]?\s*\)$", 1)
    return F.when(F.trim(ref).rlike(r"^jr:itext\(.*\)$"), got)


def _yes(c: Column) -> Column:
    return F.coalesce(c.isin(*YES), F.lit(False))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


@dataclass
class Tables:
    """What a set of files says: forms (a row a file), questions (in order; hidden fields behind them), case_actions, instances."""

    forms: DataFrame
    questions: DataFrame
    case_actions: DataFrame
    instances: DataFrame


#: Columns of questions that come from the bind as they stand.
_FROM_BIND = {"constraint": "constraint", "relevant": "relevant", "calculate": "calculate"}


def tables(files: DataFrame) -> Tables:
    e = stored(elements(files), "elements")  # joined with itself many times, read once
    attr = lambda name: F.col("attr")[name]
    inside = lambda tag: F.exists("above", lambda a: a["tag"] == tag)
    key = ["path", "node"]

    model_parts = e.where((F.try_element_at("above", F.lit(-1))["tag"] == "model") & (F.col("space") == XFORMS))
    binds = model_parts.where((F.col("tag") == "bind") & (F.coalesce(attr("nodeset"), attr("ref"), F.lit("")) != ""))
    binds = binds.groupBy("path", F.coalesce(_filled(attr("nodeset")), attr("ref")).alias("at")).agg(F.max_by("attr", "node").alias("bind"), F.max("node").alias("bind_node"))
    by_id = binds.where(F.coalesce(F.col("bind")["id"], F.lit("")) != "").groupBy("path", F.col("bind")["id"].alias("id")).agg(F.max_by(F.struct("at", "bind"), "bind_node").alias("named"))

    # texts: value < text < translation
    up = e.select("path", F.col("node").alias("parent"), F.col("attr").alias("of"), F.col("parent").alias("over"))
    top = up.select("path", F.col("parent").alias("over"), F.col("of").alias("translation"))
    values = e.where((F.col("tag") == "value") & inside("itext")).join(up, ["path", "parent"]).join(top, ["path", "over"])
    values = values.select("path", F.coalesce(F.col("of")["id"], F.lit("")).alias("text_id"), F.coalesce(F.col("translation")["lang"], F.lit("")).alias("lang"), F.coalesce(attr("form"), F.lit("default")).alias("form"), "node", "text")
    forms_of = values.groupBy("path", "text_id", "lang", "form").agg(F.max_by("text", "node").alias("text"), F.min("node").alias("node"))
    pick = lambda form: F.max(F.when(F.col("form") == form, _filled(F.col("text"))))
    shown = forms_of.groupBy("path", "text_id", "lang").agg(F.coalesce(pick("long"), pick("default")).alias("text")).where("text IS NOT NULL")
    shown = shown.groupBy("path", "text_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("texts"))
    kinds = forms_of.where(F.col("text").startswith("jr://")).groupBy("path", "text_id", "form").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("by_lang"))
    media = kinds.groupBy("path", "text_id").agg(F.map_from_entries(F.collect_list(F.struct("form", "by_lang"))).alias("media"))
    markdown = forms_of.where("form = 'markdown'").groupBy("path", "text_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("markdown"))

    none = F.create_map().cast("map<string,string>")

    def said(df: DataFrame, ref: Column, inline: Column, name: str) -> DataFrame:
        """df with what a reference to a text, or else the text beside it, says in each language."""
        wanted = shown.select("path", F.col("text_id").alias("__id"), F.col("texts").alias("__texts"))
        df = df.withColumn("__id", text_id(ref)).join(wanted, ["path", "__id"], "left")
        own = F.when(F.col("__id").isNotNull(), F.coalesce("__texts", none)).when(F.coalesce(inline, F.lit("")) != "", F.create_map(F.lit(""), inline)).otherwise(none)
        return df.withColumn(name, own).drop("__id", "__texts")

    def of_parent(tag: str, name: str) -> DataFrame:
        """Per element with such a child: the first one's texts, and its text id."""
        first = e.where(F.col("tag") == tag).groupBy("path", F.col("parent").alias("node")).agg(F.min_by(F.struct("attr", "text"), "node").alias("c"))
        return said(first, F.col("c.attr")["ref"], F.col("c.text"), name).select(*key, name, text_id(F.col("c.attr")["ref"]).alias(f"{name}_id"))

    labels, hints = of_parent("label", "labels"), of_parent("hint", "hints").drop("hints_id")

    # what is asked: blocks and controls of the body, but not inside a label, a hint or a control
    asked = e.where(inside("body") & F.col("tag").isin(*BLOCKS, *CONTROLS) & ~F.exists("above", lambda a: a["tag"].isin("label", "hint", *CONTROLS)))
    where = F.coalesce(attr("nodeset"), attr("ref"), F.lit(""))
    parents = F.filter(F.transform(F.filter("above", lambda a: a["tag"].isin(*BLOCKS)), lambda a: leaf(a["ref"])), lambda n: n != "")
    asked = asked.select(*key, "last", "tag", "attr", parents.alias("parent_path"), F.col("tag").isin(*BLOCKS).alias("block"), where.alias("ref"), F.coalesce(attr("bind"), F.lit("")).alias("id"))
    asked = asked.join(by_id, ["path", "id"], "left")
    asked = asked.withColumn("at", F.when(F.col("block") | (F.col("ref") != ""), F.col("ref")).otherwise(F.coalesce("named.at", "id")))
    asked = asked.join(binds.drop("bind_node"), ["path", "at"], "left").withColumn("bind", F.coalesce("bind", F.when(~F.col("block"), F.col("named.bind")), none))
    lost = asked.where(~F.col("block") & (F.col("at") == ""))
    asked = asked.where(F.col("block") | (F.col("at") != ""))

    asked = asked.join(labels, key, "left").join(hints, key, "left")
    asked = asked.join(media.withColumnRenamed("text_id", "labels_id"), ["path", "labels_id"], "left").join(markdown.withColumnRenamed("text_id", "labels_id"), ["path", "labels_id"], "left")
    bound = lambda name: F.col("bind")[name]
    asked = said(said(asked, bound("requiredMsg"), bound("requiredMsg"), "required_message"), bound("constraintMsg"), bound("constraintMsg"), "constraint_message")

    # choices: value and label < item < control
    item_values = e.where((F.col("tag") == "value") & (F.try_element_at("above", F.lit(-1))["tag"] == "item")).groupBy("path", F.col("parent").alias("node")).agg(F.min_by("text", "node").alias("value"))
    items = e.where("tag = 'item'").select("path", "node", "parent").join(item_values, key, "left").join(labels, key, "left")
    items = items.groupBy("path", F.col("parent").alias("node")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("node", F.coalesce("value", F.lit("")).alias("value"), F.map_entries(F.coalesce("labels", none)).alias("labels")))), lambda i: F.struct(i["value"].alias("value"), F.map_from_entries(i["labels"]).alias("labels"))).alias("choices")
    )
    itemsets = e.where("tag = 'itemset'").groupBy("path", F.col("parent").alias("node")).agg(F.min_by(attr("nodeset"), "node").alias("itemset"))
    asked = asked.join(items, key, "left").join(itemsets, key, "left")

    asked = stored(asked, "asked")  # used for beginnings, ends and what is left to the binds

    control = lambda c: F.when(~F.col("block"), c)
    repeat = lambda c: F.when(F.col("tag") == "repeat", c)
    no_choices = F.array().cast("array<struct<value:string,labels:map<string,string>>>")
    limits = F.map_filter("attr", lambda k, v: k.isin("start", "end", "step") & (v != ""))
    begun = asked.select(
        "path", "node", F.lit(0).alias("closes"), F.lit(0).alias("deep"), leaf(F.col("at")).alias("name"), F.col("at").alias("nodeset"), F.when(F.col("block"), F.concat(F.lit("begin_"), "tag")).otherwise(F.col("tag")).alias("type"),
        control(F.coalesce(bound("type"), F.lit(""))).alias("xforms_type"), attr("appearance").alias("appearance"), F.coalesce("labels", none).alias("labels"), F.coalesce("hints", none).alias("hints"), control(F.coalesce("media", F.create_map().cast("map<string,map<string,string>>"))).alias("media"),
        control(F.coalesce("markdown", none)).alias("markdown"), control(_yes(bound("required"))).alias("required"), control(F.col("required_message")).alias("required_message"), control(F.col("constraint_message")).alias("constraint_message"),
        *[(_filled(bound(b)) if name == "relevant" else control(_filled(bound(b)))).alias(name) for name, b in _FROM_BIND.items()], _yes(bound("readonly")).alias("readonly"),
        F.when(F.col("tag").isin("select", "select1"), F.coalesce("choices", no_choices)).alias("choices"), control(F.col("itemset")).alias("itemset"), control(limits).alias("parameters"), F.when(F.col("tag") == "upload", attr("mediatype")).alias("upload_mediatype"),
        control(bound("preload")).alias("preload"), control(bound("preloadParams")).alias("preload_params"), repeat(attr("count")).alias("repeat_count"), repeat(F.when(attr("noAddRemove").isNotNull(), _yes(attr("noAddRemove")))).alias("no_add_remove"), "parent_path",
    )
    ended = asked.where("block").select("path", F.col("last").alias("node"), F.lit(1).alias("closes"), F.negative("node").alias("deep"), leaf(F.col("at")).alias("name"), F.col("at").alias("nodeset"), F.concat(F.lit("end_"), "tag").alias("type"), "parent_path")
    # fields that only binds know: calculations and preloads
    hidden = binds.join(asked.select("path", "at").distinct(), ["path", "at"], "left_anti").where(~leaf(F.col("at")).startswith("@") & ~F.col("at").contains("/case/") & (F.coalesce(bound("calculate"), bound("preload"), F.lit("")) != ""))
    hidden = hidden.select("path", F.col("bind_node").alias("node"), F.lit(2).alias("closes"), F.lit(0).alias("deep"), leaf(F.col("at")).alias("name"), F.col("at").alias("nodeset"), F.lit("hidden").alias("type"), F.coalesce(bound("type"), F.lit("")).alias("xforms_type"), bound("calculate").alias("calculate"), bound("relevant").alias("relevant"), bound("preload").alias("preload"), bound("preloadParams").alias("preload_params"), F.array().cast("array<string>").alias("parent_path"))
    rows = begun.unionByName(ended, allowMissingColumns=True).unionByName(hidden, allowMissingColumns=True)

    # a file is small, so what is partitioned by file is bounded
    order = Window.partitionBy("path").orderBy(F.col("closes") == 2, "node", "closes", "deep")
    names_one = F.col("closes").eqNullSafe(0) & (F.col("name") != "")
    alike = F.count(F.when(names_one, 1)).over(Window.partitionBy("path", "name"))
    rows = rows.withColumn("seq", F.row_number().over(order) - 1).withColumn("suggested_safe_name", F.when(names_one & (alike > 1), F.concat_ws("_", "parent_path", F.array("name"))))
    rows = stored(rows, "questions")
    questions = rows.drop("node", "closes", "deep")

    instances = model_parts.where("tag = 'instance'").select("path", "node", F.coalesce(attr("id"), F.lit("")).alias("id"), F.coalesce(attr("src"), F.lit("")).alias("src"), (F.row_number().over(Window.partitionBy("path").orderBy("node")) - 1).alias("place"))
    roots = e.where(F.try_element_at("above", F.lit(-1))["tag"] == "instance").groupBy("path", F.col("parent").alias("node")).agg(F.min_by(F.struct("attr", "tag"), "node").alias("root"))
    primary = instances.where("place = 0").join(roots, key, "left").select("path", F.coalesce("root.attr.id", "root.attr.name", "root.tag").alias("form_id"), F.lit(True).alias("has_instance"))
    languages = e.where((F.col("tag") == "translation") & (F.coalesce(attr("lang"), F.lit("")) != "")).groupBy("path", attr("lang").alias("lang")).agg(F.min("node").alias("node"))
    languages = languages.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "lang"))), lambda s: s["lang"]).alias("languages"))
    says = lambda df, node, text: df.select("path", node.alias("node"), text.alias("text"))
    clashes = rows.where("suggested_safe_name IS NOT NULL").groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    warnings = (
        says(primary.where("form_id IS NULL"), F.lit(0), F.lit("the primary instance is empty; there is no form id"))
        .unionAll(says(instances.where("place > 0 AND (src LIKE '%casedb%' OR id LIKE '%casedb%')"), F.col("node"), F.format_string("instance %s reads the case database; use pulldata() from a dataset", "id")))
        .unionAll(says(lost, F.col("node"), F.format_string("a %s without ref or bind was left out", "tag")))
        .unionAll(says(clashes, F.lit(2**31 - 1), F.concat(F.lit("names used more than once: "), "names")))
    )
    warnings = warnings.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda s: s["text"]).alias("warnings"))
    seen = e.groupBy("path").agg(
        F.max("error").alias("broken"), F.min_by("text", F.when((F.col("tag") == "title") & inside("head"), F.col("node"))).alias("title"), *[F.max(F.col("tag") == t).alias(f"has_{t}") for t in ("head", "body", "model")]
    )
    forms = seen.join(primary, "path", "left").join(languages, "path", "left").join(warnings, "path", "left")
    missing = F.when(F.col("broken").isNotNull(), F.col("broken"))
    for part in ("head", "body", "model", "instance"):
        missing = missing.when(~F.coalesce(F.col(f"has_{part}"), F.lit(False)), F.lit(f"there is no {part}"))
    no_texts = F.array().cast("array<string>")
    forms = forms.select("path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("form_id", F.lit("")).alias("form_id"), F.coalesce("languages", no_texts).alias("languages"), F.coalesce("warnings", no_texts).alias("warnings"), missing.alias("error"))
    questions = questions.join(forms.where("error IS NOT NULL").select("path"), "path", "left_anti")
    case_actions = e.where((F.col("space") == CASES) & F.col("tag").isin(*CASE_ACTIONS)).select("path", "node", F.col("tag").alias("action"), "raw")
    return Tables(forms, questions, case_actions, instances.where("place > 0").select("path", "place", "id", "src"))


def read_xforms(spark: SparkSession, path: str) -> Tables:
    """The files under a path."""
    return tables(spark.read.format("binaryFile").load(path).select("path", "content"))


@dataclass
class XForm:
    """One form, brought to the driver for a converter."""

    title: str = ""
    form_id: str = ""
    languages: list[str] = field(default_factory=list)
    questions: list[dict] = field(default_factory=list)
    hidden: list[dict] = field(default_factory=list)  # fields that only binds know
    case_actions: list[dict] = field(default_factory=list)
    secondary_instances: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def parse(spark: SparkSession, xml: str) -> XForm:
    """The form in a text; ValueError where there is none."""
    t = tables(spark.createDataFrame([("", bytearray(xml.encode()))], "path string, content binary"))
    about = t.forms.first()
    if about["error"]:
        raise ValueError(about["error"])
    rows = [r.asDict(recursive=True) for r in t.questions.orderBy("seq").collect()]
    return XForm(
        about["title"], about["form_id"], about["languages"], [r for r in rows if r["type"] != "hidden"], [r for r in rows if r["type"] == "hidden"],
        [r.asDict() for r in t.case_actions.orderBy("node").select("action", "raw").collect()], [r.asDict() for r in t.instances.orderBy("place").select("id", "src").collect()], about["warnings"],
    )


def main(args: list[str]) -> int:
    """Prints a form as JSON."""
    from pathlib import Path

    from ..session import session

    if len(args) != 1:
        print("usage: python -m formloom.sources.xforms FILE")
        return 1
    print(json.dumps(asdict(parse(session(), Path(args[0]).read_text("utf-8-sig"))), ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
