"""Catalogue: session values, chance, sources and conversions, publishing links, sheet operations and translation rules over the driver's tables."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from .convert import common, xlsforms
from .convert import qsf as convert_qsf
from .convert import xforms as convert_xforms
from .expressions.compiler import compile_expr, predicate, scope_of
from .operators import form as forms
from .plans import explore, patches, publish, rows, sessions
from .queries_forms import part_sheet
from .registration import query, table
from .rules import form_rules, translation_rules
from .session import shared_folder
from .sources import bundle, dataset_xml, qsf, sheets, xforms


def _columns(df, scope, key, **expressions):
    return df.select(key, *[compile_expr(e, replace(scope, of=n)).col.alias(n) for n, e in expressions.items()])


# ---- values of the session and the device


@query("""
SELECT event_id, CAST(value AS DOUBLE) AS seconds, 'user ' || user_id AS who, CAST(user_id AS VARCHAR) AS who_id, event_type AS login, '7' AS form_version, 'device ' || (user_id % 5) AS device,
  'calls of ' || user_id AS calls, CAST(user_id % 60 AS DOUBLE) AS call_seconds, user_id % 2 = 0 AS phone FROM events""")
def session_values(spark, d):
    user = F.col("user_id")
    inputs = {
        "duration": F.col("value").cast("double"), "enumerator-name": F.concat(F.lit("user "), user), "enumerator-id": user.cast("string"), "username": F.col("event_type"), "version": F.lit("7"),
        "device-info": F.concat(F.lit("device "), user % 5), "phone-call-log": F.concat(F.lit("calls of "), user), "phone-call-duration": (user % 60).cast("double"), "collect-is-phone-app": user % 2 == 0,
    }
    return _columns(
        table(spark, d, "events"), scope_of({}, inputs=inputs), "event_id", seconds="duration()", who="enumerator-name()", who_id="enumerator-id()", login="username()", form_version="version()", device="device-info()",
        calls="phone-call-log()", call_seconds="phone-call-duration()", phone="collect-is-phone-app()",
    )


@query("SELECT event_id, coalesce(event_type || '/' || user_id, '') AS kept, '' AS none, value IS NULL OR value > 50 AS far, event_type = 'click' OR user_id < 100 AS either FROM events")
def plug_in_metadata(spark, d):
    scope = scope_of({"event_type": "string", "user_id": "number", "value": "number"}, inputs={"event_type__metadata": F.concat_ws("/", "event_type", "user_id")})
    return _columns(table(spark, d, "events"), scope, "event_id", kept="plug-in-metadata(${event_type})", none="plug-in-metadata(${value})", far="empty(${value}) or ${value} > 50", either="${event_type} = 'click' or ${user_id} < 100")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, o_orderstatus <> 'P' AS shown, CASE WHEN o_orderstatus <> 'P' THEN 'seen' ELSE 'hidden' END AS said FROM orders""")
def relevant_field(spark, d):
    f = forms.Form([{"type": "text", "name": "o_orderstatus"}, {"type": "decimal", "name": "price", "relevance": "${o_orderstatus} != 'P'"}, {"type": "calculate", "name": "said", "calculation": "if(relevant(${price}), 'seen', 'hidden')"}])
    scope = f.scope()
    out = forms.evaluate(f, table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price")), scope)
    return out.select("o_orderkey", "price", predicate("relevant(${price})", scope).alias("shown"), "said")


@query("""
SELECT p_partkey, printf('%,d', p_partkey * 1234567 % 100000000) AS grouped, CAST(p_size AS VARCHAR) AS size_text, round(tan(p_size / 40.0::DOUBLE), 9) AS t, round(asin(p_size / 60.0::DOUBLE), 9) AS s, round(acos(p_size / 60.0::DOUBLE), 9) AS c FROM part""")
def number_functions(spark, d):
    p = table(spark, d, "part").withColumn("big", (F.col("p_partkey") * 1234567 % 100000000).cast("double"))
    out = _columns(p, scope_of({"p_size": "number", "big": "number"}), "p_partkey", grouped="format-number(${big})", size_text="string(${p_size})", t="tan(${p_size} div 40)", s="asin(${p_size} div 60)", c="acos(${p_size} div 60)")
    return out.withColumns({k: F.round(k, 9) for k in "tsc"})


@query("""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'at once' WHEN '5-LOW' THEN 'some day' ELSE NULL END AS label FROM orders""")
def choice_names(spark, d):
    scope = replace(scope_of({"o_orderpriority": "string"}), labels={"o_orderpriority": {"1-URGENT": "at once", "5-LOW": "some day"}})
    return _columns(table(spark, d, "orders"), scope, "o_orderkey", label="choice-label(${o_orderpriority}, ${o_orderpriority})")


@query("""
WITH k AS (SELECT c_custkey, sha256(concat_ws(chr(31), c_custkey, 'near', '1', 'bearing')) AS b, sha256(concat_ws(chr(31), c_custkey, 'near', '1', 'radius')) AS r, c_custkey % 60 AS lat, c_custkey % 150 AS lon FROM customer),
u AS (SELECT *, CAST(CAST('0x' || substr(b, 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496 * 6.283185307179586 AS turn, sqrt(CAST(CAST('0x' || substr(r, 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496) * 500 AS far FROM k)
SELECT c_custkey, round(lat + degrees(far * cos(turn) / 6371008.8), 9) AS lat, round(lon + degrees(far * sin(turn) / (6371008.8 * cos(radians(lat)))), 9) AS lon FROM u""")
def geo_scattered(spark, d):
    at = F.concat_ws(" ", F.col("c_custkey") % 60, F.col("c_custkey") % 150, F.lit("0"), F.lit("0"))
    out = _columns(table(spark, d, "customer").withColumn("at", at), scope_of({"at": "string"}, key=F.col("c_custkey")), "c_custkey", near="geo-scatter(${at}, 500)")
    part = lambda k: F.round(F.get(F.split("near", " "), k).cast("double"), 9)
    return out.select("c_custkey", part(0).alias("lat"), part(1).alias("lon"))


_LINE_DRAW = "CAST(CAST('0x' || substr(sha256(concat_ws(chr(31), o_orderkey, 'draw', '1', i)), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496"


@query(f"""
WITH x AS (SELECT l_orderkey AS o_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT o_orderkey, CAST(i AS BIGINT) AS i, {_LINE_DRAW} AS draw FROM x""")
def chance_in_repeats(spark, d):
    """Every instance has a draw of its own."""
    from .queries_data import submissions

    f = forms.Form([{"type": "begin repeat", "name": "lines"}, {"type": "integer", "name": "l_linenumber"}, {"type": "calculate", "name": "draw", "calculation": "once(random())"}, {"type": "end repeat", "name": "lines"}])
    out = forms.evaluate(f, submissions(spark, d).select("o_orderkey", "lines"), f.scope(key=F.col("o_orderkey")))
    return out.select("o_orderkey", F.posexplode("lines").alias("p", "line")).select("o_orderkey", (F.col("p") + 1).cast("bigint").alias("i"), "line.draw")


# ---- forms: defaults, disabled rows, long integers, repeats within repeats


@query("""
SELECT c_custkey, coalesce(c_phone, 'none') AS phone, 'web' AS source, 'web of ' || c_mktsegment AS made FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN 'n' || c_custkey END AS c_phone FROM customer)""")
def form_defaults(spark, d):
    f = forms.Form([
        {"type": "text", "name": "c_mktsegment"}, {"type": "text", "name": "phone", "default": "none"}, {"type": "text", "name": "source", "default": "web", "read only": "yes"}, {"type": "text", "name": "gone", "disabled": "yes"},
        {"type": "text", "name": "made", "calculation": "concat(${source}, ' of ', ${c_mktsegment})"},
    ])
    key = F.col("c_custkey")
    return forms.evaluate(f, table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(key % 3 > 0, F.concat(F.lit("n"), key)).alias("phone"))).select("c_custkey", "phone", "source", "made")


@query("""SELECT o_orderkey, 'n' AS field, 'nine_digits' AS rule, NULL AS message, NULL::INTEGER AS "index" FROM orders WHERE o_custkey * 3000000 >= 1000000000""")
def nine_digits(spark, d):
    f = forms.Form([{"type": "integer", "name": "n"}])
    scope = f.scope()
    return forms.violations(f, forms.evaluate(f, table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 3000000).cast("double").alias("n")), scope), "o_orderkey", scope)


#: A repeat in a repeat: customers hold orders, orders hold lines.
DEEP_FORM = [
    {"type": "integer", "name": "floor"},
    {"type": "begin repeat", "name": "orders"},
    {"type": "decimal", "name": "price"},
    {"type": "begin repeat", "name": "items", "relevance": "${price} > 100000"},
    {"type": "decimal", "name": "quantity", "constraint": ". <= 49", "constraint message": "many"},
    {"type": "calculate", "name": "heavy", "calculation": "if(${quantity} > ${floor}, ${quantity}, 0)"},
    {"type": "end repeat", "name": "items"},
    {"type": "calculate", "name": "weight", "calculation": "sum(${heavy})"},
    {"type": "end repeat", "name": "orders"},
    {"type": "calculate", "name": "heaviest", "calculation": "max(${weight})"},
]


def _deep(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("l"))
    held = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    items = F.transform("l", lambda x: F.struct(x["q"].alias("quantity")))
    nested = held.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").alias("price"), items.alias("items")))).alias("orders"))
    return nested.select(F.col("o_custkey").alias("c_custkey"), F.lit(25.0).alias("floor"), F.transform("orders", lambda o: F.struct(o["price"].alias("price"), o["items"].alias("items"))).alias("orders"))


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, coalesce(sum(CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END) FILTER (WHERE o_totalprice > 100000), 0) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_custkey AS c_custkey, CAST(max(weight) AS DOUBLE) AS heaviest, round(CAST(sum(weight) AS DOUBLE), 6) AS all_weights FROM w GROUP BY 1""")
def nested_repeats(spark, d):
    out = forms.evaluate(forms.Form([dict(r) for r in DEEP_FORM]), _deep(spark, d))
    return out.select("c_custkey", "heaviest", F.round(F.aggregate(F.transform("orders", lambda o: o["weight"]), F.lit(0.0), lambda a, b: a + b), 6).alias("all_weights"))


@query("""
SELECT o_custkey AS c_custkey, 'quantity' AS field, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 100000 AND l_quantity > 49 GROUP BY 1""")
def nested_repeat_violations(spark, d):
    f = forms.Form([dict(r) for r in DEEP_FORM])
    scope = f.scope()
    return forms.violations(f, forms.evaluate(f, _deep(spark, d), scope), "c_custkey", scope).groupBy("c_custkey", "field").agg(F.count(F.lit(1)).alias("n"))


# ---- publishing


@query("""SELECT CAST(o_custkey AS VARCHAR) AS id, max_by(o_totalprice, o_orderkey) FILTER (WHERE true) AS last FROM orders GROUP BY 1""")
def publish_of_definition(spark, d):
    """A dataset's definition written, read and carried out: the enabled link publishes, the disabled one does not."""
    field_map = '[{"formField": "o_totalprice", "datasetField": "last", "updateLogicAction": null}]'
    link = {"dataLinkClass": "FORM", "dataLinkType": "INCOMING", "linkObjectId": "orders", "fieldMap": field_map, "joiningField": "o_custkey", "dataLinkState": "ENABLED"}
    ds = dataset_xml.Dataset("spending", "Spending", columns=["id", "last"], links=[link, {**link, "dataLinkState": "DISABLED", "fieldMap": field_map.replace("o_totalprice", "o_orderkey")}], unique="id")
    data = spark.createDataFrame([], "id string, last double")
    for x in dataset_xml.read(dataset_xml.write(ds)).publish_links():
        data = publish.publish(table(spark, d, "orders"), x, data, ["o_orderkey"])
    return data.select("id", F.col("last").cast("double").alias("last"))


@query("SELECT what, n FROM (VALUES ('problems', 7), ('links', 1), ('missing', 1), ('starred', 3), ('version', 1), ('readable', 1)) AS t(what, n)")
def dataset_definitions(spark, d):
    """Definitions of every type and their faults; fields a map needs; repeated fields spelled out; versions of uploads."""
    bad = dataset_xml.Dataset("", "T", "ODD", links=[{}], cases={"displayMode": "x"}, discriminator="ENUMERATORS")
    maps = '[{"formField": "age*", "datasetField": "age*"}, {"formField": "gone", "datasetField": "x"}]'
    good = dataset_xml.read(dataset_xml.write(dataset_xml.Dataset("cases", "C", "SERVER", "CASES", ["id"], ["visit"], [{"dataLinkClass": "FORM", "dataLinkType": "INCOMING", "linkObjectId": "visit", "fieldMap": maps, "joiningField": "id"}], version=7)))
    link = good.publish_links()[0]
    held = dataset_xml.Catalog()
    held.upload(good)
    found = {"problems": len(bad.problems()), "links": len(good.publish_links()), "missing": len(publish.missing_fields(link, ["age"])), "starred": sum(f.column.startswith("age") for f in publish.starred(link, 3).fields), "version": good.version, "readable": len(held.readable("visit"))}
    return spark.createDataFrame(list(found.items()), "what string, n int")


@query("SELECT c_custkey, c_name FROM customer")
def outgoing_spreadsheet(spark, d):
    """The case table's columns published as CSV files and read back as an attachment."""
    shown = publish.case_columns(table(spark, d, "customer"), {"displayMode": "table", "showColumnsWhenTable": ["c_custkey", "c_name", "gone"]})
    path = f"{shared_folder(spark)}/sheet-{uuid.uuid4().hex[:12]}"
    publish.outgoing(shown, path)
    return sheets.read_attachment(spark, path).select(F.col("c_custkey").cast(shown.schema["c_custkey"].dataType).alias("c_custkey"), "c_name")


# ---- exploration: options


def _summary(name, s, source, oracle, digits=()):
    def build(spark, d):
        out = explore.compile_summary(s, table(spark, d, source))
        return out.withColumns({c: F.round(c, 6) for c in digits})

    build.__name__ = name
    return query(oracle)(build)


S = explore.Summary
_summary("explore_count", S("categorical", "o_orderstatus", options="count,bar"), "orders", "SELECT o_orderstatus AS category, count(*) AS n FROM orders GROUP BY 1")
_summary("explore_percent", S("categorical", "o_orderstatus", options="percent,pie"), "orders", "SELECT o_orderstatus AS category, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1", ["percent"])
_summary("explore_mean_max", S("numeric", "o_totalprice", options="mean,max"), "orders", "SELECT round(avg(o_totalprice), 6) AS mean, max(o_totalprice) AS max FROM orders", ["mean"])
_summary("explore_none", S("trend", "value", "ts", options_2="none"), "events", "SELECT CAST(ts AS TIMESTAMP) AS period, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1", ["mean"])
_summary("explore_months_2", S("trend", "o_totalprice", "o_orderdate", options_2="months"), "orders", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1", ["mean"])
_summary("explore_heatmap", S("crosstab", "o_orderstatus", "o_orderpriority", options="count,heatmap"), "orders", 'SELECT o_orderstatus AS "row", o_orderpriority AS "column", count(*) AS n FROM orders GROUP BY 1, 2')


@query("SELECT CAST(c_custkey % 160 - 80 AS DOUBLE) AS lat, CAST(c_custkey % 350 - 175 AS DOUBLE) AS lon FROM customer WHERE c_acctbal > 0")
def workbook_geomap(spark, d):
    """A workbook from its sheet: a group, settings, a global filter, a map."""
    book = explore.Workbook.of_rows(
        [{"type": "begin group", "label": "Where"}, {"type": "geomap", "field": "at", "label": "Homes", "note": "all"}, {"type": "end group", "label": "Where"}], [{"field": "c_acctbal", "filter": '("0.000001","1000000")'}], [], {"workbook_id": "homes"}
    )
    at = F.concat_ws(" ", F.col("c_custkey") % 160 - 80, F.col("c_custkey") % 350 - 175)
    (out,) = explore.compile_workbook(book, table(spark, d, "customer").withColumn("at", at)).values()
    return out


# ---- sheets: parts as rows of a survey


def _survey(spark, d):
    """Parts in groups of ten, each group around its rows; selects name a list."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    k = F.col("p_partkey")
    kind = F.when(F.col("p_size") > 25, F.lit("select_one sizes")).otherwise(F.lit("text"))
    row = lambda at, kind, name, rel: F.struct(at.cast("int").alias("excel_row"), kind.alias("type"), name.alias("name"), rel.alias("relevance"))
    none = F.lit(None).cast("string")
    own = row(k * 3, kind, F.concat(F.lit("f"), k), F.when((k % 10 != 1) & (k > 0), F.concat(F.lit("${f"), k - 1, F.lit("} > 1"))))
    begin = F.when(k % 10 == 1, row(k * 3 - 1, F.lit("begin group"), F.concat(F.lit("g"), k), F.concat(F.lit("${f"), k + 10, F.lit("} = 1"))))
    end = F.when((k % 10 == 0) & (k > 0), row(k * 3 + 1, F.lit("end group"), F.concat(F.lit("g"), k - 9), none))
    return p.select(F.explode(F.filter(F.array(own, begin, end), lambda x: x.isNotNull())).alias("r")).select("r.*")


_SURVEY = """s AS (SELECT p_partkey * 3 AS excel_row, CASE WHEN p_size > 25 THEN 'select_one sizes' ELSE 'text' END AS type, 'f' || p_partkey AS name FROM part),
m AS (SELECT max(p_partkey) AS n FROM part), b AS (SELECT p_partkey * 3 - 1 AS excel_row, 'g' || p_partkey AS name, p_partkey * 3 + 28 AS ends FROM part, m WHERE p_partkey % 10 = 1 AND p_partkey + 9 <= n)"""


@query(f"WITH {_SURVEY} SELECT CAST(excel_row AS INTEGER) AS excel_row, type, name FROM s")
def rows_fields(spark, d):
    return rows.row_kind(_survey(spark, d), "fields").select("excel_row", "type", "name")


@query(f"WITH {_SURVEY} SELECT CAST(excel_row AS INTEGER) AS excel_row, name, CAST(ends AS INTEGER) AS group_end_excel_row FROM b")
def rows_groups(spark, d):
    return rows.row_kind(_survey(spark, d), "groups").where("group_end_excel_row IS NOT NULL").select("excel_row", "name", "group_end_excel_row")


@query(f"WITH {_SURVEY} SELECT CAST(excel_row AS INTEGER) AS excel_row, name, CAST(ends AS INTEGER) AS group_end_excel_row FROM b WHERE excel_row = 32")
def row_by_number(spark, d):
    return rows.get_row(_survey(spark, d), 32).select("excel_row", "name", "group_end_excel_row")


@query(f"WITH {_SURVEY} SELECT CAST(excel_row AS INTEGER) AS excel_row, 'sizes' AS list_name, v AS value FROM s, (VALUES ('s'), ('l')) AS c(v) WHERE type LIKE 'select%'")
def rows_with_choices(spark, d):
    choices = sheets.sheet_frame(spark, [{"excel_row": k + 2, "list_name": n, "value": v} for k, (n, v) in enumerate([("sizes", "s"), ("sizes", "l"), ("other", "x")])])
    return rows.expand_choices(_survey(spark, d), choices).select("excel_row", "list_name", "value")


@query("""SELECT 'f' || p_partkey AS source, 'f' || (p_partkey - (p_partkey - 1) % 10 + 10) AS target FROM part, (SELECT max(p_partkey) AS n FROM part) WHERE p_partkey > 0 AND p_partkey - (p_partkey - 1) % 10 + 9 <= n""")
def group_dependencies(spark, d):
    return rows.group_edges(_survey(spark, d)).where("source LIKE 'f%'")


@query("""SELECT 'f' || p_partkey AS seed, 9::BIGINT AS n_before FROM part WHERE p_partkey % 10 = 0 AND p_partkey > 0""")
def dependency_chains(spark, d):
    """What the last field of every ten depends on, through all of them."""
    sheet = _survey(spark, d)
    seeds = sheet.where("name LIKE 'f%0'").select("name")
    return rows.closure(rows.refs(rows.row_kind(sheet, "fields")), seeds).groupBy("seed").agg(F.count(F.lit(1)).alias("n_before"))


@query("""SELECT count(*) AS n_fields, count(*) FILTER (WHERE p_partkey % 10 = 1) AS n_groups, 0::BIGINT AS n_repeats, CAST(max(greatest(p_partkey * 3, CASE WHEN p_partkey % 10 = 0 AND p_partkey > 0 THEN p_partkey * 3 + 1 ELSE 0 END)) + 1 AS INTEGER) AS next_survey_row, 2::BIGINT AS n_choices, 1::BIGINT AS n_lists, 4 AS next_choice_row FROM part""")
def form_summaries(spark, d):
    return rows.form_summary(_survey(spark, d), sheets.sheet_frame(spark, [{"excel_row": 2, "list_name": "a", "value": "1"}, {"excel_row": 3, "list_name": "a", "value": "2"}]))


@query("""SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, (count(*) OVER ()) > 100 AS more_results FROM part WHERE regexp_matches(p_name, 'a') OR regexp_matches(p_brand, 'a') ORDER BY excel_row LIMIT 100""")
def row_query_fulltext_fields(spark, d):
    return rows.query(part_sheet(spark, d), {"fulltext": [["name", "label"], "a"]}, columns=["excel_row"])


# ---- patches and sessions over that survey


def _patched(spark, d, *batch, settings=None, choices=None):
    sheet = part_sheet(spark, d)
    choices = choices if choices is not None else sheets.sheet_frame(spark, [{"excel_row": 2, "list_name": "sizes", "value": "s"}, {"excel_row": 3, "list_name": "other", "value": "x"}])
    return patches.apply(patches.Sheets(sheet, choices, settings or {"form_title": "T", "default_language": "en"}), [dict(b) for b in batch])


@query("SELECT CAST(p_partkey * 3 AS INTEGER) AS excel_row, CASE WHEN p_size > 25 THEN 'select_one how_big' ELSE 'text' END AS type FROM part")
def rename_list(spark, d):
    new, _ = patches.apply(patches.Sheets(rows.row_kind(_survey(spark, d), "fields"), sheets.sheet_frame(spark, [{"excel_row": 2, "list_name": "sizes", "value": "s"}]), {}), [{"op": "rename", "kind": "list", "old_list_name": "sizes", "new_list_name": "how_big"}])
    return new.survey.select("excel_row", "type")


@query('SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, p_brand AS label, lower(p_brand) || \' de\' AS "label:Deutsch" FROM part')
def rename_language(spark, d):
    new, _ = _patched(spark, d, {"op": "rename", "kind": "language", "old_language": "de", "new_language": "Deutsch"})
    return new.survey.select("excel_row", "label", "label:Deutsch")


@query("SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, p_name AS name, p_brand AS title FROM part")
def rename_and_delete_columns(spark, d):
    new, _ = _patched(spark, d, {"op": "rename", "kind": "column", "sheet": "survey", "old_header": "label", "new_header": "title"}, {"op": "delete_column", "sheet": "survey", "header": "hint"}, {"op": "delete_column", "sheet": "survey", "header": "type"}, {"op": "delete_column", "sheet": "survey", "header": "label:de"})
    return new.survey


@query("SELECT what, said FROM (VALUES ('title', 'New'), ('language', 'en'), ('version', '2'), ('settings_changed', '1'), ('rows_added', '1'), ('warning', 'unknown_column_added: extra'), ('dry run', '1'), ('conflict', 'session_conflict'), ('add_column', 'invalid_xlsform'), ('bad setting', 'invalid_xlsform'), ('no row', 'invalid_xlsform'), ('ended', 'session_not_found')) AS t(what, said)")
def patch_reports(spark, d):
    """Settings, counts, warnings, dry runs, versions and the error envelopes of a batch."""
    held = sessions.Sessions()
    key = held.start(patches.Sheets(part_sheet(spark, d), part_sheet(spark, d), {"form_title": "T", "default_language": "en"}))
    version, report = held.patch(key, [{"op": "change_setting", "form_title": "New"}, {"op": "add_row", "sheet": "survey", "values": {"name": "x", "extra": "1"}}])
    now = held.current(key)
    said = {"title": now.settings["form_title"], "language": now.settings["default_language"], "version": version, "settings_changed": report.counts["settings_changed"], "rows_added": report.counts["rows_added"], "warning": report.warnings[0]}
    held.patch(key, [{"op": "change_setting", "form_title": "Dry"}], validate_only=True)
    said["dry run"] = int(held.current(key).settings["form_title"] == "New" and held.current(key).version == version)

    def code(f):
        try:
            f()
        except patches.PatchError as err:
            return err.envelope["error"]["code"]
        return "none"

    said["conflict"] = code(lambda: held.patch(key, [], expected_version=1))
    said["add_column"] = code(lambda: held.patch(key, [{"op": "add_column", "sheet": "survey"}]))
    said["bad setting"] = code(lambda: held.patch(key, [{"op": "change_setting", "colour": "red"}]))
    said["no row"] = code(lambda: held.patch(key, [{"op": "delete_row", "sheet": "survey", "excel_row": 10**9}]))
    held.end(key)
    said["ended"] = code(lambda: held.current(key))
    return spark.createDataFrame([(k, str(v)) for k, v in said.items()], "what string, said string")


@query('SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, p_name AS name, p_brand AS label FROM part')
def session_export(spark, d):
    """A session's sheets exported as a bundle of CSV and read back."""
    held, path = sessions.Sessions(), f"{shared_folder(spark)}/export-{uuid.uuid4().hex[:12]}"
    key = held.start(patches.Sheets(part_sheet(spark, d), part_sheet(spark, d), {"form_id": "x"}))
    held.export(key, path)
    return sheets.read_attachment(spark, f"{path}/survey").select(F.col("excel_row").cast("int").alias("excel_row"), "name", "label")


@query("SELECT what, true AS has FROM (VALUES ('eq'), ('sum-if'), ('crosstab'), ('rows_added')) AS t(what)")
def capabilities(spark, d):
    known = sessions.capabilities()
    return spark.createDataFrame([(w, any(w in v for v in known.values())) for w in ("eq", "sum-if", "crosstab", "rows_added")], "what string, has boolean")


# ---- translations


def _bilingual(spark, d):
    size, brand = F.col("p_size"), F.col("p_brand")
    return table(spark, d, "part").select(
        (F.col("p_partkey") + 1).cast("int").alias("excel_row"), F.col("p_name").alias("name"), F.concat(F.lit("<b>"), brand, F.lit("</b>")).alias("label"), F.when(size % 4 > 0, F.concat(F.when(size % 3 > 0, F.lit("<b>")).otherwise(F.lit("<i>")), brand)).alias("label:de"),
        F.when(size > 10, F.lit("a.png")).alias("media:image"), F.when(size > 20, F.lit("b.png")).alias("media:image:de"),
    )


@query("""
SELECT 'de' AS language, 2 AS n_columns, count(*) FILTER (WHERE p_size % 4 > 0) + count(*) FILTER (WHERE p_size > 20) AS n_cells FROM part
UNION ALL SELECT '', 2, count(*) + count(*) FILTER (WHERE p_size > 10) FROM part""")
def translation_languages(spark, d):
    """Languages, their columns, and how many cells of these are filled."""
    sheet = _bilingual(spark, d)
    return translation_rules.inventory(sheet)


@query("""SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row FROM part WHERE p_size % 4 > 0""")
def translation_tags(spark, d):
    return translation_rules.tags_kept(_bilingual(spark, d)).select("excel_row")


@query("""SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, 'media:image:de' AS "column" FROM part WHERE p_size > 10 AND p_size <= 20""")
def translation_media(spark, d):
    return translation_rules.media_parity(_bilingual(spark, d))


@query("""SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, p_name AS name, 'before' AS side FROM part WHERE p_size = 7 UNION ALL SELECT CAST(p_partkey + 1 AS INTEGER), upper(p_name), 'after' FROM part WHERE p_size = 7""")
def translation_changed_keys(spark, d):
    sheet = _bilingual(spark, d).join(table(spark, d, "part").select((F.col("p_partkey") + 1).cast("int").alias("excel_row"), "p_size"), "excel_row")
    return translation_rules.changed_keys(sheet, sheet.withColumn("name", F.when(F.col("p_size") == 7, F.upper("name")).otherwise(F.col("name"))), ["excel_row", "name"])


@query("""
SELECT 'label:de' AS "column", count(*) FILTER (WHERE p_size % 4 > 0) AS n_cells FROM part UNION ALL SELECT 'media:image:de', count(*) FILTER (WHERE p_size > 20) FROM part""")
def translation_default_suffix(spark, d):
    """Columns that bear the default language's suffix, and how many cells would have to move."""
    sheet = _bilingual(spark, d)
    return translation_rules.filled(sheet, translation_rules.default_unsuffixed(sheet.columns, "de"))


@query("SELECT n BETWEEN total * 0.02 AND total * 0.09 AS enough FROM (SELECT count(*) AS total, count(*) * 0.05 AS n FROM orders)")
def translation_spot_check(spark, d):
    sheet = table(spark, d, "orders").select(F.col("o_orderkey").alias("excel_row"))
    total = sheet.agg(F.count(F.lit(1)).alias("total"))
    return translation_rules.spot_check(sheet).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), F.lit(True)).select(F.col("n").between(F.col("total") * 0.02, F.col("total") * 0.09).alias("enough"))


# ---- rules over sheets of table size


@query("""
SELECT 'VL01' AS rule, 'name used more than once: ' || n_name AS message FROM nation WHERE n_regionkey < 2
UNION ALL SELECT 'VL04', 'no such list: ' || n_name FROM nation WHERE n_regionkey = 3""")
def sheet_rules(spark, d):
    n = table(spark, d, "nation")
    survey = n.select((F.col("n_nationkey") * 2 + 2).cast("int").alias("excel_row"), F.lit("text").alias("type"), F.col("n_name").alias("name")).unionByName(
        n.where("n_regionkey < 2").select((F.col("n_nationkey") * 2 + 3).cast("int").alias("excel_row"), F.lit("text").alias("type"), F.col("n_name").alias("name"))
    )
    selects = n.select((F.col("n_nationkey") + 1000).cast("int").alias("excel_row"), F.concat(F.lit("select_one "), "n_name").alias("type"), F.concat(F.lit("s"), "n_nationkey").alias("name"))
    choices = n.where("n_regionkey <> 3").select(F.col("n_nationkey").cast("int").alias("excel_row"), F.col("n_name").alias("list_name"), F.lit("1").alias("value"), F.lit("One").alias("label"))
    return form_rules.unique_names(survey).select("rule", "message").unionByName(form_rules.lists_exist(selects, choices).select("rule", "message"))


# ---- sources: a form, a bundle or a survey made of each row, and read as any number of files


def _xform_files(spark, d):
    """A nation's XForm: a translated question with a bind, a select, a repeat in a group, a calculation."""
    name, key = F.col("n_name"), F.col("n_nationkey").cast("string")
    xml = F.concat(
        F.lit('<h:html xmlns:h="http://www.w3.org/1999/xhtml" xmlns="http://www.w3.org/2002/xforms" xmlns:jr="http://openrosa.org/javarosa"><h:head><h:title>Form of '), name,
        F.lit('</h:title><model><instance><data id="f'), key, F.lit('"><age/></data></instance><instance id="casedb" src="jr://instance/casedb"/><itext><translation lang="en"><text id="a"><value>Age in '), name,
        F.lit(', <output value="/data/who"/>?</value><value form="image">jr://file/x.png</value></text></translation><translation lang="fr"><text id="a"><value form="long">Âge</value><value>non</value></text></translation></itext>'
              '<bind nodeset="/data/age" type="xsd:int" required="true()" constraint=". &gt; '), key,
        F.lit('" jr:constraintMsg="jr:itext(\'a\')"/><bind id="k" nodeset="/data/kind" relevant="/data/age &gt; 1"/><bind nodeset="/data/twice" calculate="/data/age * 2"/></model></h:head><h:body>'
              '<input ref="/data/age"><label ref="jr:itext(\'a\')"/></input><select1 bind="k"><label>Kind</label><item><label>Yes</label><value>y</value></item><item><label>No</label><value>n</value></item></select1>'
              '<group ref="/data/g"><label>G</label><repeat nodeset="/data/g/r" jr:count="/data/age"><input ref="/data/g/r/age"><label>Again</label></input></repeat></group><trigger><label>lost</label></trigger></h:body></h:html>'),
    )
    return table(spark, d, "nation").select(key.alias("path"), F.encode(xml, "UTF-8").alias("content"))


@query("""
SELECT CAST(n_nationkey AS VARCHAR) AS path, 'Form of ' || n_name AS title, 'f' || n_nationkey AS form_id, 'en fr' AS languages,
 'instance casedb reads the case database; use pulldata() from a dataset|a trigger without ref or bind was left out|names used more than once: age' AS warnings FROM nation""")
def xforms_forms(spark, d):
    return xforms.tables(_xform_files(spark, d)).forms.where("error IS NULL").select("path", "title", "form_id", F.array_join("languages", " ").alias("languages"), F.array_join("warnings", "|").alias("warnings"))


@query("""
WITH q(seq, name, type, parent, safe) AS (VALUES (0, 'age', 'input', '', 'age'), (1, 'kind', 'select1', '', NULL), (2, 'g', 'begin_group', '', NULL), (3, 'r', 'begin_repeat', 'g', NULL), (4, 'age', 'input', 'g/r', 'g_r_age'), (5, 'r', 'end_repeat', 'g', NULL), (6, 'g', 'end_group', '', NULL), (7, 'twice', 'hidden', '', NULL))
SELECT CAST(n_nationkey AS VARCHAR) AS path, seq, name, type, parent, safe, CASE seq WHEN 0 THEN 'Age in ' || n_name || ', ${who}?' WHEN 1 THEN 'Kind' WHEN 2 THEN 'G' WHEN 4 THEN 'Again' END AS label, CASE WHEN seq = 0 THEN 'Âge' END AS french, CASE WHEN seq = 0 THEN '. > ' || n_nationkey END AS "constraint",
  CASE seq WHEN 1 THEN '/data/age > 1' END AS relevant, CASE WHEN seq = 1 THEN 'y:Yes n:No' END AS choices, CASE WHEN seq = 3 THEN '/data/age' END AS repeat_count, CASE WHEN seq = 7 THEN '/data/age * 2' END AS calculate, seq = 0 AS required, CASE WHEN seq = 0 THEN 'jr://file/x.png' END AS image, CASE WHEN seq = 0 THEN 'Âge' END AS message
FROM nation, q""")
def xforms_questions(spark, d):
    q = xforms.tables(_xform_files(spark, d)).questions
    first = lambda c: F.coalesce(F.col(c)["en"], F.col(c)[""])
    said = F.array_join(F.transform("choices", lambda c: F.concat(c["value"], F.lit(":"), c["labels"][""])), " ")
    return q.select(
        "path", "seq", "name", "type", F.array_join("parent_path", "/").alias("parent"), F.col("suggested_safe_name").alias("safe"), first("labels").alias("label"), F.col("labels")["fr"].alias("french"), "constraint", "relevant", said.alias("choices"), "repeat_count", "calculate",
        F.coalesce("required", F.lit(False)).alias("required"), F.col("media")["image"]["en"].alias("image"), F.col("constraint_message")["fr"].alias("message"),
    )


def _bundle_files(spark, d):
    """Suppliers' bundles; some lack a file, have one in a folder, twice, or of a bad name, or a faulty manifest."""
    k = F.col("s_suppkey")
    file = lambda path, content: F.struct(F.lit(path).alias("path") if isinstance(path, str) else path.alias("path"), content.alias("content"))
    manifest = F.concat(F.lit('{"name": "'), "s_name", F.lit('", "author": "a", "version": "'), F.when(k % 5 == 0, "v1").otherwise("1.0.0"), F.lit('", "supportedFieldTypes": ["text"'), F.when(k % 7 == 0, ', "date"').otherwise(""), F.lit('], "externalJs": ["'), F.when(k % 11 == 0, "gone.js").otherwise("script.js"), F.lit('"]}'))
    files = F.array(
        file("manifest.json", F.when(k % 13 == 0, "{").otherwise(manifest)), file("template.html", F.lit("")), file(F.when(k % 3 == 0, "sub/style.css").otherwise("style.css"), F.lit("")),
        file("script.js", F.when(k % 2 == 0, "function clearAnswer() {} setAnswer(1)").otherwise("var clearAnswer = () => setAnswer('')")), file(F.when(k % 4 == 0, "9 lives.txt").otherwise("notes.txt"), F.lit("")), file("a/notes.txt", F.lit("")),
    )
    zip_name = F.concat(F.when(k % 6 == 0, "1").otherwise("p"), k, F.when(k % 9 == 0, ".zip").otherwise(".fieldplugin.zip"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("bundle"), zip_name.alias("zip_name"), F.explode(files).alias("f")).select("bundle", "zip_name", "f.path", F.encode("f.content", "UTF-8").alias("content"))


@query("""
WITH k AS (SELECT s_suppkey AS k FROM supplier),
f AS (SELECT k, 'error' AS severity, 'VL17' AS rule, 'style.css' AS location FROM k WHERE k % 3 = 0 UNION ALL SELECT k, 'warning', 'VL17', CASE WHEN k % 3 = 0 THEN 'a, sub' ELSE 'a' END FROM k UNION ALL SELECT k, 'error', 'VL17', '9 lives.txt' FROM k WHERE k % 4 = 0
 UNION ALL SELECT k, 'error', 'VL21', 'notes.txt' FROM k WHERE k % 4 <> 0 UNION ALL SELECT k, 'error', 'VL18', 'manifest.json' FROM k WHERE k % 13 = 0 UNION ALL SELECT k, 'warning', 'VL18', 'manifest.version' FROM k WHERE k % 13 <> 0 AND k % 5 = 0
 UNION ALL SELECT k, 'error', 'VL18', 'manifest.supportedFieldTypes: "date"' FROM k WHERE k % 13 <> 0 AND k % 7 = 0 UNION ALL SELECT k, 'error', 'VL18', 'gone.js' FROM k WHERE k % 13 <> 0 AND k % 11 = 0
 UNION ALL SELECT k, 'warning', 'VL20', CASE WHEN k % 6 = 0 THEN '1' ELSE 'p' END || k || '.zip' FROM k WHERE k % 9 = 0 UNION ALL SELECT k, 'error', 'VL20', '1' || k || '.fieldplugin.zip' FROM k WHERE k % 6 = 0 AND k % 9 <> 0)
SELECT CAST(k AS VARCHAR) AS bundle, severity, rule, location FROM f""")
def bundle_findings(spark, d):
    return bundle.findings(_bundle_files(spark, d)).select("bundle", "severity", "rule", "location")


@query("SELECT count(*) AS n_reports FROM supplier")
def bundle_reports(spark, d):
    return bundle.report_json(bundle.findings(_bundle_files(spark, d))).agg(F.count_if(F.col("report").contains("warnings")).alias("n_reports"))


@query("""SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, regexp_matches(CAST(c_custkey AS VARCHAR), '^-?[0-9]{1,9}$') AS valid, 'v' || c_custkey AS given FROM customer""")
def plug_in_answers(spark, d):
    scope = scope_of({"c_custkey": "number"})
    got = bundle.parameter_map("custom-slider(low=1, own=concat('v', ${c_custkey}))", scope)
    return table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), bundle.answers_valid(F.col("c_custkey").cast("string"), "integer").alias("valid"), got["own"].alias("given"))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN 'a_b' WHEN 1 THEN 'q_1x' WHEN 2 THEN 'field' ELSE 'n' || n_nationkey END AS safe FROM nation")
def converted_names(spark, d):
    k = F.col("n_nationkey")
    raw = F.when(k % 4 == 0, "a--b").when(k % 4 == 1, "1x").when(k % 4 == 2, "??").otherwise(F.concat(F.lit("n"), k))
    return table(spark, d, "nation").select(k.alias("k"), common.safe_stem(raw).alias("safe"))


# ---- conversions and workbooks


def _converted(spark, out, columns):
    rows = [tuple(r.get(c) for c in columns) for r in out.survey if not r["type"].startswith("end")]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


@query("""
SELECT * FROM (VALUES ('begin group', 'g_1', '<b>G</b>', NULL, NULL), ('integer', 'q_1st', NULL, '. >= 0 and . <= 10', '${a_b} = ''x'''), ('select_one yn', 'a_b', 'A', NULL, NULL), ('select_one yn', 'bike_own', 'Bike: Own?', NULL, NULL), ('select_one yn', 'car_own', 'Car: Own?', NULL, NULL))
 AS t(type, name, label, "constraint", relevance)""")
def convert_xlsform(spark, d):
    """Another dialect's sheet: names, labels, ranges, operators, matrices."""
    out = xlsforms.convert(
        [{"type": "begin_group", "name": "g 1", "label::English (en)": "**G**"}, {"type": "range", "name": "1st", "parameters": "start=0 end=10 step=1", "relevant": "${a-b} == 'x'"}, {"type": "select_one yn", "name": "a-b", "label::English (en)": "A <script>x</script>", "hint": "<i>h</i>"},
         {"type": "end_group"}, {"type": "begin_kobomatrix", "name": "m", "kobo--matrix_list": "rows", "label": "M"}, {"type": "select_one yn", "name": "own", "label": "Own?"}, {"type": "end_kobomatrix"}, {"type": "rank", "name": "r"}, {"type": "select_one_from_file towns.csv", "name": "t"}, {"type": "csv-external", "name": "x"}],
        [{"list_name": "yn", "name": "y", "label::English (en)": "Yes"}, {"list_name": "rows", "name": "bike", "label": "Bike"}, {"list_name": "rows", "name": "car", "label": "Car"}], {"form_title": "T", "form_id": "t", "default_language": "English (en)"})
    return _converted(spark, out, ("type", "name", "label", "constraint", "relevance")).where("name IN ('g_1', 'q_1st', 'a_b', 'bike_own', 'car_own')")


@query("""SELECT * FROM (VALUES ('integer', 'age', '${age}', '. > 7', NULL), ('select_one kind', 'kind', 'Kind', NULL, '${age} > 1'), ('calculate', 'twice', NULL, NULL, NULL)) AS t(type, name, label, "constraint", relevance)""")
def convert_xform(spark, d):
    """An XForm converted: types by schema, references by name, a calculation that only a bind knows."""
    xml = """<h:html xmlns:h="http://www.w3.org/1999/xhtml" xmlns="http://www.w3.org/2002/xforms"><h:head><h:title>T</h:title><model><instance><data id="t"><age/></data></instance>
<bind nodeset="/data/age" type="xsd:int" constraint=". &gt; 7"/><bind nodeset="/data/kind" relevant="/data/age &gt; 1"/><bind nodeset="/data/twice" calculate="/data/age * 2"/></model></h:head><h:body>
<input ref="/data/age"><label><output value="/data/age"/></label></input><select1 ref="/data/kind"><label>Kind</label><item><label>Yes</label><value>y</value></item></select1></h:body></h:html>"""
    return _converted(spark, convert_xforms.convert(xforms.parse(spark, xml)), ("type", "name", "label", "constraint", "relevance"))


def _qsf(k, kind, selector, **more):
    return {"QuestionID": f"QID{k}", "DataExportTag": f"Q{k}", "QuestionText": f"Text {k}", "QuestionType": kind, "Selector": selector, **more}


def _choices(*names):
    return {"Choices": {str(k): {"Display": n} for k, n in enumerate(names, 1)}, "ChoiceOrder": [str(k) for k in range(1, len(names) + 1)]}


def _survey_file():
    leaf = lambda k, op, choice=1: {"LeftOperand": f"q://QID{k}/SelectableChoice/{choice}", "Operator": op, "RightOperand": None, "Type": "Expression"}
    questions = [
        _qsf(1, "MC", "SAVR", **_choices("Yes", "No", "Other"), RecodeValues={"1": "10", "2": "20", "3": "30"}, Validation={"Settings": {"ForceResponse": "ON"}}), _qsf(2, "MC", "MAVR", **_choices("A", "B")),
        _qsf(3, "TE", "SL", Validation={"Settings": {"ForceResponse": "OFF", "ForceResponseType": "ON"}}, DisplayLogic={"0": {"0": leaf(1, "Selected"), "1": leaf(2, "Selected") | {"Conjuction": "Or"}, "Type": "If"}, "Type": "BooleanExpression"}),
        _qsf(4, "Matrix", "Likert", SubSelector="SingleAnswer", **_choices("Price", "Place"), ChoiceDataExportTags={"1": "price", "2": "place"}, Answers={"1": {"Display": "Bad"}, "2": {"Display": "Good"}}, AnswerOrder=["1", "2"]),
        _qsf(5, "CS", "HR", **_choices("Food", "Rent")), _qsf(6, "Slider", "HSLIDER", Configuration={"CSSliderMin": 1, "CSSliderMax": 5, "NumDecimals": "1"}), _qsf(7, "Timing", "PageTimer"), _qsf(8, "Unheard", "Of"), _qsf(9, "TE", "FORM", **_choices("Street", "City")),
    ]
    questions[0]["Choices"]["3"]["TextEntry"] = "true"
    element = lambda k, **more: {"Type": "Question", "QuestionID": f"QID{k}", **more}
    skip = [{"Locator": "q://QID1/SelectableChoice/2", "Condition": "Selected", "SkipToDestination": "QID4"}]
    blocks = [{"ID": "B1", "Description": "First", "BlockElements": [element(1, SkipLogic=skip), element(2), {"Type": "Page Break"}, element(3), element(4)]}, {"ID": "B2", "Description": "Second", "BlockElements": [element(k) for k in range(5, 10)]}]
    flow = [{"Type": "EmbeddedData", "EmbeddedData": [{"Field": "panel", "Value": "p1"}]}, {"Type": "Block", "ID": "B1"}, {"Type": "Branch", "BranchLogic": {"0": {"0": leaf(1, "NotSelected"), "Type": "If"}}, "Flow": [{"Type": "Block", "ID": "B2"}]}]
    elements = [{"Element": "SQ", "PrimaryAttribute": q["QuestionID"], "Payload": q} for q in questions] + [{"Element": "BL", "Payload": blocks}, {"Element": "FL", "Payload": {"Flow": flow}}]
    return json.dumps({"SurveyEntry": {"SurveyName": "S"}, "SurveyElements": elements})


@query("""
SELECT * FROM (VALUES ('panel', 'calculate', NULL, NULL, '''p1''', NULL), ('Q1', 'select_one Q1', NULL, NULL, NULL, 'yes'), ('Q1_other', 'text', 'selected(${Q1}, ''30'')', NULL, NULL, NULL), ('Q2', 'select_multiple Q2', 'not(${Q1} = ''20'')', NULL, NULL, NULL),
 ('Q3', 'text', '(${Q1} = ''10'' or selected(${Q2}, ''1'')) and (not(${Q1} = ''20''))', NULL, NULL, NULL), ('Q4_price', 'select_one Q4', NULL, NULL, NULL, NULL), ('Q4_place', 'select_one Q4', NULL, NULL, NULL, NULL),
 ('Q5_total', 'calculate', NULL, '. = 100', '${Q5_row1} + ${Q5_row2}', NULL), ('Q6', 'decimal', NULL, '. >= 1 and . <= 5', NULL, NULL), ('Q8', 'note', NULL, NULL, NULL, NULL)) AS t(name, type, relevance, "constraint", calculation, required)""")
def convert_survey(spark, d):
    """A survey file converted: recoded choices, display and skip logic, matrices, sums, sliders, embedded data."""
    out = _converted(spark, convert_qsf.convert(qsf.parse(_survey_file())), ("name", "type", "relevance", "constraint", "calculation", "required"))
    return out.where("name IN ('panel', 'Q1', 'Q1_other', 'Q2', 'Q3', 'Q4_price', 'Q4_place', 'Q5_total', 'Q6', 'Q8')")


@query("SELECT 'Q7' AS item, 'dropped' AS status UNION ALL SELECT 'Q8', 'lossy'")
def conversion_report(spark, d):
    """What a conversion lost, and that its Markdown says so."""
    out = convert_qsf.convert(qsf.parse(_survey_file()))
    text = common.report_markdown(out, "Report")
    rows_ = [(r[0], r[1]) for r in out.report if r[1] in ("dropped", "lossy") and r[0].startswith("Q") and f"`{r[0]}` ({r[1]})" in text]
    return spark.createDataFrame(rows_, "item string, status string")


@query("""
SELECT n_regionkey AS book, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS INTEGER) AS excel_row, n_name AS name, 'in ' || n_regionkey || ' & <b>' AS label FROM nation""")
def workbook_sheets(spark, d):
    """A workbook of each region's nations written, and all of them read again, each in a task of its own."""

    def written(key, nations):
        rows_ = nations.sort_values("n_nationkey").to_dict("records")
        content = sheets.write_xlsx({"survey": [{"type": "text", "name": r["n_name"], "label": f"in {r['n_regionkey']} & <b>"} for r in rows_], "choices": [], "settings": [{"form_id": "x"}]})
        return pd.DataFrame([(key[0], content)], columns=["book", "content"])

    def read(batches):
        for files in batches:
            for book, content in files.itertuples(index=False):
                survey = sheets.read_xlsx(content)["survey"]
                yield pd.DataFrame([(book, r.get("excel_row", k + 2), r["name"], r["label"]) for k, r in enumerate(survey)], columns=["book", "excel_row", "name", "label"])

    books = table(spark, d, "nation").groupBy("n_regionkey").applyInPandas(written, "book int, content binary")
    return books.mapInPandas(read, "book int, excel_row int, name string, label string")


@query("SELECT 4 AS bins, 'v' AS field, 'w' AS filtered")
def workbook_of_summaries(spark, d):
    book = sheets.workbook_of(sheets.write_xlsx({"summaries": [{"type": "numeric", "field": "v", "bins": 4}], "global_filters": [{"field": "w", "filter": '("1","2")'}]}))
    return spark.createDataFrame([(book.summaries[0].bins, book.summaries[0].field, book.global_filters[0][0])], "bins int, field string, filtered string")


@query("SELECT '| Term | fr |' AS line, true AS there UNION ALL SELECT '| cat | chat |', true")
def glossary_table(spark, d):
    lines = translation_rules.glossary_markdown([("cat", {"fr": "chat"})], ["fr"]).splitlines()
    return spark.createDataFrame([(x, x in lines) for x in ("| Term | fr |", "| cat | chat |")], "line string, there boolean")
