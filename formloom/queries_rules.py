"""Rules, dependencies and findings over sheets of table size: parts, suppliers and lines as rows of forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .convert import common
from .expressions.compiler import scope_of
from .operators import form as forms
from .operators import repeats
from .plans import explore, patches, publish, rows
from .queries_data import columns
from .queries_more import _bundle_files
from .queries_scale import _NESTED, nested_parts
from .registration import CATALOGUE, query, table
from .rules import form_rules
from .sources import bundle, xforms

# ---- dependencies of the nested sheet


@query("""
WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 0)
SELECT 'f' || k AS source, 'f' || (k - 1) AS target, 'relevance' AS slot FROM p WHERE k % 50 <> 1
UNION ALL SELECT 'g' || k, 'f' || (k + 3), 'relevance' FROM p WHERE k % 10 = 1""")
def dependency_edges(spark, d):
    return rows.refs(nested_parts(spark, d))


@query("""
WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 0), n AS (SELECT unnest(range(1, 5)) AS depth)
SELECT 'f' || k AS seed, 'f' || (k - depth) AS node, CAST(depth AS INTEGER) AS depth FROM p, n WHERE k % 50 = 0""")
def dependency_closure(spark, d):
    """What the last field of every fifty depends on, four steps back."""
    fields = rows.row_kind(nested_parts(spark, d), "fields")
    return rows.closure(rows.refs(fields), fields.where("name rlike '^f[0-9]*[05]0$'").select("name"), max_depth=4)


@query("""
WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 0), n AS (SELECT unnest(range(1, 3)) AS depth)
SELECT 'f' || a.k AS seed, 'f' || b.k AS node, CAST(depth AS INTEGER) AS depth FROM p a, n JOIN p b ON b.k = a.k + depth WHERE a.k % 50 = 1""")
def dependency_closure_in(spark, d):
    """What depends on the first field of every fifty, up to two steps on."""
    fields = rows.row_kind(nested_parts(spark, d), "fields")
    return rows.closure(rows.refs(fields), fields.where("name rlike '^f([0-9]*[05])?1$'").select("name"), max_depth=2, reverse=True)


@query(f"""
WITH {_NESTED} SELECT name, kind, CAST(begin_row AS INTEGER) AS begin_row, CAST(end_row AS INTEGER) AS end_row, depth FROM blocks WHERE end_row IS NOT NULL""")
def group_markers(spark, d):
    """Blocks that are closed."""
    return rows.marker_pairs(nested_parts(spark, d)).where("end_row is not null").withColumn("depth", F.col("depth").cast("int"))


@query(f"""
WITH {_NESTED} SELECT CAST(k * 5 + 2 AS INTEGER) AS excel_row, name AS "group" FROM p JOIN blocks ON begin_row < k * 5 + 2 AND k * 5 + 2 < end_row""")
def groups_enclosing(spark, d):
    """The groups around every field."""
    sheet = nested_parts(spark, d)
    return rows.enclosing_groups(sheet, rows.row_kind(sheet, "fields")).select("excel_row", "group")


@query("""
WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 0)
SELECT CASE WHEN k = 4 THEN 'size4' ELSE 'f' || k END AS name, CASE WHEN k % 50 = 1 THEN NULL WHEN k = 5 THEN '${size4} > 1' ELSE '${f' || (k - 1) || '} > 1' END AS relevance FROM p
UNION ALL SELECT 'g' || k, CASE WHEN k = 1 THEN '${size4} = 1' ELSE '${f' || (k + 3) || '} = 1' END FROM p WHERE k % 10 = 1""")
def patch_rename(spark, d):
    """A field renamed, with all references to it, in a sheet of table size."""
    sheet = nested_parts(spark, d)
    new, _ = patches.apply(patches.Sheets(sheet, sheet.limit(0), {}), [{"op": "rename", "kind": "field", "old_name": "f4", "new_name": "size4"}])
    return new.survey.where("type in ('text', 'begin group')").select("name", "relevance")


# ---- a sheet with faults of each kind


def _faulty(spark, d):
    k = F.col("p_partkey")
    c = k % 12
    name = F.when(c == 0, F.concat(F.lit("2x"), k)).when(c == 1, F.concat(F.lit("same"), k % 5)).otherwise(F.concat(F.lit("f"), k))
    calculation = F.when(c == 3, F.concat(F.lit("${gone"), k, F.lit("} + 1"))).when(c == 4, F.lit("${f 1} * 2")).when(c == 5, F.concat(F.lit("if(${f"), k - 3, F.lit("} > 1)")))
    return table(spark, d, "part").select(
        (k + 2).cast("int").alias("excel_row"), F.when(c == 6, F.concat(F.lit("select_one l"), k % 40)).otherwise("text").alias("type"), name.alias("name"),
        F.when(c == 2, F.concat(F.lit("**"), "p_brand", F.lit("**"))).otherwise(F.col("p_brand")).alias("label"), calculation.alias("calculation"),
    )


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 12 AS c FROM part), s AS (SELECT 'l' || (s_suppkey % 20) AS list_name, CAST(s_suppkey % 3 AS VARCHAR) AS value, s_suppkey % 20 = 3 AS bare FROM supplier), f AS (
  SELECT 'VL01' AS rule, CAST(min(k) + 2 AS VARCHAR) AS location, 'name used more than once: same' || (k % 5) AS message FROM p WHERE c = 1 GROUP BY k % 5 HAVING count(*) > 1
  UNION ALL SELECT 'VL02', CAST(k + 2 AS VARCHAR), 'name has other characters: 2x' || k FROM p WHERE c = 0
  UNION ALL SELECT 'VL04', CAST(k + 2 AS VARCHAR), 'no such list: l' || (k % 40) FROM p WHERE c = 6 AND 'l' || (k % 40) NOT IN (SELECT list_name FROM s)
  UNION ALL SELECT DISTINCT 'VL05', list_name, 'no row with value and label' FROM s WHERE bare
  UNION ALL SELECT 'VL06', 'f' || k, 'calculation refers to unknown ' || CASE WHEN c = 3 THEN 'gone' || k ELSE 'f 1' END FROM p WHERE c IN (3, 4)
  UNION ALL SELECT 'VL08', CAST(k + 2 AS VARCHAR), 'Markdown in a label; use HTML' FROM p WHERE c = 2
  UNION ALL SELECT 'VL09', 'settings', 'form_id must begin with a letter and hold letters, digits, _ and - only' FROM region WHERE r_regionkey = 0
  UNION ALL SELECT 'VL11', list_name, 'value used more than once: ' || value FROM s GROUP BY list_name, value HAVING count(*) > 1
  UNION ALL SELECT 'VL24', CAST(k + 2 AS VARCHAR), CASE WHEN c = 4 THEN 'calculation: a field''s name has no spaces' ELSE 'calculation: if() needs a value for true and one for false' END FROM p WHERE c IN (4, 5)
)
SELECT * FROM f""")
def validate_form(spark, d):
    """All rules over a survey of parts, choices of suppliers and settings of a region."""
    n = F.col("s_suppkey")
    choices = table(spark, d, "supplier").select((n + 2).alias("excel_row"), F.concat(F.lit("l"), n % 20).alias("list_name"), (n % 3).cast("string").alias("value"), F.when(n % 20 != 3, F.col("s_name")).alias("label"))
    settings = table(spark, d, "region").where("r_regionkey = 0").select(F.col("r_name").alias("form_title"), F.concat(F.lit("1"), "r_regionkey").alias("form_id"))
    return form_rules.validate(_faulty(spark, d), choices, settings).select("rule", "location", "message")


@query("""
SELECT 'survey' AS sheet, CAST(p_partkey + 2 AS INTEGER) AS excel_row, CASE WHEN p_partkey % 12 = 6 THEN 'select_one l' || (p_partkey % 40) ELSE 'text' END AS kind,
  CASE p_partkey % 12 WHEN 0 THEN '2x' || p_partkey WHEN 1 THEN 'same' || (p_partkey % 5) ELSE 'f' || p_partkey END AS name FROM part WHERE p_partkey < 10
UNION ALL SELECT 'choices', CAST(s_suppkey + 2 AS INTEGER), 'l' || (s_suppkey % 20), CAST(s_suppkey % 3 AS VARCHAR) FROM supplier WHERE s_suppkey < 5""")
def form_previews(spark, d):
    """The first rows of a form's sheets, as its summary shows them."""
    n = F.col("s_suppkey")
    choices = table(spark, d, "supplier").select((n + 2).cast("int").alias("excel_row"), F.concat(F.lit("l"), n % 20).alias("list_name"), (n % 3).cast("string").alias("value"))
    survey = rows.preview(_faulty(spark, d)).select(F.lit("survey").alias("sheet"), "excel_row", F.col("type").alias("kind"), "name")
    return survey.unionByName(rows.preview(choices, "choices", 5).select(F.lit("choices").alias("sheet"), "excel_row", F.col("list_name").alias("kind"), F.col("value").alias("name")))


@query("""
WITH p AS (SELECT p_partkey AS k, p_partkey % 12 AS c FROM part), f AS (
  SELECT 'error' AS severity, 'VL02' AS rule, k + 2 AS place, 'name has other characters: 2x' || k AS message FROM p WHERE c = 0
  UNION ALL SELECT 'warning', 'VL08', k + 2, 'Markdown in a label; use HTML' FROM p WHERE c = 2
  UNION ALL SELECT 'warning', 'VL24', k + 2, CASE WHEN c = 4 THEN 'calculation: a field''s name has no spaces' ELSE 'calculation: if() needs a value for true and one for false' END FROM p WHERE c IN (4, 5)
)
SELECT severity, rule, count(*) AS n, CAST(min(place) AS VARCHAR) AS first_location, arg_min(message, place) AS first_message FROM f GROUP BY 1, 2""")
def form_warnings(spark, d):
    """What a form's summary warns of: a line a rule."""
    sheet = _faulty(spark, d).withColumns({s: F.lit(None).cast("string") for s in ("relevance", "constraint", "choice_filter")})
    found = form_rules.name_characters(sheet).unionByName(form_rules.no_markdown(sheet)).unionByName(form_rules.symptoms(sheet))
    return form_rules.warnings(found)


@query(CATALOGUE["bundle_findings"].oracle)
def bundle_report_rows(spark, d):
    """The JSON reports of all bundles, read back: every finding of every bundle."""
    reports = bundle.report_json(bundle.findings(_bundle_files(spark, d)))
    each = "array<struct<rule: string, location: string, message: string>>"
    read = reports.select("bundle", F.from_json("report", f"struct<errors: {each}, warnings: {each}>").alias("r"))
    of = lambda k, s: F.transform(f"r.{k}", lambda x: F.struct(F.lit(s).alias("severity"), x["rule"].alias("rule"), x["location"].alias("location")))
    return read.select("bundle", F.explode(F.concat(of("errors", "error"), of("warnings", "warning"))).alias("f")).select("bundle", "f.*")


@query("""
WITH f AS (SELECT DISTINCT p_partkey // 10 AS form FROM part)
SELECT form, 'VL13' AS rule FROM f WHERE form % 2 = 0 UNION ALL SELECT form, 'VL12' FROM f WHERE form % 3 = 0
UNION ALL SELECT form, 'VL15' FROM f WHERE form % 3 = 0 UNION ALL SELECT form, 'VL14' FROM f WHERE form % 5 = 0""")
def expression_findings(spark, d):
    """Expression rules over as many forms as there are tens of parts, a form a group."""
    form = F.col("form")
    parts = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).cast("bigint").alias("form")).distinct()
    row = lambda n, kind, name=None, calculation=None, relevance=None: F.struct(F.lit(n).alias("excel_row"), F.lit(kind).alias("type"), F.lit(name).cast("string").alias("name"), F.lit(calculation).cast("string").alias("calculation"), (F.lit(relevance).cast("string") if relevance is None else relevance).alias("relevance"))
    own = [
        row(2, "select_multiple l", "m"), row(3, "begin repeat", "r"), row(4, "integer", "v"), row(5, "end repeat"),
        F.when(form % 2 == 0, row(6, "calculate", "c", "${v} + 1")),
        row(7, "text", "t", None, F.nullif(F.concat_ws(" and ", F.when(form % 3 == 0, "${m} = 'q'"), F.when(form % 5 == 0, "random() > 0.5")), F.lit(""))),
    ]
    survey = parts.select("form", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("r")).select("form", "r.*")
    choices = parts.select("form", F.lit("l").alias("list_name"), F.lit("1").alias("value"), F.lit("One").alias("label"))
    return form_rules.expression_rules_of(survey, choices).select("form", "rule")


@query("""
WITH l AS (SELECT l_orderkey AS k, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS print, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1)
SELECT 'o' || k AS list_name, 'o' || first_value(k) OVER (PARTITION BY print ORDER BY first) AS kept_name FROM l""")
def choice_lists_shared(spark, d):
    """Orders' lines as choice lists: those alike in values, labels and order become one."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    choices = table(spark, d, "lineitem").select((k * 10 + n).alias("excel_row"), F.concat(F.lit("o"), k).alias("list_name"), n.cast("string").alias("value"), F.col("l_returnflag").alias("label"))
    return common.list_prints(choices).select("list_name", "kept_name")


# ---- what had no query


@query("SELECT event_id, ts AS at, true AS past, CAST(ts AS DATE) AS day FROM events")
def instants(spark, d):
    """date-time() of a text, and now()."""
    events = table(spark, d, "events").withColumn("text", F.col("ts").cast("string"))
    return columns(events, scope_of({"ts": "datetime", "text": "string"}), "event_id", at="date-time(${text})", past="now() > ${ts}", day="date(${ts})")


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(max(l_partkey) FILTER (WHERE i = 1) AS VARCHAR) AS item1, CAST(max(l_partkey) FILTER (WHERE i = 2) AS VARCHAR) AS item2 FROM x GROUP BY 1""")
def publish_starred(spark, d):
    """Repeated fields published to numbered columns; a map of a field that the form lacks is found and left out."""
    lines = repeats.numbered(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    wide = repeats.pivot_wide(lines, "l_orderkey", F.col("index"), {"part": "l_partkey"}, 2)
    link = publish.Link("l_orderkey", "id", [publish.FieldMap("part*", "item*"), publish.FieldMap("gone", "x")])
    gone = publish.missing_fields(link, ["part"])
    kept = publish.Link("l_orderkey", "id", [m for m in link.fields if m.form_field not in gone])
    return publish.publish(wide, publish.starred(kept, 2), spark.createDataFrame([], "id string, item1 string, item2 string"), ["l_orderkey"])


@query("SELECT c_custkey, c_mktsegment FROM customer")
def publishable_fields(spark, d):
    """What may leave an encrypted form."""
    form = forms.Form([{"type": "integer", "name": "c_custkey", "publishable": "yes"}, {"type": "text", "name": "c_name"}, {"type": "text", "name": "c_mktsegment", "publishable": "Yes"}, {"type": "decimal", "name": "c_acctbal", "publishable": "no"}])
    return table(spark, d, "customer").select(*publish.publishable(form, encrypted=True))


@query("""
SELECT 'Orders' AS section, 'state' AS label, o_orderstatus AS category, count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'Orders / Urgency', 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def workbook_sections(spark, d):
    """Groups within groups of a workbook's sheet."""
    sheet = [{"type": "begin group", "label": "Orders"}, {"type": "categorical", "field": "o_orderstatus", "label": "state", "options": "count"}, {"type": "begin group", "label": "Urgency"}]
    sheet += [{"type": "categorical", "field": "o_orderpriority", "label": "priority", "options": "count"}, {"type": "end group", "label": "Urgency"}, {"type": "end group", "label": "Orders"}]
    book = explore.Workbook.of_rows(sheet)
    made = zip(book.summaries, explore.compile_workbook(book, table(spark, d, "orders")).values())
    one, two = (out.select(F.lit(s.section).alias("section"), F.lit(s.label).alias("label"), "category", "n") for s, out in made)
    return one.unionByName(two)


@query("""
WITH k AS (SELECT s_suppkey AS k FROM supplier)
SELECT CAST(k AS VARCHAR) AS bundle, 'warning' AS severity, 'script.js' AS location, 'defines no clearAnswer(), which plug-ins must have' AS message FROM k WHERE k % 4 IN (1, 3)
UNION ALL SELECT CAST(k AS VARCHAR), 'warning', 'script.js', 'has no call of setAnswer(), by which answers are reported' FROM k WHERE k % 4 IN (2, 3)""")
def bundle_scripts(spark, d):
    """Plug-in scripts that lack a function they must define, or a call."""
    k = F.col("s_suppkey")
    script = F.concat_ws("\n", F.when((k % 4).isin(0, 2), "clearAnswer = function () {}"), F.when((k % 4).isin(0, 1), "setAnswer (x)"), F.lit("var other = 1"))
    manifest = F.concat(F.lit('{"name": "'), "s_name", F.lit('", "author": "a", "version": "1.0", "supportedFieldTypes": ["text"]}'))
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    files = F.array(file("manifest.json", manifest), file("template.html", F.lit("")), file("style.css", F.lit("")), file("script.js", script))
    made = table(spark, d, "supplier").select(k.cast("string").alias("bundle"), F.concat(F.lit("p"), k, F.lit(".fieldplugin.zip")).alias("zip_name"), F.explode(files).alias("f"))
    found = bundle.findings(made.select("bundle", "zip_name", "f.path", F.encode("f.content", "UTF-8").alias("content")))
    return found.where("rule = 'VL19'").select("bundle", "severity", "location", "message")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS path, action, s_suppkey AS n FROM supplier, (VALUES ('case'), ('update')) AS t(action)
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'close', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'create', s_suppkey FROM supplier WHERE s_suppkey % 3 = 0""")
def xforms_case_actions(spark, d):
    """Case blocks of as many XForms as there are suppliers."""
    k = F.col("s_suppkey")
    xml = F.concat(
        F.lit('<h:html xmlns:h="http://www.w3.org/1999/xhtml" xmlns="http://www.w3.org/2002/xforms"><h:head><h:title>T</h:title><model><instance><data id="f"><a/><case xmlns="'), F.lit(xforms.CASES.strip("{}")), F.lit('" case_id="'), k, F.lit('">'),
        F.when(k % 3 == 0, "<create><case_type>visit</case_type></create>").otherwise(""), F.lit("<update><name/></update>"), F.when(k % 2 == 0, "<close/>").otherwise(""),
        F.lit("</case></data></instance></model></h:head><h:body><input ref=\"/data/a\"><label>A</label></input></h:body></h:html>"),
    )
    files = table(spark, d, "supplier").select(k.cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content"))
    return xforms.tables(files).case_actions.select("path", "action", F.col("path").cast("bigint").alias("n"))
