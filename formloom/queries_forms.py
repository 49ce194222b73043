"""Catalogue: forms, row queries, patches, rules, translations and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .convert import common
from .expressions.compiler import compile_expr, where
from .functions import text
from .operators import form as forms
from .plans import patches, rows, text_search
from .registration import query, table
from .rules import form_rules, translation_rules

#: A form over orders: groups, relevance, a default, chained calculations, constraints, required fields.
ORDER_FORM = [
    {"type": "integer", "name": "o_custkey", "constraint": ". > 100", "constraint message": "small key"},
    {"type": "text", "name": "o_orderstatus", "constraint": "selected('F O', .)", "constraint message": "neither F nor O"},
    {"type": "begin group", "name": "money", "relevance": "${o_orderstatus} != 'P'"},
    {"type": "decimal", "name": "o_totalprice", "constraint": ". >= 1000 and . <= 400000"},
    {"type": "calculate", "name": "net", "calculation": "${o_totalprice} div 1.19"},
    {"type": "calculate", "name": "band", "calculation": "if(${net} > 100000, 'high', 'low')", "relevance": "${net} > 20000"},
    {"type": "end group", "name": "money"},
    {"type": "text", "name": "comment", "required": "yes", "required message": "say why", "relevance": "${band} = 'high'", "default": ""},
    {"type": "text", "name": "o_orderpriority", "label": "Priority"},
]


def order_form():
    return forms.Form([dict(r) for r in ORDER_FORM], settings={"instance_name": "concat(${o_orderstatus}, '-', ${o_custkey})"})


def orders(spark, d):
    return table(spark, d, "orders").withColumn("comment", F.when(F.col("o_orderkey") % 3 == 0, "ok").otherwise(F.lit(None)))


_EVALUATED = """
WITH e AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderstatus <> 'P' AS money, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'ok' END AS said FROM orders),
n AS (SELECT *, CASE WHEN money THEN price END AS total, CASE WHEN money THEN price / 1.19::DOUBLE END AS net FROM e),
b AS (SELECT *, coalesce(net > 20000, false) AND money AS shown, CASE WHEN coalesce(net > 20000, false) AND money THEN CASE WHEN net > 100000 THEN 'high' ELSE 'low' END END AS band FROM n)
"""


@query(_EVALUATED + "SELECT o_orderkey, o_orderstatus || '-' || o_custkey AS name, total, round(net, 6) AS net, band, CASE WHEN band = 'high' THEN said END AS comment FROM b")
def form_evaluate(spark, d):
    f = order_form()
    scope = f.scope()
    out = forms.evaluate(f, orders(spark, d), scope)
    return out.select("o_orderkey", forms.instance_name(f, scope).alias("name"), F.col("o_totalprice").alias("total"), F.round("net", 6).alias("net"), "band", "comment")


@query(_EVALUATED + """
SELECT o_orderkey, 'o_custkey' AS field, 'constraint' AS rule, 'small key' AS message FROM b WHERE o_custkey <= 100
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'constraint', 'neither F nor O' FROM b WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'o_totalprice', 'constraint', NULL FROM b WHERE total IS NOT NULL AND NOT (total BETWEEN 1000 AND 400000)
UNION ALL SELECT o_orderkey, 'comment', 'required', 'say why' FROM b WHERE band = 'high' AND said IS NULL""")
def relevance_constraint_violations(spark, d):
    f = order_form()
    scope = f.scope()
    return forms.violations(f, forms.evaluate(f, orders(spark, d), scope), "o_orderkey", scope).drop("index")


#: A form whose repeat computes within instances and is summed outside.
LINE_FORM = [
    {"type": "decimal", "name": "o_totalprice"},
    {"type": "begin repeat", "name": "lines", "relevance": "${o_totalprice} > 50000"},
    {"type": "decimal", "name": "l_quantity", "constraint": ". <= 48", "constraint message": "too many"},
    {"type": "decimal", "name": "l_extendedprice"},
    {"type": "decimal", "name": "l_discount", "relevance": "${l_quantity} > 5", "required": "yes"},
    {"type": "calculate", "name": "net", "calculation": "${l_extendedprice} * (1 - ${l_discount})", "relevance": "${l_quantity} > 5"},
    {"type": "calculate", "name": "share", "calculation": "${net} div ${o_totalprice} + index()"},
    {"type": "end repeat", "name": "lines"},
    {"type": "calculate", "name": "total", "calculation": "sum(${net})"},
    {"type": "calculate", "name": "many", "calculation": "count-if(${lines}, ${share} > 2)"},
]


def _line_orders(spark, d):
    from .queries_data import submissions

    return submissions(spark, d).select("o_orderkey", "o_totalprice", "lines")


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
n AS (SELECT l_orderkey, i, CASE WHEN l_quantity > 5 THEN l_extendedprice * (1 - l_discount) END AS net FROM x)
SELECT o_orderkey, round(coalesce(sum(net) FILTER (WHERE o_totalprice > 50000), 0), 4) AS total, CAST(count(*) FILTER (WHERE o_totalprice > 50000 AND net / o_totalprice + i > 2) AS DOUBLE) AS many FROM orders LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY 1""")
def form_evaluate_repeats(spark, d):
    out = forms.evaluate(forms.Form([dict(r) for r in LINE_FORM]), _line_orders(spark, d))
    return out.select("o_orderkey", F.round("total", 4).alias("total"), "many")


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT o_orderkey, 'l_quantity' AS field, 'constraint' AS rule, 'too many' AS message, CAST(i AS INTEGER) AS "index" FROM orders JOIN x ON l_orderkey = o_orderkey WHERE o_totalprice > 50000 AND l_quantity > 48""")
def repeat_violations(spark, d):
    f = forms.Form([dict(r) for r in LINE_FORM])
    scope = f.scope()
    return forms.violations(f, forms.evaluate(f, _line_orders(spark, d), scope), "o_orderkey", scope)


@query("SELECT o_orderkey, 'Order of ' || o_orderpriority || ' by ' || o_custkey || '!' AS label FROM orders")
def label_interpolation(spark, d):
    f = order_form()
    return table(spark, d, "orders").select("o_orderkey", forms.interpolate("Order of ${o_orderpriority} by ${o_custkey}!", f.scope()).alias("label"))


@query("""
SELECT user_id AS "KEY", count(*) FILTER (WHERE (event_type = 'click' AND value < 20) OR (event_type = 'view' AND value < 5)) AS n_fast,
       coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (WHERE (event_type = 'click' AND value < 20) OR (event_type = 'view' AND value < 5)), '') AS fast_fields FROM events GROUP BY 1""")
def speed_violations(spark, d):
    f = forms.Form([{"type": "text", "name": "click", "minimum_seconds": "20"}, {"type": "text", "name": "view", "minimum_seconds": "5"}, {"type": "text", "name": "error"}])
    timings = table(spark, d, "events").select(F.col("user_id").alias("KEY"), F.col("event_type").alias("field"), F.col("value").alias("seconds"), F.col("event_id").alias("seq"))
    return forms.speed_violations(timings, f)


# ---- row queries: parts as a sheet


def part_sheet(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") + 1).cast("int").alias("excel_row"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("label"), F.concat(F.lower("p_brand"), F.lit(" de")).alias("label:de"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).alias("hint"))


@query("""
WITH s AS (SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, p_type AS type, p_name AS name, p_brand AS label, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END AS hint FROM part),
f AS (SELECT * FROM s WHERE type IN ('ECONOMY', 'STANDARD', 'PROMO') AND (hint <> '' OR regexp_matches(name, '(?i)BLUE')) AND NOT label = 'Brand#2' AND excel_row BETWEEN 20 AND 1500)
SELECT excel_row, name, label, (SELECT count(*) FROM f) > 70 AS more_results FROM f ORDER BY label DESC, name, excel_row LIMIT 50 OFFSET 20""")
def row_query_page(spark, d):
    tree = {"and": [{"in": ["type", ["ECONOMY", "STANDARD", "PROMO"]]}, {"or": [{"has": ["hint"]}, {"regex": ["name", "(?i)BLUE"]}]}, {"not": {"eq": ["label", "Brand#2"]}}, {"between": ["excel_row", 20, 1500, "inclusive"]}]}
    return rows.query(part_sheet(spark, d), tree, [("label", "desc"), ("name", "asc")], 20, 50, ["excel_row", "name", "label"])


@query("""
WITH f AS (SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, lower(p_brand) || ' ' || lower(p_brand) || ' de' AS labels_concat_lower FROM part WHERE regexp_matches(p_name, 'brand#2[35] de') OR regexp_matches(lower(p_brand) || ' ' || lower(p_brand) || ' de', 'brand#2[35] de'))
SELECT excel_row, labels_concat_lower, (SELECT count(*) FROM f) > 100 AS more_results FROM f ORDER BY excel_row LIMIT 100""")
def row_query_fulltext(spark, d):
    return rows.query(part_sheet(spark, d), {"fulltext": ["brand#2[35] de"]}, columns=["excel_row", "labels_concat_lower"])


# ---- rules


@query("""
SELECT 'VL01' AS rule, 'name used more than once: ' || l_orderkey || '/' || l_linenumber AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'VL04', 'no such list: o' || o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def validate_duplicates_orphans(spark, d):
    items, heads = table(spark, d, "lineitem"), table(spark, d, "orders")
    lines = items.select(F.monotonically_increasing_id().alias("excel_row"), F.lit("text").alias("type"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("name"))
    twice = form_rules.unique_names(lines)
    selects = heads.select(F.col("o_orderkey").alias("excel_row"), F.concat(F.lit("select_one o"), "o_orderkey").alias("type"), F.col("o_orderkey").cast("string").alias("name"))
    choices = items.select(F.col("l_orderkey").alias("excel_row"), F.concat(F.lit("o"), "l_orderkey").alias("list_name"), F.col("l_linenumber").cast("string").alias("value"), F.lit("x").alias("label"))
    return twice.unionByName(form_rules.lists_exist(selects, choices)).select("rule", "message")


@query("""
WITH x AS (SELECT n_nationkey, regexp_replace(regexp_replace(regexp_replace(n_name || '-' || (n_nationkey % 3), '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^[A-Z]+_', '') AS s FROM nation),
y AS (SELECT n_nationkey, 'q_' || s AS s, row_number() OVER (PARTITION BY s ORDER BY n_nationkey) AS n FROM x)
SELECT n_nationkey, CASE WHEN n = 1 THEN s ELSE s || '_' || n END AS safe_name FROM y""")
def safe_names(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.regexp_replace(F.concat_ws("-", "n_name", (F.col("n_nationkey") % 3).cast("string")), r"^[A-Z_ -]+", "").alias("raw"))
    return common.safe_name_column(df, "raw", "n_nationkey").select("n_nationkey", "safe_name")


# ---- patches: nations as a sheet


@query("""
WITH s AS (SELECT CAST(n_nationkey + 2 AS DOUBLE) AS pos, n_name AS name, CAST(n_regionkey AS VARCHAR) AS label, NULL AS note FROM nation),
e AS (SELECT pos, CASE WHEN pos = 5 THEN 'EDITED' ELSE name END AS name, CASE WHEN pos = 5 THEN NULL ELSE label END AS label, CASE WHEN pos = 6 THEN 'seen' END AS note FROM s WHERE pos NOT IN (4, 10)
      UNION ALL VALUES (6.5, 'NEW', '9', NULL), (99.0, 'LAST', NULL, 'end'))
SELECT CAST(row_number() OVER (ORDER BY pos) + 1 AS INTEGER) AS excel_row, name, label, note FROM e""")
def patch_apply(spark, d):
    sheet = table(spark, d, "nation").select((F.col("n_nationkey") + 2).cast("int").alias("excel_row"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("label"))
    batch = [
        {"op": "delete_row", "sheet": "choices", "excel_row": 4}, {"op": "edit_row", "sheet": "choices", "excel_row": 5, "values": {"name": "EDITED", "label": None}}, {"op": "add_row", "sheet": "choices", "insert_before_excel_row": 7, "values": {"name": "NEW", "label": "9"}},
        {"op": "delete_row", "sheet": "choices", "excel_row": 10}, {"op": "add_row", "sheet": "choices", "values": {"name": "LAST", "note": "end"}}, {"op": "edit_row", "sheet": "choices", "excel_row": 6, "values": {"note": "seen"}},
    ]
    new, _ = patches.apply(patches.Sheets(part_sheet(spark, d), sheet, {}), batch)
    return new.choices


# ---- translations and texts


@query("""
SELECT 'label:de' AS "column", count(*) FILTER (WHERE p_brand <> '') AS n_default, count(*) FILTER (WHERE p_size % 7 <> 0) AS n_translated FROM part
UNION ALL SELECT 'hint:de', count(*) FILTER (WHERE p_size > 25), count(*) FILTER (WHERE p_size > 30) FROM part""")
def translation_parity(spark, d):
    return translation_rules.parity(_translated(spark, d))


def _translated(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    return p.select((F.col("p_partkey") + 1).cast("int").alias("excel_row"), F.concat(F.col("p_brand"), F.lit(" ${f} <b>x</b>")).alias("label"), F.when(size % 7 != 0, F.concat(F.upper("p_brand"), F.when(size % 5 == 0, F.lit(" <b>x</b>")).otherwise(F.lit(" ${f} <b>x</b>")))).alias("label:de"),
                    F.when(size > 25, F.lit("how big")).alias("hint"), F.when(size > 30, F.lit("wie gross")).alias("hint:de"))


@query("SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, 'label:de' AS \"column\", '${f}' AS lost FROM part WHERE p_size % 7 <> 0 AND p_size % 5 = 0")
def translation_tokens(spark, d):
    return translation_rules.tokens_kept(_translated(spark, d)).select("excel_row", "column", F.array_join("lost", ",").alias("lost"))


@query("""
SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, 'label' AS "column", 'de' AS language FROM part WHERE p_size % 7 = 0 UNION ALL SELECT CAST(p_partkey + 1 AS INTEGER), 'hint', 'de' FROM part WHERE p_size > 25 AND p_size <= 30""")
def translation_missing(spark, d):
    return translation_rules.missing(_translated(spark, d))


@query("""
SELECT 'de' AS language, p_brand || ' ${f} <b>x</b>' AS source, CAST(count(DISTINCT p_size % 5 = 0) AS INTEGER) AS n FROM part WHERE p_size % 7 <> 0 GROUP BY p_brand HAVING count(DISTINCT p_size % 5 = 0) > 1""")
def glossary_conflicts(spark, d):
    return translation_rules.glossary_conflicts(_translated(spark, d)).select("language", "source", F.size("targets").alias("n"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def html_plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)\s+on[a-z]+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g'), '(?i)javascript:', '', 'g') AS s FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(s, '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '(?i)</?(html|body)\b[^>]*>|<!doctype[^>]*>', '', 'g'), ' ') AS safe FROM a""")
def html_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_html(F.col("html")).alias("safe"))


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def language_inventory(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"))


@query("SELECT o_orderkey, true AS adult, 3 AS n FROM orders WHERE o_totalprice > 300000")
def filtered_expression(spark, d):
    scope = order_form().scope()
    df = table(spark, d, "orders").where(where("${o_totalprice} > 300000", scope))
    return df.select("o_orderkey", compile_expr("not(${o_custkey} < 0)", scope).col.alias("adult"), F.lit(3).alias("n"))


@query("""
WITH w AS (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM conversations),
t AS (SELECT id, len(w) AS size, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'was')) AS b FROM w),
c AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM t)
SELECT id, round(ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)), 6) AS score
FROM t, c WHERE a > 0 OR b > 0 ORDER BY ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) DESC, id LIMIT 20""")
def text_search_ranked(spark, d):
    talks = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return text_search.search(talks, "id", "text", "The was!", 20).withColumn("score", F.round("score", 6))
