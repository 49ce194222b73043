"""Queries of what must hold for tables of any size: totals, frequent values, positions, intervals, closures, published runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators.positions import numbers_within
from .plans import explore, publish, rows
from .plans.pages import Pages
from .plans.published import PublishedDataset
from .plans.text_index import TextIndex
from .queries_data import _dataset, aggregated
from .queries_forms import part_sheet
from .registration import CATALOGUE, query, table
from .rules import translation_rules
from .session import shared_folder

S = explore.Summary


@query("""
WITH c AS (
  SELECT CASE grouping(o_orderstatus, o_orderpriority) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'all' END AS level,
    o_orderstatus AS "row", o_orderpriority AS "column", count(*) AS n
  FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
)
SELECT c.level, c."row", c."column", c.n, round(CASE WHEN c.level IN ('cell', 'row') THEN 100.0 * c.n / r.n END, 6) AS percent_row,
  round(CASE WHEN c.level IN ('cell', 'column') THEN 100.0 * c.n / k.n END, 6) AS percent_column, round(100.0 * c.n / a.n, 6) AS percent_all
FROM c JOIN c a ON a.level = 'all' LEFT JOIN c r ON r.level = 'row' AND r."row" = c."row" LEFT JOIN c k ON k.level = 'column' AND k."column" = c."column\"""")
def crosstab_totals(spark, d):
    """Cells, row, column and grand totals with shares of each, by one aggregation."""
    out = explore.compile_summary(S("crosstab", "o_orderstatus", "o_orderpriority", options="totals"), table(spark, d, "orders"))
    return out.withColumns({c: F.round(c, 6) for c in ("percent_row", "percent_column", "percent_all")})


@query("""
SELECT CASE grouping(l_shipmode, l_linenumber) WHEN 0 THEN 'cell' WHEN 1 THEN 'row' WHEN 2 THEN 'column' ELSE 'all' END AS level, l_shipmode AS "row",
  CAST(l_linenumber AS VARCHAR) AS "column", count(*) AS n, round(avg(l_linenumber), 6) AS mean, min(CAST(l_linenumber AS DOUBLE)) AS min, max(CAST(l_linenumber AS DOUBLE)) AS max
FROM (SELECT l_linenumber, CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS l_shipmode FROM lineitem) GROUP BY CUBE (l_shipmode, l_linenumber)""")
def crosstab_measures(spark, d):
    """All of mean, least and most at once, for cells and every total."""
    rows = table(spark, d, "lineitem").select("l_linenumber", F.when(F.col("l_quantity") > 25, "large").otherwise("small").alias("size"))
    out = explore.compile_summary(S("crosstab", "size", "l_linenumber", options="totals,mean,min,max"), rows)
    return out.select("level", "row", "column", "n", F.round("mean", 6).alias("mean"), "min", "max")


@query("""
SELECT c_mktsegment AS "row", CAST(c_nationkey AS VARCHAR) AS "column", round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS percent,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS percent_2
FROM customer GROUP BY c_mktsegment, c_nationkey""")
def crosstab_both_shares(spark, d):
    """The second field's own options: shares within the column beside those within the row."""
    out = explore.compile_summary(S("crosstab", "c_mktsegment", "c_nationkey", options="percent", options_2="percent"), table(spark, d, "customer"))
    return out.withColumns({c: F.round(c, 6) for c in ("percent", "percent_2")}).drop("n")


@query("""
SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1""")
def trend_min_max(spark, d):
    return explore.compile_summary(S("trend", "o_totalprice", "o_orderdate", options="months,min,max"), table(spark, d, "orders"))


@query("""
SELECT text AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents WHERE text <> '' GROUP BY text ORDER BY n DESC, value LIMIT 10""")
def summary_top_values(spark, d):
    """The most frequent whole texts."""
    out = explore.compile_summary(S("text", "text", options="top"), table(spark, d, "documents"))
    return out.withColumn("percent", F.round("percent", 6))


@query("""
SELECT CAST(l_partkey AS VARCHAR) AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY l_partkey ORDER BY n DESC, value LIMIT 20""")
def top_values_of_lines(spark, d):
    out = explore.compile_summary(S("text", "l_partkey", options="top", bins=20), table(spark, d, "lineitem"))
    return out.withColumn("percent", F.round("percent", 6))


# ---- a sheet of table size with groups in groups: a field a part, a group every ten, one around every hundred


def nested_parts(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")

    def row(at, kind, name, relevance=none):
        return F.struct(at.cast("int").alias("excel_row"), F.lit(kind).alias("type"), name.alias("name"), relevance.alias("relevance"))

    first, last = (k - 1) % 10 == 0, k % 10 == 0
    own = [
        F.when((k - 1) % 100 == 0, row(k * 5, "begin repeat", F.concat(F.lit("r"), k))),
        F.when(first, row(k * 5 + 1, "begin group", F.concat(F.lit("g"), k), F.concat(F.lit("${f"), k + 3, F.lit("} = 1")))),
        row(k * 5 + 2, "text", F.concat(F.lit("f"), k), F.when(k % 50 != 1, F.concat(F.lit("${f"), k - 1, F.lit("} > 1")))),
        F.when(last, row(k * 5 + 3, "end group", F.concat(F.lit("g"), k - 9))),
        F.when(k % 100 == 0, row(k * 5 + 4, "end repeat", F.concat(F.lit("r"), k - 99))),
    ]
    rows_of = F.filter(F.array(*own), lambda x: x.isNotNull())
    return table(spark, d, "part").where("p_partkey > 0").select(F.explode(rows_of).alias("r")).select("r.*")


_NESTED = """p AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 0), n AS (SELECT max(k) AS n FROM p),
blocks AS (
  SELECT 'g' || k AS name, 'group' AS kind, k * 5 + 1 AS begin_row, CASE WHEN k + 9 <= n THEN (k + 9) * 5 + 3 END AS end_row, 2 AS depth FROM p, n WHERE k % 10 = 1
  UNION ALL SELECT 'r' || k, 'repeat', k * 5, CASE WHEN k + 99 <= n THEN (k + 99) * 5 + 4 END, 1 FROM p, n WHERE k % 100 = 1
)"""


@query(f"""
WITH {_NESTED} SELECT name, kind, CAST(begin_row AS INTEGER) AS begin_row, CAST(end_row AS INTEGER) AS end_row, CAST(depth AS BIGINT) AS depth FROM blocks""")
def group_markers_nested(spark, d):
    """Begins with their ends and depths: a running sum and numbers by ranges of rows."""
    return rows.marker_pairs(nested_parts(spark, d))


@query(f"""
WITH {_NESTED}, s AS (
  SELECT k * 5 + 2 AS excel_row FROM p UNION ALL SELECT begin_row FROM blocks UNION ALL SELECT end_row FROM blocks WHERE end_row IS NOT NULL
)
SELECT CAST(s.excel_row AS INTEGER) AS excel_row, b.name AS "group", b.kind, CAST(b.depth AS BIGINT) AS depth
FROM s JOIN blocks b ON b.begin_row < s.excel_row AND s.excel_row < b.end_row""")
def groups_around_rows(spark, d):
    """All groups around every row, by cells in place of a join on ranges."""
    sheet = nested_parts(spark, d)
    return rows.enclosing_groups(sheet, sheet)


@query(f"""
WITH {_NESTED}, f AS (SELECT k, k - (k - 1) % 10 AS g FROM p)
SELECT DISTINCT 'f' || k AS source, 'f' || (g + 3) AS target FROM f, n WHERE g + 9 <= n""")
def group_edges_nested(spark, d):
    """What fields depend on through their enclosing groups, at any depth."""
    return rows.group_edges(nested_parts(spark, d)).where("source LIKE 'f%'")


@query("""
WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 0)
SELECT 'f' || a.k AS seed, 'f' || b.k AS node, CAST(a.k - b.k AS INTEGER) AS depth FROM p a JOIN p b ON (a.k - 1) // 50 = (b.k - 1) // 50 AND b.k < a.k""")
def dependency_distances(spark, d):
    """How far every field is from all that it depends on, over chains of fifty, in six rounds."""
    return rows.closure_of_all(rows.refs(rows.row_kind(nested_parts(spark, d), "fields")))


@query("""
SELECT CAST(p_partkey + 1 AS INTEGER) AS excel_row, p_name AS name, p_brand AS label, (SELECT count(*) FROM part WHERE p_size > 25) > 100 AS more_results
FROM part WHERE p_size > 25 ORDER BY p_brand DESC, p_name, excel_row LIMIT 40 OFFSET 60""")
def deep_page(spark, d):
    """A page from an index of sorted runs: one run is read, however far in."""
    pages = Pages(part_sheet(spark, d), {"has": ["hint"]}, [("label", "desc"), ("name", "asc")])
    return pages.page(60, 40, ["excel_row", "name", "label"])


@query("""
SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem""")
def rank_within_hot_keys(spark, d):
    """Ranks within three keys that hold all rows: each key is split over ranges."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return numbers_within(lines, ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], "place")


@query("""
WITH x AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT o_orderkey, coalesce(sum(l_quantity) FILTER (WHERE i > 2), 0) AS after_two, CAST(count(*) FILTER (WHERE i <= 3 AND l_quantity > 10) AS DOUBLE) AS large_of_three
FROM orders LEFT JOIN x ON l_orderkey = o_orderkey GROUP BY 1""")
def repeat_index_conditions(spark, d):
    """index() inside conditions over long rows."""
    return aggregated(spark, d, after_two="sum-if(${l_quantity}, index() > 2)", large_of_three="count-if(${lines}, index() <= 3 and ${l_quantity} > 10)")


@query("""
WITH c AS (
  SELECT 'label:de' AS "column", p_partkey + 1 AS excel_row FROM part UNION ALL SELECT 'hint:de', p_partkey + 1 FROM part WHERE p_size > 25
), o AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY sha256("column" || ':' || excel_row), excel_row) AS n, count(*) OVER (PARTITION BY "column") AS total FROM c
)
SELECT "column", CAST(excel_row AS INTEGER) AS excel_row FROM o WHERE n <= ceil(total * 7.5 / 100)""")
def spot_check_rows(spark, d):
    """Seven and a half percent of each translated column's rows, exactly."""
    sheet = part_sheet(spark, d).withColumn("hint:de", F.concat("hint", F.lit(" de")))
    return translation_rules.spot_check(sheet, 7.5)


# ---- runs and indices


@query(CATALOGUE["publish_add"].oracle)
def publish_in_runs(spark, d):
    """Sums from the runs of two publishers, one batch of them sent twice, merged when read."""
    events = table(spark, d, "events").select("event_id", "user_id", "value", F.when(F.col("value") > 10, "1").otherwise("0").alias("shown"))
    target = PublishedDataset(spark, f"{shared_folder(spark)}/published-{uuid.uuid4().hex[:12]}", "id", _dataset(spark, d), buckets=4)
    link = publish.Link("user_id", "id", [publish.FieldMap("value", "total", publish.ADD)], relevance_field="shown")
    for part, writer, batch in ((0, "a", 0), (1, "b", 0), (1, "b", 0), (2, "a", 1)):
        target.publish(events.where(F.col("event_id") % 3 == part), link, ["event_id"], writer, batch)
    return target.read().withColumn("total", F.round(F.col("total").cast("double"), 4))


@query(CATALOGUE["text_search_ranked"].oracle)
def text_search_indexed(spark, d):
    """The same hits by an index with block maxima."""
    talks = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return TextIndex(talks, "id", "text", block=64).search("The was!", 20).withColumn("score", F.round("score", 6))
