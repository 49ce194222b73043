"""Catalogue: expressions, repeats, lookups, summaries and publishing over the driver's tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from .expressions.compiler import compile_expr, scope_of
from .functions import lists
from .operators import choices, lookup, positions, repeat_plans, repeats
from .plans import explore, publish
from .plans.published import PublishedDataset
from .registration import CATALOGUE, query, table
from .session import shared_folder
from .streaming.publisher import publish_stream

LINES = {"l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_partkey": "number", "l_linenumber": "number"}


def submissions(spark, d):
    """Orders with their line items as the array ``lines``, in the order of line, part and supplier."""
    items = table(spark, d, "lineitem")
    return repeats.nest(table(spark, d, "orders"), items, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], {m: m for m in LINES}, "lines")


def over_lines(**more):
    return scope_of({"o_orderkey": "number", "o_totalprice": "number", "o_orderpriority": "string"}, {"lines": LINES}, **more)


def columns(df, scope, key, **expressions):
    return df.select(*([key] if isinstance(key, str) else key), *[compile_expr(e, replace(scope, of=n)).col.alias(n) for n, e in expressions.items()])


def aggregated(spark, d, **expressions):
    """Repeat aggregates straight from the line items, without nesting them."""
    orders, scope = table(spark, d, "orders"), over_lines()
    return repeat_plans.aggregate(orders, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "lines", LINES, scope, expressions, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


@query("""
WITH c AS (SELECT o_orderkey, o_orderpriority, coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity >= 25), 0) AS big
           FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice BETWEEN 50000 AND 400000 GROUP BY 1, 2)
SELECT o_orderpriority AS category, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 6) AS percent FROM c WHERE big > 40000 GROUP BY 1""")
def priority_share(spark, d):
    df = explore.keep(table(spark, d, "orders"), "o_totalprice", '("50000","400000")')
    e = {"o_orderpriority": "${o_orderpriority}", "big": "sum-if(${l_extendedprice}, ${l_quantity} >= 25) > 40000"}
    kept = repeat_plans.aggregate(df, table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", "lines", LINES, over_lines(), e).where("big")
    out = explore.compile_summary(explore.Summary("categorical", "o_orderpriority", options="count,percent"), kept)
    return out.withColumn("percent", F.round("percent", 6))


@query("""
SELECT o_orderkey, round(coalesce(sum(l_extendedprice), 0), 2) AS total, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity >= 25), 0), 2) AS big,
       CAST(count(l_orderkey) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE l_discount > 0.05) AS DOUBLE) AS n_reduced
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def repeat_sum_count_if(spark, d):
    return aggregated(spark, d, total="round(sum(${l_extendedprice}), 2)", big="round(sum-if(${l_extendedprice}, ${l_quantity} >= 25), 2)", n="count(${lines})", n_reduced="count-if(${lines}, ${l_discount} > 0.05)")


@query("""
SELECT o_orderkey, min(l_quantity) AS least, max(l_quantity) AS most, min(l_extendedprice) FILTER (WHERE l_quantity > 10) AS least_if, max(l_extendedprice) FILTER (WHERE l_quantity <= 10) AS most_if
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def repeat_min_max_if(spark, d):
    return aggregated(spark, d, least="min(${l_quantity})", most="max(${l_quantity})", least_if="min-if(${l_extendedprice}, ${l_quantity} > 10)", most_if="max-if(${l_extendedprice}, ${l_quantity} <= 10)")


@query("""
SELECT o_orderkey, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_extendedprice > o_totalprice / 4), 0), 2) AS large, CAST(count(*) FILTER (WHERE l_quantity > 10) AS DOUBLE) / nullif(count(l_orderkey), 0) AS share
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def repeat_nested_aggregates(spark, d):
    """Aggregates over arrays, with predicates that look at the submission."""
    return columns(submissions(spark, d), over_lines(), "o_orderkey", large="round(sum-if(${l_extendedprice}, ${l_extendedprice} > ${o_totalprice} div 4), 2)", share="count-if(${lines}, ${l_quantity} > 10) div count(${lines})")


@query("""
SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, coalesce(string_agg(text, '|' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS asked FROM conversations GROUP BY 1""")
def repeat_join_if(spark, d):
    turns = table(spark, d, "conversations")
    talks = repeats.nest(turns.select("conv_id").distinct(), turns, "conv_id", "conv_id", ["turn"], {"role": "role", "text": "text"}, "turns")
    scope = scope_of({"conv_id": "number"}, {"turns": {"role": "string", "text": "string"}})
    return columns(talks, scope, "conv_id", roles="join('>', ${role})", asked="join-if('|', ${text}, ${role} = 'user')")


@query("""
WITH x AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
p AS (SELECT l_orderkey, max(l_partkey) FILTER (WHERE i = 1) AS a, max(l_partkey) FILTER (WHERE i = 2) AS b, max(l_partkey) FILTER (WHERE i = 40) AS c FROM x GROUP BY 1)
SELECT o_orderkey, CAST(a AS BIGINT) AS first_part, CAST(coalesce(b, a) AS BIGINT) AS second_part, CAST(coalesce(c, a) AS BIGINT) AS fortieth_part FROM orders LEFT JOIN p ON l_orderkey = o_orderkey""")
def repeat_indexed(spark, d):
    part = lambda k: f"indexed-repeat(${{l_partkey}}, ${{lines}}, {k})"
    return aggregated(spark, d, first_part=part(1), second_part=part(2), fortieth_part=part(40))


@query("""
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS "index", l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WINDOW w AS (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)
UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def repeat_long_form(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return repeats.long_rows(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", order, {"l_quantity": "l_quantity"})


@query("""
WITH x AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT o_orderkey, max(l_quantity) FILTER (WHERE i = 1) AS l_quantity_1, max(l_quantity) FILTER (WHERE i = 2) AS l_quantity_2, max(l_quantity) FILTER (WHERE i = 3) AS l_quantity_3
FROM orders LEFT JOIN x ON l_orderkey = o_orderkey GROUP BY 1""")
def repeat_wide_form(spark, d):
    return repeats.wide_form(submissions(spark, d).select("o_orderkey", "lines"), "lines", "l_quantity", 3)


@query("""
WITH x AS (SELECT l_orderkey, l_extendedprice AS v, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
a AS (SELECT l_orderkey, i, q, row_number() OVER (PARTITION BY l_orderkey ORDER BY v DESC, i) AS r FROM x),
b AS (SELECT l_orderkey, i, row_number() OVER (PARTITION BY l_orderkey ORDER BY v DESC, i) AS r FROM x WHERE q < 25)
SELECT o_orderkey, CAST(coalesce(max(a.r) FILTER (WHERE a.i = 1), 999) AS DOUBLE) AS rank_first, CAST(coalesce(max(b.r) FILTER (WHERE b.i = 2), 999) AS DOUBLE) AS rank_second_small
FROM orders LEFT JOIN a ON a.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey GROUP BY 1""")
def rank_index_if(spark, d):
    return aggregated(spark, d, rank_first="rank-index(1, ${l_extendedprice})", rank_second_small="rank-index-if(2, ${l_extendedprice}, ${l_quantity} < 25)")


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT l_orderkey, CAST(i AS INTEGER) AS "index", CAST(CASE WHEN l_quantity < 25 THEN row_number() OVER (PARTITION BY l_orderkey, l_quantity < 25 ORDER BY l_extendedprice DESC, i) ELSE 999 END AS INTEGER) AS rank FROM x""")
def rank_long_form(spark, d):
    rows = repeats.numbered(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    rank = repeats.rank_long(rows, "l_orderkey", F.col("l_extendedprice"), F.col("index"), F.col("l_quantity") < 25)
    return rows.select("l_orderkey", "index", rank.alias("rank"))


@query("""
WITH x AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT o_orderkey, CAST(least(2, count(i)) AS INTEGER) AS n_filled, 2 AS n FROM orders LEFT JOIN x ON l_orderkey = o_orderkey GROUP BY 1""")
def repeat_count_fixed(spark, d):
    rows = repeats.counted(F.col("lines"), F.lit(2))
    return submissions(spark, d).select("o_orderkey", F.size(F.filter(rows, lambda x: x.isNotNull())).alias("n_filled"), F.size(rows).alias("n"))


@query("""
SELECT o_orderkey, c_name AS customer, c_acctbal AS balance, c_mktsegment AS segment, n_name AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def pulldata_lookup(spark, d):
    scope = scope_of({"o_custkey": "number"})
    wanted = {"customer": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment", "c_nationkey": "c_nationkey"}
    text = {n: f"pulldata('customer', '{c}', 'c_custkey', ${{o_custkey}})" for n, c in wanted.items()}
    text["balance"] = f"number({text['balance']})"
    df, scope = lookup.Pulled({"customer": table(spark, d, "customer")}, {"customer": ["c_custkey", "c_name"]}).join(table(spark, d, "orders"), list(text.values()), scope)
    df = columns(df, scope, "o_orderkey", **text)
    scope = scope_of({"c_nationkey": "string"})
    nation = "pulldata('nation', 'n_name', 'n_nationkey', ${c_nationkey})"
    df, scope = lookup.Pulled({"nation": table(spark, d, "nation")}, {"nation": ["n_nationkey"]}).join(df, [nation], scope)
    return columns(df, scope, ["o_orderkey", "customer", "balance", "segment"], nation=nation)


@query("SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS value, p_name || ' ' || p_brand AS label FROM part WHERE contains(p_name, 'e') OR contains(p_type, 'ALL')")
def search_contains(spark, d):
    return lookup.search(table(spark, d, "part"), "p_partkey", "p_name,p_brand", "contains", "p_name", "e").unionByName(lookup.search(table(spark, d, "part"), "p_partkey", "p_name,p_brand", "contains", "p_type", "ALL")).distinct()


@query("SELECT DISTINCT p_brand AS value, p_type AS label FROM part WHERE starts_with(p_brand, 'Brand#1')")
def search_startswith(spark, d):
    return lookup.search(table(spark, d, "part"), "p_brand", "p_type", "startswith", "p_brand", "Brand#1")


@query("SELECT DISTINCT p_brand AS value, p_type AS label FROM part WHERE ends_with(p_type, 'L') OR ends_with(p_brand, '3')")
def search_endswith(spark, d):
    return lookup.search(table(spark, d, "part"), "p_brand", "p_type", "endswith", "p_type, p_brand", "L").unionByName(lookup.search(table(spark, d, "part"), "p_brand", "p_type", "endswith", "p_brand", "3")).distinct()


@query("SELECT DISTINCT c_name AS value, c_mktsegment AS label FROM customer WHERE c_mktsegment = 'BUILDING' AND CAST(c_nationkey AS VARCHAR) = '7'")
def search_matches_filter(spark, d):
    return lookup.search(table(spark, d, "customer"), "c_name", "c_mktsegment", "matches", "c_mktsegment", "BUILDING", "c_nationkey", "7")


@query("SELECT DISTINCT p_brand AS value, p_name AS label FROM part WHERE contains(p_name, 'red') AND p_type = 'PROMO'")
def search_appearance(spark, d):
    return lookup.search_by("minimal search('parts', 'contains', 'p_name', 'red', 'p_type', 'PROMO')", {"parts": table(spark, d, "part")}, "p_brand", "p_name")


@query("SELECT DISTINCT n_nationkey, c_name AS value FROM nation JOIN customer ON CAST(c_nationkey AS VARCHAR) = CAST(n_nationkey AS VARCHAR)")
def search_each_matches(spark, d):
    return lookup.search_each(table(spark, d, "nation"), table(spark, d, "customer"), "n_nationkey", "matches", "c_nationkey", F.col("n_nationkey").cast("string"), "c_name")


@query("SELECT DISTINCT r_regionkey, n_name AS value FROM region JOIN nation ON contains(n_name, substr(r_name, 1, 1))")
def search_each_contains(spark, d):
    return lookup.search_each(table(spark, d, "region"), table(spark, d, "nation"), "r_regionkey", "contains", "n_name", F.substring("r_name", 1, 1), "n_name")


@query("SELECT r_regionkey, string_agg(n_name, ' ' ORDER BY n_nationkey) AS choices FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def cascading_choices(spark, d):
    return choices.cascading_rows(table(spark, d, "region"), table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "r_regionkey", "n_nationkey", "n_name")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done archived' WHEN o_orderstatus = 'O' THEN 'open' ELSE '' END AS shown FROM orders""")
def cascading_static(spark, d):
    rows = [{"value": "done", "label": "Done", "filter": "F"}, {"value": "open", "label": "Open", "filter": "O"}, {"value": "archived", "label": "Archived", "filter": "F"}]
    own = choices.cascading(rows, "filter = ${o_orderstatus}", scope_of({"o_orderstatus": "string"}))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(own, lambda x: x["value"]), " ").alias("shown"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN 'Clicked' WHEN 'view' THEN 'Viewed' WHEN 'purchase' THEN 'Bought' END AS label FROM events""")
def choice_label(spark, d):
    scope = scope_of({"event_type": "string"}, labels={"event_type": {"click": "Clicked", "view": "Viewed", "purchase": "Bought"}})
    return columns(table(spark, d, "events"), scope, "event_id", label="choice-label(${event_type}, ${event_type})")


@query("""
WITH x AS (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda v: v <> '') AS w FROM part)
SELECT p_partkey, CAST(len(w) AS DOUBLE) AS n, list_contains(w, 'red') AS has_red, w[2] AS second, CAST(list_contains(w, 'blue') AS INTEGER) AS name_blue, CAST(list_contains(w, 'green') AS INTEGER) AS name_green FROM x""")
def select_multiple_flags(spark, d):
    scope = scope_of({"p_name": "string"})
    e = {"n": "count-selected(${p_name})", "has_red": "selected(${p_name}, 'red')", "second": "selected-at(${p_name}, 1)"}
    return table(spark, d, "part").select("p_partkey", *[compile_expr(t, scope).col.alias(n) for n, t in e.items()], *lists.dummies(F.col("p_name"), ["blue", "green"], "name"))


@query("""
WITH x AS (SELECT doc_id, string_split(text, ',') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS DOUBLE) AS n, w[2] AS second, CAST(coalesce(list_position(w, ' the'), 0) - 1 AS DOUBLE) AS place, list_contains(w, ' the') AS present, CAST(len(list_distinct(w)) AS DOUBLE) AS n_distinct FROM x""")
def list_functions(spark, d):
    scope = scope_of({"text": "string"})
    return columns(table(spark, d, "documents"), scope, "doc_id", n="count-items(',', ${text})", second="item-at(',', ${text}, 1)", place="item-index(',', ${text}, ' the')", present="item-present(',', ${text}, ' the')", n_distinct="count-items(',', de-duplicate(',', ${text}))")


@query("SELECT p_partkey, CAST((p_size < 2)::INT + (p_size < 7)::INT + (p_size < 10)::INT + (p_size < 30)::INT + 1 AS DOUBLE) AS rank FROM part")
def rank_value(spark, d):
    return columns(table(spark, d, "part"), scope_of({"p_size": "number"}), "p_partkey", rank="rank-value(${p_size}, '10 2 30 7')")


@query("""
SELECT doc_id, substr(text, 6, 10) AS middle, CAST(length(text) AS DOUBLE) AS size, upper(source) AS big, lower(source) AS small, source || '-' || lang || chr(10) || CAST(n_chars AS VARCHAR) AS name,
       contains(text, 'the') AS has_the, starts_with(source, 'src1') AS starts, ends_with(source, '1') AS ends, regexp_matches(source, '^src[0-9]$') AS one_digit FROM documents""")
def string_functions(spark, d):
    scope = scope_of({"text": "string", "source": "string", "lang": "string", "n_chars": "number"})
    return columns(table(spark, d, "documents"), scope, "doc_id", middle="substr(${text}, 5, 15)", size="string-length(${text})", big="upper(${source})", small="lower(${source})", name="concat(${source}, '-', ${lang}, linebreak(), ${n_chars})",
                   has_the="contains(${text}, 'the')", starts="starts-with(${source}, 'src1')", ends="ends-with(${source}, '1')", one_digit="regex(${source}, '^src[0-9]$')")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) / l_quantity, 9) AS unit, CAST(l_orderkey % 7 AS DOUBLE) AS rest, CAST(trunc(l_extendedprice) AS DOUBLE) AS whole,
       round(sqrt(l_quantity) + ln(l_quantity) / ln(10) + exp(l_discount) + pow(l_quantity, 2) + abs(l_discount - 1), 6) AS mixed, round(sin(l_quantity) + cos(l_quantity) + atan(l_quantity) + atan2(l_discount, l_quantity) + pi(), 6) AS turned,
       least(l_quantity, l_tax, l_discount) AS least, greatest(l_quantity, l_tax) AS most, -l_tax AS minus FROM lineitem""")
def math_functions(spark, d):
    scope = scope_of({k: "number" for k in ("l_orderkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax")})
    return columns(table(spark, d, "lineitem"), scope, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], unit="round(${l_extendedprice} * (1 - ${l_discount}) div ${l_quantity}, 9)", rest="${l_orderkey} mod 7", whole="int(${l_extendedprice})",
                   mixed="round(sqrt(${l_quantity}) + log10(${l_quantity}) + exp(${l_discount}) + pow(${l_quantity}, 2) + abs(${l_discount} - 1), 6)", turned="round(sin(${l_quantity}) + cos(${l_quantity}) + atan(${l_quantity}) + atan2(${l_quantity}, ${l_discount}) + pi(), 6)",
                   least="min(${l_quantity}, ${l_tax}, ${l_discount})", most="max(${l_quantity}, ${l_tax})", minus="-${l_tax}")


@query("""
SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-12-31') AS DOUBLE) AS age, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due, strftime(o_orderdate, '%Y-%m-%d at %H:%M') AS shown,
       round(epoch(o_orderdate) / 86400.0, 6) AS days, strftime(o_orderdate, '%y/%m') AS month, CAST(o_orderdate AS DATE) >= DATE '1998-01-01' AS late FROM orders""")
def date_functions(spark, d):
    scope = scope_of({"o_orderdate": "datetime"}, today=F.lit("2001-12-31").cast("date"))
    return columns(table(spark, d, "orders"), scope, "o_orderkey", age="today() - date(${o_orderdate})", due="date(${o_orderdate}) + 30", shown="format-date-time(${o_orderdate}, '%Y-%m-%d at %H:%M')", days="round(decimal-date-time(${o_orderdate}), 6)", month="format-date(${o_orderdate}, '%y/%m')", late="date(${o_orderdate}) >= date('1998-01-01')")


@query("SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / CAST(86400 AS DOUBLE) AS part_of_day, strftime(ts, '%H:%M:%S') AS time FROM events")
def time_of_day(spark, d):
    events = table(spark, d, "events").withColumn("clock", F.date_format("ts", "HH:mm:ss"))
    return columns(events, scope_of({"ts": "datetime", "clock": "string"}), "event_id", part_of_day="decimal-time(${clock})", time="format-date-time(${ts}, '%H:%M:%S')")


@query("""
WITH x AS (SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey)
SELECT c_custkey, o_orderkey, o_orderkey IS NULL AS blank, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'not done' END AS state, coalesce(o_orderstatus, c_name) AS named,
       coalesce(o_orderstatus, '') <> 'F' AS differs, coalesce(o_orderstatus, '') = '' AS is_empty FROM x""")
def conditional_blank(spark, d):
    scope = scope_of({"c_name": "string", "o_orderkey": "number", "o_orderstatus": "string"})
    df = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return columns(df, scope, ["c_custkey", "o_orderkey"], blank="empty(${o_orderkey})", state="if(${o_orderstatus} = 'F', 'done', 'not done')", named="coalesce(${o_orderstatus}, ${c_name})", differs="${o_orderstatus} != 'F'", is_empty="${o_orderstatus} = ''")


@query("""
WITH p AS (SELECT c_custkey, CAST(c_custkey % 160 - 80 AS DOUBLE) AS la, CAST(c_custkey % 350 - 175 AS DOUBLE) AS lo FROM customer)
SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin((radians(10.5) - radians(la)) / 2), 2) + cos(radians(la)) * cos(radians(10.5)) * pow(sin(radians(20.25 - lo) / 2), 2)))) / 1000, 3) AS km, CAST(CAST(lo AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(la AS BIGINT) AS VARCHAR) AS short FROM p""")
def geo_distance(spark, d):
    at = F.concat_ws(" ", (F.col("c_custkey") % 160 - 80).cast("string"), (F.col("c_custkey") % 350 - 175).cast("string"), F.lit("0 5"))
    df = table(spark, d, "customer").select("c_custkey", at.alias("gps"))
    return columns(df, scope_of({"gps": "string"}), "c_custkey", km="round(distance-between(${gps}, '10.5 20.25 0 5') div 1000, 3)", short="short-geopoint(${gps})")


@query("""
WITH p AS (SELECT n_nationkey AS k, CAST(n_nationkey % 40 AS DOUBLE) AS a FROM nation)
SELECT k AS n_nationkey, round(abs(radians(1) * (2 + 2 * sin(radians(a))) - radians(1) * (2 + 2 * sin(radians(a + 1)))) * 6371008.8 * 6371008.8 / 2 / 1000000, 3) AS km2 FROM p""")
def geo_area(spark, d):
    a = (F.col("n_nationkey") % 40).cast("string")
    b = (F.col("n_nationkey") % 40 + 1).cast("string")
    ring = F.concat_ws(";", *[F.concat_ws(" ", lat, F.lit(lon)) for lat, lon in ((a, "10"), (a, "11"), (b, "11"), (b, "10"))])
    return columns(table(spark, d, "nation").withColumn("ring", ring), scope_of({"ring": "string"}), "n_nationkey", km2="round(area(${ring}) div 1000000, 3)")


_DRAW = "CAST(CAST('0x' || substr(sha256(concat_ws(chr(31), c_custkey, '{0}', '1')), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496"


@query(f"""
WITH c AS (SELECT *, sha256(concat_ws(chr(31), c_custkey, 'code', '1')) AS h FROM customer)
SELECT c_custkey, {_DRAW.format("draw")} AS draw, CASE WHEN {_DRAW.format("arm")} < 0.5 THEN 'treatment' ELSE 'control' END AS arm,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS code, sha256(c_mktsegment || chr(31) || 'x') AS seal FROM c""")
def treatment_assignment(spark, d):
    scope = scope_of({"c_mktsegment": "string"}, key=F.col("c_custkey"))
    return columns(table(spark, d, "customer"), scope, "c_custkey", draw="once(random())", arm="once(if(random() < 0.5, 'treatment', 'control'))", code="once(uuid())", seal="hash(${c_mktsegment}, 'x')")


@query("""
WITH v AS (SELECT unnest(['b', 'c', 'd', 'e']) AS v)
SELECT c_custkey, 'a ' || string_agg(v, ' ' ORDER BY sha256(concat_ws(chr(31), c_custkey, v))) || ' f' AS shown FROM customer, v GROUP BY 1""")
def randomized_choices(spark, d):
    values = F.array(*[F.lit(x) for x in "abcdef"])
    return table(spark, d, "customer").select("c_custkey", F.array_join(choices.randomized(values, F.col("c_custkey"), 1, 1), " ").alias("shown"))


# ---- exploration


def summary(name, s, tables, oracle, rounds=()):
    digits = rounds if isinstance(rounds, dict) else dict.fromkeys(rounds, 6)

    def build(spark, d):
        out = explore.compile_summary(s, table(spark, d, tables))
        return out.withColumns({c: F.round(c, n) for c, n in digits.items()}) if digits else out

    build.__name__ = name
    return query(oracle)(build)


S = explore.Summary
summary("summary_categorical", S("categorical", "o_orderpriority"), "orders", "SELECT o_orderpriority AS category, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1", ["percent"])
summary("summary_categorical_excluded", S("categorical", "event_type", exclusion='"error";"view"'), "events", "SELECT event_type AS category, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1", ["percent"])
summary("summary_numeric", S("numeric", "o_totalprice", exclusion='("0","1000");("300000","1e9")'.replace("1e9", "1000000000")), "orders", "SELECT count(*) AS n, round(avg(o_totalprice), 6) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders WHERE NOT (o_totalprice BETWEEN 0 AND 1000 OR o_totalprice BETWEEN 300000 AND 1000000000)", ["mean"])
summary("summary_numeric_bins", S("numeric", "o_totalprice", bins=10), "orders", """
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)) + 1, 10) AS INTEGER) AS bin, o_totalprice AS v FROM orders, r)
SELECT bin, count(*) AS n, min(v) AS from_value, max(v) AS to_value FROM b GROUP BY 1""")
summary("summary_temporal_week", S("temporal", "ts", options="weeks"), "events", "SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS period, count(*) AS n FROM events GROUP BY 1")
summary("summary_temporal_month", S("temporal", "o_orderdate", options="months"), "orders", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, count(*) AS n FROM orders GROUP BY 1")
summary("summary_temporal_bins", S("temporal", "ts", bins=6), "events", """
WITH r AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events) SELECT CAST(least(floor((epoch_us(ts) - lo) / (CAST(hi - lo AS DOUBLE) / 6)) + 1, 6) AS INTEGER) AS bin, count(*) AS n, CAST(min(ts) AS TIMESTAMP) AS from_time, CAST(max(ts) AS TIMESTAMP) AS to_time FROM events, r GROUP BY 1""")
summary("summary_text", S("text", "text"), "documents", "SELECT count(text) FILTER (WHERE text <> '') AS n, count(*) FILTER (WHERE coalesce(text, '') = '') AS blank, count(DISTINCT text) FILTER (WHERE text <> '') AS n_distinct, min(length(text)) FILTER (WHERE text <> '') AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 6) AS mean_length FROM documents", ["mean_length"])
summary("summary_crosstab", S("crosstab", "c_mktsegment", "c_nationkey"), "customer", 'SELECT c_mktsegment AS "row", CAST(c_nationkey AS VARCHAR) AS "column", count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS percent FROM customer GROUP BY 1, 2', ["percent"])
summary("summary_crosstab_mean", S("crosstab", "o_orderstatus", "o_totalprice", options="mean"), "orders", 'SELECT o_orderstatus AS "row", round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1', ["mean"])
summary("summary_trend", S("trend", "value", "ts", options="days"), "events", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1", ["mean"])
summary("summary_scatter", S("scatterplot", "l_quantity", "l_extendedprice"), "lineitem", "SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem")
summary("summary_scatter_fit", S("scatterplot", "l_quantity", "l_extendedprice", options="best_fit_line"), "lineitem", "SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem", {"slope": 4, "intercept": 3, "r2": 6})
summary("summary_binary", S("binary", "html"), "pages", "SELECT count(*) FILTER (WHERE html <> '') AS present, count(*) FILTER (WHERE coalesce(html, '') = '') AS missing FROM pages")


@query("SELECT CAST(c_custkey % 160 - 80 AS DOUBLE) AS lat, CAST(c_custkey % 350 - 175 AS DOUBLE) AS lon, c_acctbal AS value FROM customer")
def summary_map(spark, d):
    at = F.concat_ws(" ", (F.col("c_custkey") % 160 - 80).cast("string"), (F.col("c_custkey") % 350 - 175).cast("string"))
    return explore.compile_summary(S("map", "gps", "c_acctbal"), table(spark, d, "customer").withColumn("gps", at))


@query("""
SELECT o_orderstatus AS category, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 6) AS percent FROM orders
WHERE o_totalprice BETWEEN 10000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 10 <> 3 GROUP BY 1""")
def global_filter_exclusion(spark, d):
    orders = table(spark, d, "orders").withColumn("KEY", F.col("o_orderkey"))
    book = explore.Workbook.of_rows([{"type": "categorical", "field": "o_orderstatus"}], [{"field": "o_totalprice", "filter": '("10000","200000")'}, {"field": "o_orderpriority", "filter": '"1-URGENT";"2-HIGH"'}])
    kept = explore.without_keys(orders, orders.where("o_orderkey % 10 = 3").select("KEY"))
    return explore.compile_workbook(book, kept)["1:o_orderstatus"].withColumn("percent", F.round("percent", 6))


# ---- publishing


def _dataset(spark, d):
    return table(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("id")).distinct().select("id", F.lit("none").alias("last"), F.lit("100").alias("total"), F.lit("start").alias("log"))


def _published(name, maps, oracle, rounds=False, gate=None):
    def build(spark, d):
        events = table(spark, d, "events").withColumn("shown", F.when(F.col("value") > 10, "1").otherwise("0"))
        link = publish.Link("user_id", "id", maps, relevance_field=gate)
        out = publish.publish(events, link, _dataset(spark, d), ["event_id"])
        return out.withColumn("total", F.round(F.col("total").cast("double"), 4)) if rounds else out

    build.__name__ = name
    return query(oracle)(build)


_OLD = "WITH o AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type = 'signup'), "
_published("publish_replace", [publish.FieldMap("event_type", "last")], _OLD + """
n AS (SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS t FROM events GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, coalesce(t, CASE WHEN o.id IS NOT NULL THEN 'none' END) AS last, CASE WHEN o.id IS NOT NULL THEN '100' END AS total, CASE WHEN o.id IS NOT NULL THEN 'start' END AS log FROM o FULL JOIN n ON o.id = n.id""")
_published("publish_add", [publish.FieldMap("value", "total", publish.ADD)], _OLD + """
n AS (SELECT CAST(user_id AS VARCHAR) AS id, sum(value) AS t FROM events WHERE value > 10 GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN 'none' END AS last, round(CASE WHEN o.id IS NOT NULL THEN 100 ELSE 0 END + coalesce(t, 0), 4) AS total, CASE WHEN o.id IS NOT NULL THEN 'start' END AS log FROM o FULL JOIN n ON o.id = n.id""", True, "shown")
_published("publish_concat", [publish.FieldMap("event_type", "log", publish.CONCATENATE, "; ")], _OLD + """
n AS (SELECT CAST(user_id AS VARCHAR) AS id, string_agg(event_type, '; ' ORDER BY event_id) AS t FROM events GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN 'none' END AS last, CASE WHEN o.id IS NOT NULL THEN '100' END AS total, CASE WHEN o.id IS NOT NULL THEN 'start; ' ELSE '' END || t AS log FROM o FULL JOIN n ON o.id = n.id""")
_published("publish_concat_before", [publish.FieldMap("event_type", "log", publish.CONCATENATE, ",", "BEGINNING")], _OLD + """
n AS (SELECT CAST(user_id AS VARCHAR) AS id, string_agg(event_type, ',' ORDER BY event_id DESC) AS t FROM events GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NOT NULL THEN 'none' END AS last, CASE WHEN o.id IS NOT NULL THEN '100' END AS total, t || CASE WHEN o.id IS NOT NULL THEN ',start' ELSE '' END AS log FROM o FULL JOIN n ON o.id = n.id""")


@query(CATALOGUE["publish_add"].oracle)
def publish_stream_add(spark, d):
    """The same sums from a stream: two micro-batches, the first of them replayed."""
    folder = f"{shared_folder(spark)}/publish-{uuid.uuid4().hex[:12]}"
    events = table(spark, d, "events").select("event_id", "user_id", "value", F.when(F.col("value") > 10, "1").otherwise("0").alias("shown"))
    target = PublishedDataset(spark, f"{folder}/dataset", "id", _dataset(spark, d))
    link = publish.Link("user_id", "id", [publish.FieldMap("value", "total", publish.ADD)], relevance_field="shown")
    for part in (0, 1):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/in")
        for checkpoint in ("a", "a") if part else ("a", "b"):  # "b" knows nothing of "a": its batch 0 is a replay
            source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            publish_stream(source, link, target, ["event_id"], f"{folder}/{checkpoint}").awaitTermination()
    return target.read().withColumn("total", F.round(F.col("total").cast("double"), 4))


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)
SELECT l_orderkey, max(l_partkey) FILTER (WHERE i = 1) AS part_1, max(l_partkey) FILTER (WHERE i = 2) AS part_2, max(l_quantity) FILTER (WHERE i = 1) AS qty_1, max(l_quantity) FILTER (WHERE i = 2) AS qty_2 FROM x GROUP BY 1""")
def publish_wide(spark, d):
    rows = repeats.numbered(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return repeats.pivot_wide(rows, "l_orderkey", F.col("index"), {"part": "l_partkey", "qty": "l_quantity"}, 2)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dataset_duplicate_keys(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("k"))
    return publish.duplicate_keys(rows, "k").select("k.*", "n")


@query("SELECT c_custkey AS id, c_name AS name, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) FROM supplier")
def dataset_append(spark, d):
    return publish.append(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation")))


@query("SELECT s_suppkey, 'EN-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '-X' AS code FROM supplier")
def enumerator_ids(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", publish.enumerator_ids(F.col("s_suppkey"), "en-", "-x", 6, True).alias("code"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS value, row_number() OVER (ORDER BY CAST(n_regionkey AS DOUBLE), n_name) AS place FROM nation")
def choices_sorted(spark, d):
    number = F.col("n_regionkey").cast("string").try_cast("double")
    placed = positions.row_numbers(table(spark, d, "nation"), [number.asc_nulls_last(), F.asc("n_name")], "place")
    return placed.select(F.col("n_nationkey").cast("string").alias("value"), "place")


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def workbook_merge(spark, d):
    return lookup.merged_workbook(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "nation"), "n_nationkey", ["n_name"]).select("c_custkey", "c_name", "n_name")


@query("SELECT s_suppkey, s_suppkey < 100 AS valid FROM supplier")
def enumerator_ids_valid(spark, d):
    ids = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("E-"), F.lpad(F.col("s_suppkey").cast("string"), 2, "0"), F.when(F.col("s_suppkey") >= 100, "x").otherwise("")).alias("id"))
    return ids.select("s_suppkey", F.rlike("id", F.lit(publish.enumerator_id_pattern("E-", "", 2))).alias("valid"))


@query("SELECT p_partkey, 'size=' || p_size || ';kind=' || lower(p_type) AS parameters FROM part")
def plug_in_parameters(spark, d):
    from .sources.bundle import parameter_map

    own = parameter_map("custom-dial(size=${p_size}, kind=lower(${p_type}))", scope_of({"p_size": "number", "p_type": "string"}))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(F.map_entries(own), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("parameters"))


@query("""
WITH x AS (SELECT s_suppkey AS k, s_name AS v, 0 AS part, s_suppkey AS place FROM supplier
UNION ALL SELECT n_nationkey, n_name, 1, n_nationkey + 1 FROM nation UNION ALL SELECT 97, 'Other', 2, 1) SELECT part, CAST(place AS BIGINT) AS place, CAST(k AS VARCHAR) AS value, v AS label FROM x""")
def choices_mixed(spark, d):
    static = lambda df, k, v, n: df.select(F.col(n).cast("bigint").alias("place"), F.col(k).cast("string").alias("value"), F.col(v).alias("label"))
    last = spark.createDataFrame([(1, "97", "Other"), (2, "no number", "Never")], "place int, value string, label string")
    return choices.mixed(static(table(spark, d, "supplier"), "s_suppkey", "s_name", "s_suppkey"), static(table(spark, d, "nation").withColumn("n", F.col("n_nationkey") + 1), "n_nationkey", "n_name", "n"), static(last, "value", "label", "place"))
