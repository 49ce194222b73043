import pytest
from pyspark.sql import functions as F

from formloom.expressions.compiler import compile_expr, scope_of
from formloom.expressions.syntax import ExpressionError
from formloom.operators import choices, form, lookup, repeats
from formloom.plans import explore, patches, publish, rows, sessions
from formloom.sources.sheets import sheet_frame


def test_nested_equals_exploded(spark):
    df = spark.sql("select k, collect_list(named_struct('v', v)) m from (select id % 5 k, cast((id * 37) % 11 as double) v from range(40)) group by k").union(spark.sql("select 99L, cast(array() as array<struct<v:double>>)"))
    scope = scope_of({"k": "number"}, {"m": {"v": "number"}})
    nested = df.select("k", compile_expr("sum-if(${v}, ${v} > 3)", scope).col.alias("s"), compile_expr("count-if(${m}, ${v} > 3)", scope).col.alias("n"), compile_expr("max(${v})", scope).col.alias("x"))
    long = repeats.long_form(df, "k", "m").groupBy("k").agg(F.coalesce(F.sum(F.when(F.col("v") > 3, F.col("v"))), F.lit(0.0)).alias("s"), F.count_if(F.col("v") > 3).cast("double").alias("n"), F.max("v").alias("x"))
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, long.collect()))


def test_wide_inverts_long(spark):
    df = spark.sql("select 1 k, array(named_struct('v', 'a'), named_struct('v', 'b')) m")
    wide = repeats.wide_form(df, "m", "v", 3)
    back = wide.unpivot("k", ["v_1", "v_2", "v_3"], "i", "v").where("v is not null")
    assert [r["v"] for r in back.orderBy("i").collect()] == ["a", "b"]


def test_counted(spark):
    df = spark.sql("select array(named_struct('v', 1), named_struct('v', 2), named_struct('v', 3)) m")
    sizes = df.select(*[F.size(repeats.counted(F.col("m"), F.lit(n))).alias(f"n{n}") for n in (0, 2, 5)]).first()
    assert tuple(sizes) == (0, 2, 5)


def test_randomized(spark):
    df = spark.range(20).select("id", choices.randomized(F.array(*[F.lit(x) for x in "abcdef"]), F.col("id"), 1, 2).alias("v"))
    for r in df.collect():
        assert r["v"][0] == "a" and r["v"][-2:] == ["e", "f"] and sorted(r["v"]) == list("abcdef")
    assert len({tuple(r["v"]) for r in df.collect()}) > 3
    assert choices.randomized_by("minimal randomized(1,2)") == (1, 2, False) and choices.randomized_by("randomized(${s}, 1, 0)") == (1, 0, True) and choices.randomized_by("minimal") is None


def test_pulldata_takes_the_first_row_and_blank_keys_match_nothing(spark):
    src = spark.createDataFrame([(2, "k", "second"), (1, "k", "first"), (3, None, "none"), (4, "", "blank")], "n int, key string, v string")
    df = spark.createDataFrame([("k",), (None,), ("q",)], "f string")
    e = "pulldata('s', 'v', 'key', ${f})"
    out, scope = lookup.Pulled({"s": src}, {"s": ["n"]}).join(df, [e], scope_of({"f": "string"}))
    assert sorted((r["f"] or "", r["x"]) for r in out.select("f", compile_expr(e, scope).col.alias("x")).collect()) == [("", None), ("k", "first"), ("q", None)]


def test_lookups_share_a_join(spark):
    src = spark.createDataFrame([("k", "1", "2")], "key string, a string, b string")
    e = ["pulldata('s', 'a', 'key', ${f})", "concat(pulldata('s', 'b', 'key', ${f}), '!')"]
    out, _ = lookup.Pulled({"s": src}).join(spark.createDataFrame([("k",)], "f string"), e, scope_of({"f": "string"}))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_evaluation_order_and_cycles(spark):
    f = form.Form([{"type": "calculate", "name": "c", "calculation": "${b} + 1"}, {"type": "calculate", "name": "b", "calculation": "${a} * 2"}, {"type": "integer", "name": "a", "default": "4"}])
    assert form.evaluate(f, spark.createDataFrame([(None,), (10.0,)], "a double")).orderBy("c").select("c").collect()[0][0] == 9.0
    loop = form.Form([{"type": "calculate", "name": "x", "calculation": "${y}"}, {"type": "calculate", "name": "y", "calculation": "${x}"}])
    with pytest.raises(ExpressionError, match="depend on each other"):
        form.evaluate(loop, spark.range(1))
    with pytest.raises(ValueError):
        form.Form([{"type": "begin group", "name": "g"}])


def test_once_keeps_what_is_stored(spark):
    f = form.Form([{"type": "calculate", "name": "r", "calculation": "once(random())"}])
    df = spark.createDataFrame([("k", "0.25"), ("j", None)], "key string, r string")
    out = {r["key"]: r["r"] for r in form.evaluate(f, df, f.scope(key=F.col("key"))).collect()}
    assert out["k"] == 0.25 and 0 <= out["j"] < 1



def test_exclusions_keep_blanks(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (None,)], "v double")
    assert df.where(~explore.condition(F.col("v"), '("0","0")')).count() == 2
    assert df.where(explore.condition(F.col("v"), '("1","")')).count() == 1
    assert explore.compile_summary(explore.Summary("numeric", "v", bins=4), df).agg(F.sum("n")).first()[0] == 2
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert explore.compile_summary(explore.Summary("numeric", "v", bins=4), same).select("bin", "n").collect() == [(1, 2)]


def test_workbook_groups():
    ok = [{"type": "begin group", "label": "A"}, {"type": "numeric", "field": "v", "bins": "5"}, {"type": "end group", "label": "A"}]
    assert explore.Workbook.of_rows(ok).summaries[0].section == "A"
    for bad in (ok[:2], [*ok[:2], {"type": "end group", "label": "B"}], [{"type": "pie", "field": "v"}]):
        with pytest.raises(ValueError):
            explore.Workbook.of_rows(bad)


def test_filter_algebra(spark):
    sheet = sheet_frame(spark, [{"name": n, "label": lab} for n, lab in (("a", "One"), ("b", None), ("c", "three"))])
    count = lambda t: sheet.where(rows.compile_filter(t, sheet.columns)).count()
    p = {"regex": ["label", "(?i)one"]}
    assert count({"not": {"not": p}}) == count(p) == 1 and count({"or": [p, {"not": p}]}) == 3 and count({"has": ["label"]}) == 2 and count({"eq": ["nothing", ""]}) == 3
    assert count({"between": ["excel_row", 2, 4, "exclusive"]}) == 1 and count({"between": ["name", "a", "b", "inclusive"]}) == 2
    assert rows.query(sheet, {"fulltext": ["three"]}).count() == 1
    with pytest.raises(ValueError):
        rows.query(sheet, limit=101)


def test_paging(spark):
    sheet = sheet_frame(spark, [{"name": f"n{k:03}"} for k in range(150)])
    a, b = rows.query(sheet, limit=100).collect(), rows.query(sheet, start=100, limit=100).collect()
    assert len(a) == 100 and a[0]["more_results"] and len(b) == 50 and not b[0]["more_results"] and a[-1]["name"] < b[0]["name"]


def test_patches_are_atomic_and_versioned(spark):
    sheets = patches.Sheets(sheet_frame(spark, [{"type": "text", "name": "a", "label:xx": "A"}, {"type": "select_one l", "name": "b", "relevance": "${a} = 1"}]), sheet_frame(spark, [{"list_name": "l", "value": "1", "label:xx": "x"}]), {"form_id": "f", "default_language": "xx"})
    with pytest.raises(patches.InvalidForm):
        patches.apply(sheets, [{"op": "edit_row", "sheet": "survey", "excel_row": 2, "values": {"name": "z"}}, {"op": "delete_row", "sheet": "survey", "excel_row": 77}])
    assert [r["name"] for r in sheets.survey.collect()] == ["a", "b"]
    with pytest.raises(patches.SessionConflict) as err:
        patches.apply(sheets, [], expected_version=5)
    assert err.value.envelope["error"]["code"] == "session_conflict"
    same, report = patches.apply(sheets, [{"op": "edit_row", "sheet": "survey", "excel_row": 2, "values": {"odd": "1"}}], validate_only=True)
    assert same is sheets and report.warnings == ["unknown_column_added: odd"] and report.counts["columns_added"] == 1
    new, _ = patches.apply(sheets, [
        {"op": "rename", "kind": "list", "old_list_name": "l", "new_list_name": "m"}, {"op": "rename", "kind": "language", "old_language": "xx", "new_language": ""}, {"op": "change_setting", "form_id": "g"},
        {"op": "rename", "kind": "column", "sheet": "survey", "old_header": "relevance", "new_header": "when"},
    ])
    assert new.version == 2 and new.settings["form_id"] == "g" and "label" in new.survey.columns and "when" in new.survey.columns
    assert new.survey.where("type = 'select_one m'").count() == 1 and new.choices.first()["list_name"] == "m"
    for bad in ({"op": "add_column"}, {"op": "move_row"}, {"op": "change_setting", "version": "9"}, {"op": "edit_row", "sheet": "settings"}):
        with pytest.raises(patches.InvalidForm):
            patches.apply(sheets, [bad])


def test_sessions(spark, tmp_path):
    now = [0.0]
    s = sessions.Sessions(clock=lambda: now[0])
    key = s.start(patches.Sheets(sheet_frame(spark, [{"name": "a"}]), sheet_frame(spark, [{"list_name": "l"}]), {}))
    assert s.patch(key, [{"op": "add_row", "sheet": "survey", "values": {"name": "b"}}], 1)[0] == 2
    assert s.current(key).survey.count() == 2 and s.current(key, 1).survey.count() == 1
    s.export(key, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/survey").count() == 2
    now[0] = 25 * 3600
    with pytest.raises(patches.SessionNotFound):
        s.current(key)
    s.end(key)
    s.end(key)
    assert "sum-if" in sessions.capabilities()["functions"]


def test_closure_survives_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {(r["node"], r["depth"]) for r in rows.closure(edges, spark.createDataFrame([("a",)], "name string")).collect()}
    assert got == {("b", 1), ("c", 2), ("d", 3)}
    edges.createOrReplaceTempView("e")
    spark.createDataFrame([("a",)], "name string").createOrReplaceTempView("s")
    assert {(r["node"], r["depth"]) for r in spark.sql(rows.closure_sql("e", "s", 3)).collect()} == {("a", 3), ("b", 1), ("c", 2), ("d", 3)}


def test_publish_updates(spark):
    data = spark.createDataFrame([("1", "old", "5", "x")], "id string, a string, n string, log string")
    subs = spark.createDataFrame([(2, "1", None, 2.5, "q", "1"), (1, "1", "mid", 1.0, "p", "1"), (3, "2", "new", None, None, "1"), (4, "2", "hidden", 9.0, "h", "0")], "o int, k string, a string, n double, log string, show string")
    link = publish.Link("k", "id", [publish.FieldMap("a", "a"), publish.FieldMap("n", "n", publish.ADD), publish.FieldMap("log", "log", publish.CONCATENATE, "-")], "show")
    out = {r["id"]: (r["a"], r["n"], r["log"]) for r in publish.publish(subs, link, data, ["o"]).collect()}
    assert out == {"1": ("mid", "8.5", "x-p-q"), "2": ("new", None, None)}
    assert publish.publish(subs, publish.Link("k", "id", enabled=False), data, ["o"]) is data
    assert publish.missing_fields(link, ["a", "n"]) == ["log"]
    assert [m.column for m in publish.starred(publish.Link("k", "id", [publish.FieldMap("f*", "c*")]), 2).fields] == ["c1", "c2"]


def test_streaming_publish_counts_once(spark, tmp_path):
    from formloom.plans.published import PublishedDataset
    from formloom.streaming.publisher import publish_stream

    schema = "o int, k string, n double"
    initial = spark.createDataFrame([("1", "0")], "id string, n string")
    target = PublishedDataset(spark, str(tmp_path / "data"), "id", initial)
    link = publish.Link("k", "id", [publish.FieldMap("n", "n", publish.ADD)])
    for k, batch in enumerate(([(1, "1", 2.0), (2, "2", 3.0)], [(3, "1", 5.0)])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = publish_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), link, target, ["o"], str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert {r["id"]: r["n"] for r in target.read().collect()} == {"1": "7", "2": "3"}
    before = target.versions()
    assert target.commit().seen == {"stream": 1}
    q = publish_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), link, target, ["o"], str(tmp_path / "ck2"))  # all replayed
    q.awaitTermination(60)
    assert target.versions() == before and {r["id"]: r["n"] for r in target.read().collect()} == {"1": "7", "2": "3"}


def test_first_row_of_a_key_is_that_of_the_first_file(spark, tmp_path):
    """Whatever tasks the files go to: Spark deals large files first."""
    lines = ["id,name", *(f"x{k},{'y' * 50}" for k in range(500))]
    (tmp_path / "a.csv").write_text("id,name\nk,first\nk,second\n")
    (tmp_path / "b.csv").write_text("\n".join([*lines, "k,third"]) + "\n")
    source = spark.read.option("header", True).csv(str(tmp_path))
    assert {r["__key"]: r["name"] for r in lookup.first_by_key(source, "id", ["name"]).where("__key = 'k'").collect()} == {"k": "first"}
    assert lookup.first_by_key(source, "id", ["name"], ["name"]).where("__key = 'k'").first()["name"] == "first"
    made = spark.createDataFrame([("k", "a"), ("k", "b"), (None, "c")], "id string, name string").coalesce(1)
    assert [tuple(r) for r in lookup.first_by_key(made, "id", ["name"]).collect()] == [("k", "a")]


def test_long_aggregates_equal_nested(spark):
    from formloom.operators import repeat_plans

    parents = spark.createDataFrame([(k, float(k), f"p{k}") for k in range(6)], "k int, limit double, name string")
    lines = spark.createDataFrame([(j % 5, j, float(j * 37 % 11) if j % 7 else None, f"t{j}") for j in range(40)], "p int, o int, v double, t string")
    members = {"v": "number", "t": "string"}
    e = {"a": "sum-if(${v}, ${v} > ${limit})", "b": "count(${m}) + count-if(${m}, ${v} > 3)", "c": "max(${v})", "d": "min-if(${t}, ${v} > 2)", "e": "join-if('|', ${t}, ${v} > 5)", "f": "concat(${name}, string(sum(${v})))", "g": "max(${limit}, 2)", "h": "indexed-repeat(${t}, ${m}, 3)", "i": "indexed-repeat(${v}, ${m}, 99)", "j": "rank-index(2, ${v})", "k2": "rank-index-if(1, ${v}, ${v} > ${limit})", "l": "sum-if(${v}, index() > 2)"}
    kinds = {"k": "number", "limit": "number", "name": "string"}
    long = repeat_plans.aggregate(parents, lines, "k", "p", "m", members, scope_of(kinds, {"m": members}), e, ["o"])
    nested = repeats.nest(parents, lines, "k", "p", ["o"], {m: m for m in members}, "m")
    scope = scope_of(kinds, {"m": members})
    want = nested.select("k", *[compile_expr(t, scope).col.alias(n) for n, t in e.items()])
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ExpressionError):
        repeat_plans.aggregate(parents, lines, "k", "p", "m", members, scope, {"x": "rank-index(${k}, ${v})"}, ["o"])


def test_labels_show_groups_and_instances(spark):
    f = form.Form([{"type": "text", "name": "a"}, {"type": "begin repeat", "name": "r"}, {"type": "integer", "name": "n"}, {"type": "end repeat"}])
    df = spark.sql("select 'x' a, array(named_struct('n', 1D), named_struct('n', 2.5D)) r")
    assert df.select(form.interpolate("${a}: ${n} in ${g}", f.scope(), {"g": "Group"})).first()[0] == "x: 1, 2.5 in Group"
    asked = form.Form([{"type": "calculate", "name": "when", "calculation": "now()"}])
    assert form.evaluate(asked, spark.range(1)).schema["when"].dataType.simpleString() == "date"


def test_search_in_appearances():
    from formloom.expressions.syntax import Literal, Ref

    args = lookup.parse_search("minimal search('src', 'contains', 'a,b', ${x}, 'col', concat('(', ${f}))")
    assert args[0] == Literal("src") and args[3] == Ref("x") and len(args) == 6 and lookup.parse_search("minimal") is None


def test_plug_in_contracts(spark):
    from formloom.sources import bundle

    df = spark.createDataFrame([("12", "a b"), ("1.5", "a  b"), (None, "")], "i string, m string")
    assert [tuple(r) for r in df.select(bundle.answers_valid(F.col("i"), "integer"), bundle.answers_valid(F.col("m"), "select_multiple")).collect()] == [(True, True), (False, False), (True, True)]
    f = form.Form([{"type": "select_one l", "name": "q", "label": "Q", "appearance": "custom-x(k=1)"}], [{"list_name": "l", "value": "1", "label": "One"}])
    p = bundle.field_properties(f, "q")
    assert p["CHOICES"][0]["CHOICE_LABEL"] == "One" and p["PARAMETERS"] == {"k": "1"}


def test_publishing_limits(spark):
    f = form.Form([{"type": "text", "name": "a", "publishable": "yes"}, {"type": "text", "name": "b"}])
    assert publish.publishable(f, True) == ["a"] and publish.publishable(f, False) == ["a", "b"]
    data = spark.createDataFrame([("1", "2")], "a string, b string")
    assert publish.case_columns(data, {"displayMode": "table", "showColumnsWhenTable": ["b"]}).columns == ["b"] and publish.case_columns(data, {"displayMode": "tree"}).columns == ["a", "b"]


def test_repeats_are_evaluated(spark):
    f = form.Form([
        {"type": "integer", "name": "n"}, {"type": "begin group", "name": "g", "relevance": "${n} > 0"}, {"type": "begin repeat", "name": "r", "repeat_count": "${n}"}, {"type": "integer", "name": "a", "default": "7"},
        {"type": "begin group", "name": "inner", "relevance": "${a} < 7"}, {"type": "calculate", "name": "b", "calculation": "${a} * index() + ${n}"}, {"type": "end group"}, {"type": "text", "name": "c", "required": "yes", "relevance": "${b} > 3"}, {"type": "end repeat"}, {"type": "end group"}, {"type": "calculate", "name": "s", "calculation": "sum(${b})"},
    ])
    df = spark.sql("select 2D n, array(named_struct('a', 1D, 'c', 'x'), named_struct('a', 2D, 'c', ''), named_struct('a', 3D, 'c', 'x')) r union all select 3D, array(named_struct('a', cast(null as double), 'c', 'y')) union all select 0D, array(named_struct('a', 1D, 'c', 'z'))")
    scope = f.scope()
    out = form.evaluate(f, df, scope)
    got = {r["n"]: ([(x["a"], x["b"], x["c"]) for x in r["r"]], r["s"]) for r in out.collect()}
    assert got == {2.0: ([(1.0, 3.0, None), (2.0, 6.0, "")], 9.0), 3.0: ([(7.0, None, None)] * 3, 0.0), 0.0: ([], 0.0)}
    assert [(r["n"], r["field"], r["rule"], r["index"]) for r in form.violations(f, out, "n", scope).collect()] == [(2.0, "c", "required", 2)]


@pytest.mark.parametrize("kind", ["contains", "startswith", "endswith", "matches"])
def test_search_each_against_all_pairs(spark, kind):
    import random

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    asked = [(k, word(rng.randint(0, 5))) for k in range(60)] + [(60, None)]
    cells = [(k, word(rng.randint(0, 7)) or None, word(rng.randint(1, 4))) for k in range(80)]
    got = lookup.search_each(spark.createDataFrame(asked, "key int, t string"), spark.createDataFrame(cells, "id int, a string, b string"), "key", kind, "a,b", F.col("t"), "id")
    test = {"contains": str.__contains__, "startswith": str.startswith, "endswith": str.endswith, "matches": str.__eq__}[kind]
    empty = (lambda c: c) if kind == "matches" else (lambda c: c or "")
    want = {(k, str(i)) for k, t in asked if t is not None for i, *cs in cells if any(empty(c) is not None and test(empty(c), t) for c in cs)}
    assert {(r["key"], r["value"]) for r in got.collect()} == want


@pytest.mark.parametrize(("tracked", "k"), [(10_000, 5), (8, 3), (8, 40)])
def test_top_values(spark, tracked, k):
    """Certain from the summary, from all values seen, and from full counts where the summary cannot tell."""
    import collections
    import random

    from formloom.plans.frequent import top_values

    rng = random.Random(k)
    values = [rng.choice(["hot", "hot", "warm", "", None, f"v{rng.randrange(300)}"]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    got = [(r.value, r.n) for r in top_values(df, F.col("v"), k, tracked).collect()]
    n = collections.Counter(v for v in values if v)
    assert got == sorted(n.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert top_values(df.limit(0), F.col("v"), k, tracked).collect() == []


def test_crosstab_totals_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 2.0), (None, 2.0), ("b", None)], "x string, y double")
    s = explore.Summary("crosstab", "x", "y", options="totals,mean,max")
    got = {(r.row, r.column): r for r in explore.compile_summary(s, df).collect()}
    assert len(got) == 3 + 2 + 2 + 1 and got["a", None].level == "row" and got[None, "2.0"].level == "column" and got[None, None].level == "all"
    assert (got[None, None].n, got[None, None].percent_all, got[None, None].percent_row) == (4, 100.0, None)
    cell = got["a", "1.0"]
    assert (cell.n, round(cell.percent_row, 3), cell.percent_column, cell.percent_all) == (2, 66.667, 100.0, 50.0)
    assert (got["a", None].max, got[None, None].mean) == (2.0, 1.5)


def test_long_rows_equal_the_exploded_arrays(spark):
    """One submission with most of the rows, one with none, and instances of no submission."""
    parents = spark.createDataFrame([(k,) for k in range(5)], "k int")
    lines = spark.createDataFrame([(1 if j % 4 else j % 7, j % 5, j, f"t{j}") for j in range(200) if j % 7 != 3], "p int, o int, j int, t string").repartition(6)
    nested = repeats.nest(parents, lines, "k", "p", ["o", "j"], {"t": "t"}, "rows")
    want = sorted(map(tuple, repeats.long_form(nested, "k", "rows").collect()), key=str)
    got = sorted(map(tuple, repeats.long_rows(parents, lines, "k", "p", ["o", "j"], {"t": "t"}).collect()), key=str)
    assert got == want and (3, None, None) in got
