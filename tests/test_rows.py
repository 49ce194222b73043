import pytest
from pyspark.sql import functions as F

from formloom.convert import xlsforms
from formloom.plans import explore, publish, rows
from formloom.rules import form_rules
from formloom.sources.sheets import sheet_frame

NESTED = [
    {"type": "text", "name": "a"},
    {"type": "begin group", "name": "g1", "relevance": "${a} = 'x'"},
    {"type": "integer", "name": "b", "constraint": ". > 0"},
    {"type": "begin repeat", "name": "r", "relevance": "${b} > 1"},
    {"type": "decimal", "name": "c", "calculation": "${b} * 2 + ${ a }"},
    {"type": "end repeat", "name": "r"},
    {"type": "calculate", "name": "d", "calculation": "sum(${c}) + ${e}"},
    {"type": "end group", "name": "g1"},
    {"type": "calculate", "name": "e", "calculation": "${d} + ${missing}", "relevance": "selected(${a}, 'y')"},
    {"type": "select_one yn", "name": "f", "choice_filter": "k = ${a}"},
    {"type": "select_multiple gone", "name": "a", "label": "twice **bold**"},
    {"type": "text", "name": "2nd", "label": "not safe"},
]


@pytest.fixture(scope="module")
def sheet(spark):
    return sheet_frame(spark, [r | {"excel_row": k + 2} for k, r in enumerate(NESTED)]).persist()


def test_row_kinds(sheet):
    assert rows.row_kind(sheet, "all").count() == 12 and rows.row_kind(sheet, "fields").count() == 8
    assert {(r["name"], r["group_end_excel_row"]) for r in rows.row_kind(sheet, "groups").collect()} == {("g1", 9), ("r", 7)}
    assert rows.get_row(sheet, 3).first()["group_end_excel_row"] == 9 and rows.get_row(sheet, 2).first()["group_end_excel_row"] is None


def test_expansions(spark, sheet):
    choices = sheet_frame(spark, [{"list_name": "yn", "value": "y"}, {"list_name": "yn", "value": "n"}, {"list_name": "other", "value": "z"}])
    assert [r["value"] for r in rows.expand_choices(sheet, choices).orderBy("choice_row").collect()] == ["y", "n"]
    edges = {(r["source"], r["target"]) for r in rows.group_edges(sheet).collect()}
    assert ("b", "a") in edges and ("c", "b") in edges and ("c", "a") in edges and ("e", "a") not in edges
    by = rows.closure(rows.refs(sheet), sheet.where("name = 'd'").select("name"), row_limit=2)
    assert by.count() == 2 and by.agg(F.max("depth")).first()[0] == 1


def test_summary(spark, sheet):
    s = rows.form_summary(sheet, sheet_frame(spark, [{"list_name": "yn", "value": "y"}])).first()
    assert (s["n_fields"], s["n_groups"], s["n_repeats"], s["next_survey_row"], s["n_choices"], s["n_lists"], s["next_choice_row"]) == (8, 1, 1, 14, 1, 1, 3)
    assert rows.non_empty_columns(sheet.withColumn("blank", F.lit(""))) == sheet.columns


def test_virtual_columns(spark):
    s = rows.with_virtual(sheet_frame(spark, [{"name": "a", "label": "One", "label:fr": "UN", "hint": "H"}])).first()
    assert s["labels_concat_lower"] == "one un" and s["hints_concat_lower"] == "h"
    page = rows.query(sheet_frame(spark, [{"name": "a"}]), columns=["name", "nowhere"]).first()
    assert page["nowhere"] is None and not page["more_results"]


def test_balance_rule(spark):
    bad = sheet_frame(spark, [{"type": "begin group", "name": "g"}, {"type": "text", "name": "a"}, {"type": "end repeat", "name": "g"}, {"type": "end group", "name": "x"}])
    got = [r["message"] for r in form_rules.balanced(bad).collect()]
    assert "1 begin and 2 end markers" in got and "ends another block than begins in row 2" in got
    assert form_rules.report(form_rules.balanced(bad)).first()["n"] == 2
    used = form_rules.bundles_exist(sheet_frame(spark, [{"appearance": "custom-dial(x=1)"}, {"appearance": "custom-map"}]), spark.createDataFrame([("map",)], "bundle string"))
    assert [r["message"] for r in used.collect()] == ["no bundle: dial"]


def test_outgoing(spark, tmp_path):
    publish.outgoing(spark.createDataFrame([("1", "x"), ("2", None)], "id string, v string"), str(tmp_path / "o"), ["v", "id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == ["v", "id"]


def test_explored_kinds(spark):
    df = spark.createDataFrame([("1 2", "2024-01-01", "a", 1.0, "x"), ("bad", "2024-01-09", "b", 2.0, ""), (None, "never", "a", 4.0, None)], "p string, t string, c string, v double, f string")
    run = lambda **k: explore.compile_summary(explore.Summary(**k), df)
    assert run(type="geomap", field="p").count() == 1 and run(type="map", field="p", field_2="v").first()["value"] == 1.0
    assert tuple(run(type="binary", field="f").first()) == (1, 2) and run(type="temporal", field="t", options="days").count() == 2 and run(type="temporal", field="t", bins=2).agg(F.sum("n")).first()[0] == 2
    assert {r["row"]: r["max"] for r in run(type="crosstab", field="c", field_2="v", options="max").collect()} == {"a": 4.0, "b": 2.0}
    assert run(type="crosstab", field="v", field_2="c", bins=2).agg(F.sum("n")).first()[0] == 3
    assert run(type="trend", field="v", field_2="t", options="weeks").count() == 2
    book = explore.Workbook.of_rows([{"type": "text", "field": "f"}], [], [{"field": "c", "exclusion": '"b"'}])
    assert explore.compile_workbook(book, df)["1:f"].first()["n"] == 1


def test_entities():
    survey = [{"type": "text", "name": "tree kind", "save_to": "kind"}, {"type": "text", "name": "other"}]
    out = xlsforms.convert(survey, [], {"form_id": "f"})
    made = xlsforms.entities([{"list_name": "trees", "create_if": "${other} = 'y'"}, {}], survey, out, "f")
    assert [d.id for d in made] == ["trees"] and made[0].columns == ["id", "kind"] and not made[0].problems()
    link = made[0].publish_links()[0]
    assert link.fields[0].form_field == "tree_kind" and link.relevance_field == "publish_trees" and link.joining_field == "trees_id"
    added = {r["name"]: r["calculation"] for r in out.survey if r["type"] == "calculate"}
    assert added == {"trees_id": "once(uuid())", "publish_trees": "if(${other} = 'y', 1, 0)"}
    assert xlsforms.language_name("English (en)") == "English"
