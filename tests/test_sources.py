import json

import pytest

from formloom.convert import common, qsf as convert_qsf, xforms as convert_xforms, xlsforms
from formloom.operators.form import Form
from formloom.plans.patches import InvalidForm
from formloom.rules import form_rules, translation_rules
from formloom.sources import bundle, dataset_xml, qsf, sheets, xforms

XFORM = """<h:html xmlns:h="http://www.w3.org/1999/xhtml" xmlns="http://www.w3.org/2002/xforms" xmlns:jr="http://openrosa.org/javarosa"><h:head><h:title>Visit</h:title><model>
<instance><data id="visit_1"><a/><g><a/></g></data></instance><instance id="casedb" src="jr://instance/casedb"/>
<itext><translation lang="en" default=""><text id="a"><value>Age of <output value="/data/name"/></value><value form="image">jr://file/x.png</value></text><text id="m"><value>too old</value></text></translation>
<translation lang="fr"><text id="a"><value form="long">Âge</value></text></translation></itext>
<bind nodeset="/data/a" type="xsd:int" required="true()" constraint=". &lt; 120 and . != /data/g/a" jr:constraintMsg="jr:itext('m')"/><bind id="k" nodeset="/data/kind" relevant="/data/a == 3"/>
<bind nodeset="/data/start" jr:preload="timestamp" jr:preloadParams="start"/><bind nodeset="/data/twice" calculate="/data/a * 2"/></model></h:head><h:body>
<input ref="/data/a"><label ref="jr:itext('a')"/></input><select1 bind="k"><label>Kind</label><item><label>Yes</label><value>y</value></item><item><label>No</label><value>n</value></item></select1>
<group ref="/data/g"><label>G</label><repeat nodeset="/data/g/r" jr:count="/data/a" jr:noAddRemove="true()"><input ref="/data/g/a"><label>Again</label></input></repeat></group>
<range ref="/data/pain" start="0" end="10" step="1"><label>Pain</label></range><input><label>lost</label></input></h:body></h:html>"""


def test_xforms(spark):
    f = xforms.parse(spark, XFORM)
    assert (f.title, f.form_id, f.languages) == ("Visit", "visit_1", ["en", "fr"])
    assert [q["type"] for q in f.questions] == ["input", "select1", "begin_group", "begin_repeat", "input", "end_repeat", "end_group", "range"]
    age = f.questions[0]
    assert age["labels"] == {"en": "Age of ${name}", "fr": "Âge"} and age["required"] and age["constraint_message"] == {"en": "too old"} and age["media"] == {"image": {"en": "jr://file/x.png"}}
    assert age["suggested_safe_name"] == "a" and f.questions[4]["suggested_safe_name"] == "g_r_a" and f.questions[3]["repeat_count"] == "/data/a" and f.questions[3]["no_add_remove"]
    assert [h["name"] for h in f.hidden] == ["start", "twice"] and len(f.warnings) == 3
    for bad in ("<h/>", XFORM.replace("<model>", "<m>").replace("</model>", "</m>")):
        with pytest.raises(ValueError):
            xforms.parse(spark, bad)


def test_xforms_by_spark(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XFORM)
    (tmp_path / "b.xml").write_text("no xml")
    got = xforms.read_xforms(spark, str(tmp_path))
    forms = {r["path"].rpartition("/")[2]: r for r in got.forms.collect()}
    assert forms["a.xml"]["title"] == "Visit" and not forms["a.xml"]["error"] and forms["b.xml"]["error"]
    assert got.questions.where("seq = 0").first()["labels"]["fr"] == "Âge" and got.questions.count() == 10


def test_xforms_conversion(spark):
    out = convert_xforms.convert(xforms.parse(spark, XFORM), language_names={"en": "English", "fr": "French"})
    rows = {r["name"]: r for r in out.survey if not r["type"].startswith("end")}
    assert rows["start"]["type"] == "start" and rows["twice"] == {"name": "twice", "type": "calculate", "calculation": "${a} * 2"}
    assert rows["a"]["label"] == "Age of ${name}" and rows["a"]["label:French"] == "Âge" and rows["a"]["constraint"] == ". < 120 and . != ${g_r_a}" and rows["a"]["media:image"] == "x.png"
    assert rows["kind"]["relevance"] == "${a} = 3" and rows["pain"]["constraint"] == ". >= 0 and . <= 10" and rows["pain"]["type"] == "integer" and rows["r"]["repeat_count"] == "${a}"
    assert [c["value"] for c in out.choices] == ["y", "n"] and out.settings["default_language"] == "English"
    assert out.form().repeats == {"r": None}


def survey(questions, blocks, flow=None):
    elements = [{"Element": "SQ", "PrimaryAttribute": q["QuestionID"], "Payload": q} for q in questions] + [{"Element": "BL", "Payload": blocks}]
    elements.append({"Element": "FL", "Payload": {"Flow": flow or [{"Type": "Block", "ID": b["ID"]} for b in blocks]}})
    return json.dumps({"SurveyEntry": {"SurveyName": "S"}, "SurveyElements": elements})


def q(k, kind, selector, **more):
    return {"QuestionID": f"QID{k}", "DataExportTag": f"Q{k}", "QuestionText": f"Text {k}", "QuestionType": kind, "Selector": selector, **more}


def choices(*names):
    return {"Choices": {str(k): {"Display": n} for k, n in enumerate(names, 1)}, "ChoiceOrder": [str(k) for k in range(1, len(names) + 1)]}


def test_qsf():
    leaf = lambda k, op, right=None, choice=1: {"LeftOperand": f"q://QID{k}/SelectableChoice/{choice}", "Operator": op, "RightOperand": right, "Type": "Expression"}
    questions = [
        q(1, "MC", "SAVR", **choices("Yes", "No", "Other"), RecodeValues={"1": "10", "2": "20", "3": "30"}, Validation={"Settings": {"ForceResponse": "ON"}}), q(2, "MC", "MAVR", **choices("A", "B")),
        q(3, "TE", "SL", Validation={"Settings": {"ForceResponse": "OFF", "ForceResponseType": "ON", "Type": "ValidEmail"}}, DisplayLogic={"0": {"0": leaf(1, "Selected"), "1": leaf(2, "Selected") | {"Conjuction": "Or"}, "Type": "If"}, "Type": "BooleanExpression"}),
        q(4, "Matrix", "Likert", SubSelector="SingleAnswer", **choices("Price", "Place"), ChoiceDataExportTags={"1": "price", "2": "place"}, Answers={"1": {"Display": "Bad"}, "2": {"Display": "Good"}}, AnswerOrder=["1", "2"]),
        q(5, "CS", "HR", **choices("Food", "Rent")), q(6, "Slider", "HSLIDER", Configuration={"CSSliderMin": 1, "CSSliderMax": 5, "NumDecimals": "1"}), q(7, "Timing", "PageTimer"), q(8, "Unheard", "Of"), q(9, "TE", "FORM", **choices("Street", "City")),
    ]
    questions[0]["Choices"]["3"]["TextEntry"] = "true"
    element = lambda k, **more: {"Type": "Question", "QuestionID": f"QID{k}", **more}
    skip = [{"Locator": "q://QID1/SelectableChoice/2", "Condition": "Selected", "SkipToDestination": "QID4"}]
    blocks = [{"ID": "B1", "Description": "First", "BlockElements": [element(1, SkipLogic=skip), element(2), {"Type": "Page Break"}, element(3), element(4)]}, {"ID": "B2", "Description": "Second", "BlockElements": [element(k) for k in range(5, 10)]}]
    flow = [{"Type": "EmbeddedData", "EmbeddedData": [{"Field": "panel", "Value": "p1"}, {"Field": "outside"}]}, {"Type": "Block", "ID": "B1"}, {"Type": "Branch", "BranchLogic": {"0": {"0": leaf(1, "NotSelected"), "Type": "If"}}, "Flow": [{"Type": "Block", "ID": "B2"}]}]
    parsed = qsf.parse(survey(questions, blocks, flow))
    assert parsed.order() == [f"QID{k}" for k in range(1, 10)]
    out = convert_qsf.convert(parsed)
    rows = {r["name"]: r for r in out.survey if not r["type"].startswith("end")}
    assert rows["panel"]["calculation"] == "'p1'" and rows["Q1"]["required"] == "yes" and rows["Q1_other"]["relevance"] == "selected(${Q1}, '30')"
    assert rows["Q2"]["relevance"] == "not(${Q1} = '20')" and rows["Q3"]["relevance"] == "(${Q1} = '10' or selected(${Q2}, '1')) and (not(${Q1} = '20'))" and "required" not in rows["Q3"] and rows["Q3"]["constraint"] == common.EMAIL
    assert rows["Q4_price"]["type"] == "select_one Q4" and rows["Q5_total"]["calculation"] == "${Q5_row1} + ${Q5_row2}" and rows["Q5_total"]["constraint"] == ". = 100"
    assert rows["Q6"]["type"] == "decimal" and rows["Q6"]["constraint"] == ". >= 1 and . <= 5" and "Q7" not in rows and rows["Q8"]["type"] == "note" and rows["Q9_city"]["label"] == "City"
    assert rows["second_2"]["relevance"] == "not(selected(${Q1}, '10'))" and rows["first_1_page_2"]["appearance"] == "field-list"
    assert {r[0]: r[1] for r in out.report if r[1] in ("dropped", "lossy")} == {"survey": "lossy", "Q7": "dropped", "Q8": "lossy"}
    out.form()
    text = common.report_markdown(out, "Report")
    assert "## Summary" in text and "`Q8` (lossy)" in text and "## Survey-level issues" in text


def test_xlsforms():
    out = xlsforms.convert(
        [{"type": "begin_group", "name": "g 1", "label::English (en)": "**G**"}, {"type": "range", "name": "1st", "parameters": "start=0 end=10 step=1", "relevant": "${a-b} == 'x'"}, {"type": "select_one yn", "name": "a-b", "label::English (en)": "A <script>x</script>", "label::French (fr)": "B", "hint": "<i>h</i>"},
         {"type": "end_group"}, {"type": "begin_kobomatrix", "name": "m", "kobo--matrix_list": "rows", "label": "M"}, {"type": "select_one yn", "name": "own", "label": "Own?"}, {"type": "end_kobomatrix"}, {"type": "rank", "name": "r"}, {"type": "select_one_from_file towns.csv", "name": "t"}, {"type": "csv-external", "name": "x"}],
        [{"list_name": "yn", "name": "y", "label::English (en)": "Yes"}, {"list_name": "rows", "name": "bike", "label": "Bike"}, {"list_name": "rows", "name": "car", "label": "Car"}], {"form_title": "T", "form_id": "t", "default_language": "English (en)", "style": "pages"})
    rows = {r.get("name"): r for r in out.survey if not r["type"].startswith("end")}
    assert rows["g_1"]["label"] == "<b>G</b>" and rows["q_1st"]["constraint"] == ". >= 0 and . <= 10" and rows["q_1st"]["relevance"] == "${a_b} = 'x'" and rows["a_b"]["label"] == "A" and rows["a_b"]["label:French"] == "B" and rows["a_b"]["hint"] == "h"
    assert rows["bike_own"]["label"] == "Bike: Own?" and rows["t"]["appearance"] == "search('towns')" and rows["r"]["type"] == "note" and "x" not in rows and out.settings["default_language"] == "English"
    assert form_rules.checklist(out.form())["names are safe"]


def test_names_and_lists():
    assert len(set(common.safe_names(["a b", "a-b", "a_b_2", "a b 2"]).values())) == 4
    assert "javascript:" not in common.label_text('<a href="javajavascript:script:x()">') and "<script" not in common.label_text("<scr<script></script>ipt>x</script>")
    assert common.safe_names(["a b", "a-b", "9x", "", "é"]) == {"a b": "a_b", "a-b": "a_b_2", "9x": "q_9x", "": "field", "é": "field_2"}
    names, kept = common.shared_lists({"x": [{"value": "1", "label": "A"}], "y": [{"value": "1", "label": "A"}], "z": [{"value": "1", "label": "a"}]})
    assert names == {"x": "x", "y": "x", "z": "z"} and list(kept) == ["x", "z"]


def test_name_columns_never_meet(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(["a b", "a-b", "a_b_2", "a b 2", "é", "", "1"])], "k int, n string")
    got = {r["k"]: r["safe_name"] for r in common.safe_name_column(df, "n", "k").collect()}
    assert got == {0: "a_b", 1: "a_b__2", 2: "a_b_2", 3: "a_b_2_2", 4: "field", 5: "field_2", 6: "q_1"}


def test_workbooks():
    data = sheets.write_xlsx({"survey": [{"type": "text", "name": "a", "label": "A & <b>"}, {"type": "integer", "name": "b", "relevant": "1 = 1"}], "choices": [], "settings": [{"form_id": "x"}]})
    read = sheets.read_xlsx(data)
    assert read["survey"][1] == {"excel_row": 3, "type": "integer", "name": "b", "relevance": "1 = 1"} and sheets.form_of(data).fields["a"].cells["label"] == "A & <b>"
    with pytest.raises(InvalidForm):
        sheets.read_xlsx(b"nothing")
    with pytest.raises(InvalidForm):
        sheets.form_of(sheets.write_xlsx({"other": []}))
    book = sheets.workbook_of(sheets.write_xlsx({"summaries": [{"type": "numeric", "field": "v", "bins": 4}], "global_filters": [{"field": "v", "filter": '("1","2")'}]}))
    assert book.summaries[0].bins == 4 and book.global_filters == [("v", '("1","2")')]


def test_dataset_xml():
    ds = dataset_xml.Dataset("d", "T", columns=["a", "b"], forms=["f"], links=[{"dataLinkClass": "FORM", "dataLinkType": "INCOMING", "linkObjectId": "f", "fieldMap": '[{"formField": "x", "datasetField": "a", "updateLogicAction": "CONCATENATE_TO_TEXT", "updateLogicOptions": {"separator": ";", "position": "END"}}]', "joiningField": "id"}],
                             cases={"displayMode": "tree", "showColumnsWhenTable": ["a", "b"]}, id_format={"prefix": "E", "numberOfDigits": "4"}, unique="a")
    assert dataset_xml.read(dataset_xml.write(ds)) == ds and not ds.problems()
    link = ds.publish_links()[0]
    assert (link.joining_field, link.key, link.fields[0].separator) == ("id", "a", ";")
    bad = dataset_xml.Dataset("", "T", "ODD", links=[{}], cases={"displayMode": "x"}, discriminator="ENUMERATORS")
    assert len(bad.problems()) == 7
    c = dataset_xml.Catalog()
    ds.version = 7
    c.upload(ds)
    assert c.readable("f") == ["d"] and ds.version == 1


def test_bundles(spark, tmp_path):
    manifest = {"name": "x", "author": "y", "version": "1.0.0", "supportedFieldTypes": ["text"]}
    files = {"manifest.json": json.dumps(manifest).encode(), "template.html": b"", "script.js": b"function clearAnswer() {}; setAnswer(1)", "style.css": b""}
    told = lambda files, zip_name=None: sorted((r["severity"], r["rule"], r["location"]) for r in bundle.findings(bundle.of_files(spark, files, zip_name)).collect())
    assert told(files) == [] == told(files, "My.plugin-2.FieldPlugin.zip")
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    assert bundle.main([str(tmp_path)]) == 0 and bundle.main([]) == 1
    worse = {**files, "sub/style.css": b"", "9.txt": b"", "manifest.json": json.dumps({"name": "", "version": "x", "supportedFieldTypes": ["date"], "externalJs": ["no.js"], "hideDefaultRequiredMessage": "yes"}).encode(), "script.js": b""}
    rules = told(worse, "1.fieldplugin.zip")
    assert ("error", "VL20", "1.fieldplugin.zip") in rules and ("error", "VL21", "style.css") in rules and ("error", "VL17", "9.txt") in rules and ("warning", "VL17", "sub") in rules and sum(r[1] == "VL18" for r in rules) == 6 and sum(r[1] == "VL19" for r in rules) == 2
    assert {r[2] for r in told({"sub/manifest.json": b"{}"})} >= {"manifest.json", "script.js"} and told({}) and told(files, "x.zip") == [("warning", "VL20", "x.zip")]
    for bad in (b"{", b"[]", b"{}"):
        assert any(r[1] == "VL18" for r in told({**files, "manifest.json": bad}))
    assert told({**files, "manifest.json": json.dumps({**manifest, "externalCss": "a.css", "externalJs": ["script.js", 3]}).encode()}) == [("error", "VL18", "manifest.externalCss"), ("error", "VL18", "manifest.externalJs")]
    assert bundle.parameters("custom-x(a=${f}, b='1,2', c=if(1=1,2,3))") == {"a": "${f}", "b": "'1,2'", "c": "if(1=1,2,3)"}


def test_zipped_bundles(spark, tmp_path):
    import zipfile

    for name, files in {"good.fieldplugin.zip": ["manifest.json", "__MACOSX/x", "script.js"], "odd name.fieldplugin.zip": ["a/script.js"]}.items():
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for f in files:
                z.writestr(f, "{}")
    found = bundle.findings(bundle.read_zips(spark, str(tmp_path)))
    got = {(r["bundle"].rpartition("/")[2].replace("%20", " "), r["rule"], r["location"]) for r in found.collect()}
    assert ("good.fieldplugin.zip", "VL17", "style.css") in got and not any("MACOSX" in r[2] for r in got) and any(r[0].startswith("odd") and r[1] == "VL20" for r in got)
    assert bundle.report_json(found).count() == 2


def test_expression_rules():
    f = Form([{"type": "select_multiple l", "name": "m"}, {"type": "begin repeat", "name": "r"}, {"type": "integer", "name": "v"}, {"type": "end repeat"}, {"type": "calculate", "name": "c", "calculation": "${v} + 1"}, {"type": "text", "name": "t", "relevance": "${m} = 'q' and random() > 0.5"}], [{"list_name": "l", "value": "1", "label": "x"}])
    assert sorted({r[1] for r in form_rules.expression_rules(f)}) == ["VL12", "VL13", "VL14", "VL15"]


def test_translation_rules(spark):
    sheet = sheets.sheet_frame(spark, [{"label": "Hi ${a}", "label:fr": "Salut ${b}", "media:image": "x"}, {"label": "Hi ${a}", "label:fr": "Bonjour ${a}", "media:image:fr": "y"}])
    lost = translation_rules.tokens_kept(sheet).collect()
    assert len(lost) == 1 and lost[0]["lost"] == ["${a}"] and lost[0]["added"] == ["${b}"]
    assert translation_rules.glossary_conflicts(sheet).count() == 1 and translation_rules.media_parity(sheet).count() == 2 and translation_rules.tags_kept(sheet).count() == 0
    assert translation_rules.default_unsuffixed(sheet.columns, "fr") == ["label:fr", "media:image:fr"] and set(translation_rules.languages(sheet.columns)) == {"", "fr"}
    assert translation_rules.changed_keys(sheet, sheet.where("excel_row = 2"), ["excel_row"]).count() == 1
    big = spark.range(20_000).withColumnRenamed("id", "excel_row")
    assert 800 < translation_rules.spot_check(big).count() < 1200
    assert "| Term |" in translation_rules.glossary_markdown([("cat", {"fr": "chat"})], ["fr"])


def test_expression_rules_of_many_forms(spark):
    """The same findings as from each form alone, whatever the tasks its rows lie in."""
    import random

    rows, choices = [], []
    for f in range(6):
        rows += [(f, 2, "select_multiple l", "m", None, None), (f, 3, "begin repeat", "r", None, None), (f, 4, "integer", "v", None, None), (f, 5, "end repeat", None, None, None)]
        rows.append((f, 6, "calculate", "c", "${v} + 1" if f % 2 else "1 + 1", None))
        rows.append((f, 7, "text", "t", None, "${m} = 'q'" if f % 3 else None))
        choices.append((f, 2, "l", "1", "One"))
    random.Random(1).shuffle(rows)
    survey = spark.createDataFrame(rows, "form int, excel_row int, type string, name string, calculation string, relevance string").repartition(5)
    listed = spark.createDataFrame(choices, "form int, excel_row int, list_name string, value string, label string")
    got = {}
    for r in form_rules.expression_rules_of(survey, listed).collect():
        got.setdefault(r["form"], []).append(tuple(r)[1:])
    for f in range(6):
        names = ("excel_row", "type", "name", "calculation", "relevance")
        own = [{k: v for k, v in zip(names, r[1:]) if v is not None} for r in sorted(rows) if r[0] == f]
        want = form_rules.expression_rules(Form(own, [{"list_name": "l", "value": "1", "label": "One"}]))
        assert sorted(got.get(f, [])) == sorted(map(tuple, want))


def test_expression_rules_of_many_forms_are_dealt_over_tasks(spark):
    """Forms of few bytes stay dealt over all tasks; one without choices, one without rows and one without a name are forms of their own."""
    from pyspark.sql import functions as F

    survey = spark.range(2000).distinct().selectExpr("id form", "2 excel_row", "'text' type", "'t' name", "if(id % 2 = 0, 'random() > 1', null) relevance")
    survey = survey.unionByName(spark.sql("SELECT CAST(null AS bigint) form, 3 excel_row, 'text' type, 't' name, '${gone} = 1' relevance"))
    listed = spark.range(1, 2001).distinct().selectExpr("id form", "'l' list_name", "'1' value", "'One' label")
    found = form_rules.expression_rules_of(survey, listed).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["form"] is None, r["form"] or 0, r["rule"]) for r in found) == [*((False, k, "VL14") for k in range(0, 2000, 2)), (True, 0, "VL06")]
    assert len({r["task"] for r in found}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
