"""Positions, intervals, closures and pages against brute force, and that no task sees all rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from formloom.operators.intervals import containing
from formloom.operators.positions import numbers_within, row_numbers, running_sums
from formloom.plans import patches, rows
from formloom.plans.pages import Pages
from formloom.sources.sheets import sheet_frame


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_positions_by_hand(spark, parts):
    rng = random.Random(parts)
    data = [(k, rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(-3, 4)) for k in range(200)]
    df = spark.createDataFrame(data, "id int, key string, v int").repartition(5)
    assert {r.id: r.n for r in row_numbers(df, [F.desc("id")], partitions=parts).collect()} == {k: 200 - k for k in range(200)}
    sums = {r.id: (r.s, r.c) for r in running_sums(df, ["id"], {"s": F.col("v"), "c": F.lit(0.5)}, partitions=parts).collect()}
    total = 0
    for k, _, v in data:
        total += v
        assert sums[k] == (total, 0.5 * (k + 1))
    seen = {}
    for k, key, v in sorted(data, key=lambda r: (r[2], r[0])):
        seen[key] = seen.get(key, 0) + 1
        data[k] = (*data[k], seen[key])
    assert {r.id: r.n for r in numbers_within(df, ["key"], ["v", "id"], partitions=parts).collect()} == {r[0]: r[3] for r in data}
    assert row_numbers(df.limit(0), ["id"]).collect() == [] and numbers_within(df.limit(0), ["key"], ["id"]).collect() == []


def test_intervals_by_hand(spark):
    rng = random.Random(5)
    spans = [(k, *sorted((rng.randrange(-50, 400), rng.randrange(-50, 400)))) for k in range(60)] + [(60, -5000, 5000), (61, 7, 7), (62, 7, 8), (63, None, 9), (64, 3, None)]
    points = [(k, rng.randrange(-60, 420)) for k in range(150)] + [(150, None)]
    got = containing(spark.createDataFrame(points, "p int, x int"), "x", spark.createDataFrame(spans, "i int, lo int, hi int"), "lo", "hi")
    assert "Cartesian" not in plan_of(got) and "NestedLoop" not in plan_of(got)
    want = sorted((p, i) for p, x in points for i, lo, hi in spans if None not in (x, lo, hi) and lo < x < hi)
    assert sorted((r.p, r.i) for r in got.collect()) == want


def test_markers_of_a_million_rows(spark):
    """Pairs at three depths; the plan deals rows by key or range only."""
    n = 1_000_000
    place = F.col("id") % 10
    kind = F.when(place < 3, "begin group").when(place > 6, "end group").otherwise("text")
    sheet = spark.range(n).select((F.col("id") + 2).cast("int").alias("excel_row"), kind.alias("type"), F.concat(F.lit("n"), F.col("id")).alias("name"))
    pairs = rows.marker_pairs(sheet)
    assert "SinglePartition" not in plan_of(pairs)
    wrong = pairs.where((F.col("end_row") - F.col("begin_row") != 9 - 2 * (F.col("depth") - 1)) | F.col("end_row").isNull())
    assert pairs.count() == 3 * n // 10 and wrong.count() == 0


def test_markers_uneven(spark):
    kinds = ["end group", "begin group", "text", "begin repeat", "end repeat", "end group", "end group", "begin group", "text", "begin group"]
    sheet = sheet_frame(spark, [{"excel_row": k + 2, "type": t, "name": f"n{k}"} for k, t in enumerate(kinds)])
    got = sorted((r.begin_row, r.end_row) for r in rows.marker_pairs(sheet).collect())
    assert got == [(3, 7), (5, 6), (9, None), (11, None)]


def test_patched_rows_have_no_single_task(spark):
    sheet = sheet_frame(spark, [{"excel_row": k + 2, "list_name": "l", "value": str(k)} for k in range(50)])
    batch = [{"op": "add_row", "sheet": "choices", "insert_before_excel_row": 5, "values": {"value": "new"}}, {"op": "delete_row", "sheet": "choices", "excel_row": 9}, {"op": "add_row", "sheet": "choices", "values": {"value": "last"}}]
    new, _ = patches.apply(patches.Sheets(sheet, sheet, {}), batch)
    got = [r.value for r in new.choices.orderBy("excel_row").collect()]
    want = [str(k) for k in range(50)]
    assert got == [*want[:3], "new", *want[3:7], *want[8:], "last"] and [r.excel_row for r in new.choices.orderBy("excel_row").collect()] == list(range(2, 53))
    assert "SinglePartition" not in plan_of(new.choices)


@pytest.mark.parametrize("most", [None, 1, 3, 6])
def test_closure_of_all_by_hand(spark, most):
    rng = random.Random(2)
    edges = {(f"a{k}", f"a{k + 1}") for k in range(20)} | {(f"b{rng.randrange(12)}", f"b{rng.randrange(12)}") for _ in range(18)} | {("a20", "a5"), ("x", "x")}
    nexts = {}
    for a, b in edges:
        nexts.setdefault(a, set()).add(b)
    want = set()
    for seed in nexts:
        front, seen, depth = {seed}, {}, 0
        while front and (most is None or depth < most):
            depth += 1
            front = {m for n in front for m in nexts.get(n, ())} - seen.keys()
            seen |= dict.fromkeys(front, depth)
        want |= {(seed, n, d) for n, d in seen.items()}
    df = spark.createDataFrame(sorted(edges), "source string, target string")
    assert {tuple(r) for r in rows.closure_of_all(df, most).collect()} == want


def test_closure_of_all_makes_each_path_of_a_chain_once(spark, monkeypatch):
    """What a round groups is the known pairs and the new ones, in as many tasks as their number asks for."""
    grouped, real = [], rows.stored

    def stored(df, what):
        grouped.append(re.findall(r"hashpartitioning\(seed#\d+, node#\d+, (\d+)\), REPARTITION_BY_NUM", plan_of(df)))
        out = real(df, what)
        counts.append(out.count())
        return out

    counts = []
    monkeypatch.setattr(rows, "stored", stored)
    monkeypatch.setattr(rows, "GROUPED", 20)
    edges = spark.createDataFrame([(f"a{k}", f"a{k + 1}") for k in range(50)], "source string, target string")
    got = {tuple(r) for r in rows.closure_of_all(edges).collect()}
    assert got == {(f"a{i}", f"a{j}", j - i) for i in range(50) for j in range(i + 1, 51)}
    assert sum(counts) == len(got) and len(counts) == 7  # no pair is stored twice, and no round is run for nothing
    known = [sum(counts[:k]) for k in range(1, 7)]
    assert [int(g[0]) for g in grouped[1:]] == [max(4, 2 * n // 20) for n in known]


def test_pages_are_those_of_the_query(spark):
    rng = random.Random(3)
    sheet = sheet_frame(spark, [{"excel_row": k + 2, "name": rng.choice(["x", "y", None]), "label": str(rng.randrange(9))} for k in range(300)])
    order, where = [("label", "desc"), ("name", "asc")], {"not": {"eq": ["label", "3"]}}
    pages = Pages(sheet, where, order, runs=7)
    for start in (0, 95, pages.total - 10, pages.total + 5):
        want = rows.query(sheet, where, order, start, 100, ["excel_row", "name", "gone"]).collect()
        assert pages.page(start, 100, ["excel_row", "name", "gone"]).collect() == want
    scan = plan_of(pages.page(100, 10))
    assert "PartitionFilters: [" in scan and "__range" in scan.split("PartitionFilters", 1)[1][:80]
    assert Pages(sheet.limit(0)).page().collect() == []
    with pytest.raises(ValueError):
        pages.page(0, 101)


def test_text_index_equals_the_scan(spark):
    from formloom.plans import text_index, text_search

    rng = random.Random(4)
    words = ["common"] * 30 + ["rare", "Other", "middling"] * 3 + [f"w{k}" for k in range(40)]
    texts = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) or None) for k in range(600)], "id int, text string")
    index = text_index.TextIndex(texts, "id", "text", block=4)
    for query, k in (("rare other", 5), ("common", 20), ("middling w3 RARE", 7), ("nowhere", 5), ("w7", 20)):
        got, want = index.search(query, k).collect(), text_search.search(texts, "id", "text", query, k).collect()
        assert [(r.id, round(r.score, 9)) for r in got] == [(r.id, round(r.score, 9)) for r in want]
    with pytest.raises(ValueError):
        index.search("x", 21)
    assert text_index.TextIndex(texts.limit(0), "id", "text").search("rare").collect() == []


def test_scratch_goes(spark):
    from pathlib import Path

    from formloom.session import SCRATCH, scratch

    df = spark.range(50).select(F.col("id").cast("int").alias("id"))
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            assert sorted(r.n for r in row_numbers(df, ["id"], "n").collect()) == list(range(1, 51))
            here = Path(inner.removeprefix("file://"))
            assert any(here.iterdir()) and spark.conf.get(SCRATCH) == inner
        assert not here.exists() and spark.conf.get(SCRATCH) == outer
    assert spark.conf.get(SCRATCH, None) is None
