import random

from pyspark.sql import functions as F

from formloom.expressions.compiler import compile_expr, scope_of
from formloom.plans import explore, patches, rows
from formloom.sources.sheets import sheet_frame


def test_lists(spark):
    rng = random.Random(1)
    data = [(k, [rng.choice(["a", "b", "", "ab", "x y"]) for _ in range(rng.randint(1, 6))]) for k in range(300)]
    data = [(k, v) for k, v in data if "".join(v) or len(v) > 1]  # one blank item is a blank list
    df = spark.createDataFrame([(k, [(x,) for x in v], ",".join(v)) for k, v in data], "k int, r array<struct<v: string>>, s string")
    scope = scope_of({"k": "number", "s": "string"}, {"r": {"v": "string"}})
    e = {"n": "count-items(',', join(',', ${v}))", "same": "join(',', ${v}) = ${s}", "once": "de-duplicate(',', ${s})", "twice": "de-duplicate(',', de-duplicate(',', ${s}))", "all": "count(${r})"}
    for r, (_, v) in zip(df.select("k", *[compile_expr(t, scope).col.alias(n) for n, t in e.items()]).orderBy("k").collect(), data, strict=True):
        assert r["n"] == r["all"] == len(v) and r["same"] and r["once"] == r["twice"] == ",".join(dict.fromkeys(v))


def test_filters(spark):
    sheet = sheet_frame(spark, [{"name": f"n{k}", "label": None if k % 3 else str(k % 5)} for k in range(60)]).persist()
    rng = random.Random(2)

    def tree(depth):
        if depth == 0:
            return rng.choice([{"eq": ["label", "3"]}, {"has": ["label"]}, {"regex": ["name", "n1"]}, {"in": ["name", ["n2", "n3"]]}, {"between": ["excel_row", 5, 30, "exclusive"]}])
        return rng.choice([{"and": [tree(depth - 1), tree(depth - 1)]}, {"or": [tree(depth - 1), tree(depth - 1)]}, {"not": tree(depth - 1)}])

    checks = []
    for k in range(12):
        p, q = tree(2), tree(1)
        f = lambda t: rows.compile_filter(t, sheet.columns)
        checks += [(f(p) == f({"not": {"not": p}})).alias(f"a{k}"), (f({"not": {"and": [p, q]}}) == f({"or": [{"not": p}, {"not": q}]})).alias(f"b{k}"), f(p).isNotNull().alias(f"c{k}")]
    assert all(all(r) for r in sheet.select(*checks).collect())


def test_a_batch_is_its_steps_one_by_one(spark):
    rng = random.Random(3)
    base = [{"name": f"n{k}"} for k in range(8)]
    for _ in range(4):
        batch, model = [], [(k + 2, dict(r)) for k, r in enumerate(base)]
        doomed = set(rng.sample(range(2, 10), 2))
        for k in range(4):
            at = rng.randint(2, 9)
            if rng.random() < 0.5:
                batch.append({"op": "add_row", "sheet": "survey", "insert_before_excel_row": at, "values": {"name": f"new{k}"}})
            elif at not in doomed:
                batch.append({"op": "edit_row", "sheet": "survey", "excel_row": at, "values": {"name": f"edited{k}"}})
        batch += [{"op": "delete_row", "sheet": "survey", "excel_row": d} for d in doomed]
        for p in batch:
            if p["op"] == "edit_row":
                next(r for at, r in model if at == p["excel_row"])["name"] = p["values"]["name"]
            elif p["op"] == "add_row":
                place = next(k for k, (at, _) in enumerate(model) if at == p["insert_before_excel_row"])
                model.insert(place, (None, dict(p["values"])))
        want = [r["name"] for at, r in model if at not in doomed]
        sheet = sheet_frame(spark, base)
        new, _ = patches.apply(patches.Sheets(sheet, sheet, {}), batch)
        got = new.survey.orderBy("excel_row").collect()
        assert [r["name"] for r in got] == want and [r["excel_row"] for r in got] == list(range(2, len(want) + 2))


def test_bins_hold_every_row_once(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).cast("double").alias("v"))
    for bins in (1, 3, 7, 50):
        out = explore.compile_summary(explore.Summary("numeric", "v", bins=bins), df).collect()
        assert sum(r["n"] for r in out) == 500 and {r["bin"] for r in out} == set(range(1, bins + 1))
        edges = sorted((r["bin"], r["from_value"], r["to_value"]) for r in out)
        assert all(a[2] < b[1] for a, b in zip(edges, edges[1:]))


def test_filters_keep_what_predicates_keep(spark):
    from formloom.expressions.compiler import predicate, where

    df = spark.createDataFrame([(a, b, t) for a in (None, 1.0, 5.0) for b in (None, 1.0, 7.0) for t in (None, "", "x")], "a double, b double, t string").persist()
    scope = scope_of({"a": "number", "b": "number", "t": "string"})
    for e in ("${a} > ${b}", "${a} != ${b} and ${t} = 'x'", "not(${a} > ${b}) or ${t} != 'x'", "${a} > 2 or (${b} < 3 and ${t} != '')", "${a}", "empty(${t}) and ${a} >= 1", "if(${a} > 2, ${b} > 2, ${t} = 'x')", "not(${a} = 1 and ${b} = 1)"):
        assert sorted(map(str, df.where(where(e, scope)).collect())) == sorted(map(str, df.where(predicate(e, scope)).collect())), e


def test_exclusions_are_the_rest(spark):
    data = [(None, None), ("3", 3.0), ("x", 5.0), ("7", 7.0), ("2024-01-05", 0.0)]
    df = spark.createDataFrame(data, "s string, v double").persist()
    for name in ("s", "v"):
        for text in ('"3";"x"', '("2","5")', '("0","0")', '("2","");("","1")', '("2024-01-01","2024-02-01")'):
            kept, rest = explore.keep(df, name, text), explore.drop(df, name, text)
            assert kept.count() + rest.count() == 5 and rest.where(F.col(name).isNull()).count() == 1, (name, text)


def test_filters_reach_the_scan(spark, data):
    from formloom.expressions.compiler import where

    orders = spark.read.parquet(f"{data}/orders.parquet")
    scope = scope_of({"o_totalprice": "number", "o_orderstatus": "string", "o_custkey": "number"})
    shown = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,300000.0)" in shown(orders.where(where("${o_totalprice} > 300000 and ${o_custkey} < 50", scope)))
    assert "GreaterThanOrEqual(o_totalprice,10.0)" in shown(explore.keep(orders, "o_totalprice", '("10","20")'))
    assert "Not(" in shown(explore.drop(orders, "o_orderstatus", '"F"')).split("PushedFilters")[1]
