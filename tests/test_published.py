"""Published datasets: merging when read against publishing one batch after the other, replays, conflicts, snapshots."""

import random
import threading

import pytest

from formloom.plans.publish import ADD, CONCATENATE, FieldMap, Link, publish
from formloom.plans.published import Conflict, PublishedDataset

LINK = Link("k", "id", [FieldMap("n", "n", ADD), FieldMap("t", "t"), FieldMap("t", "all", CONCATENATE, "|"), FieldMap("t", "back", CONCATENATE, "/", "BEGINNING")])
OTHER = Link("k", "id", [FieldMap("t", "n"), FieldMap("t", "more")], relevance_field="on")
SCHEMA = "o int, k string, n double, t string, `on` string"


def batches(spark, seed, count, size=20):
    rng = random.Random(seed)
    rows = lambda b: [(b * 100 + k, rng.choice("abcdefg"), rng.choice([None, 1.0, 2.5]), rng.choice([None, "x", "7", f"{b}-{k}"]), rng.choice("01")) for k in range(size)]
    return [spark.createDataFrame(rows(b), SCHEMA) for b in range(count)]


def start(spark):
    return spark.createDataFrame([("a", "1", None), ("z", None, "old")], "id string, n string, t string")


def same(a, b):
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, a.select(cols).collect()), key=key) == sorted(map(tuple, b.select(cols).collect()), key=key)


def test_merged_when_read(spark, tmp_path):
    d = PublishedDataset(spark, str(tmp_path), "id", start(spark), buckets=3)
    want, before = start(spark), []
    for b, rows in enumerate(batches(spark, 1, 5)):
        link = OTHER if b == 2 else LINK
        before.append((d.commit().version, want))
        d.publish(rows, link, ["o"], "w", b)
        d.publish(rows, link, ["o"], "w", b)  # replayed
        want = publish(rows, link, want, ["o"])
    same(d.read(), want)
    same(d.read(keys=["a", "q"]), want.where("id in ('a', 'q')"))
    for version, was in before[-2:]:
        same(d.read(version), was)
    d.compact()
    assert not d.commit().runs
    same(d.read(), want)
    d.clean(1)
    assert len(d.versions()) == 1 and len(list((tmp_path / "data").iterdir())) == 1
    same(d.read(), want)


def test_a_batch_writes_no_more_into_a_large_dataset(spark, tmp_path):
    size = lambda p: sum(f.stat().st_size for f in p.rglob("*.parquet"))
    wrote = []
    for n in (100, 100_000):
        folder = tmp_path / str(n)
        d = PublishedDataset(spark, str(folder), "id", spark.range(n).selectExpr("cast(id as string) id", "'1' n", "'t' t"), buckets=2)
        was = size(folder)
        d.publish(batches(spark, 2, 1)[0], LINK, ["o"], "w", 0)
        wrote.append(size(folder) - was)
        assert len(d.commit().runs) == 1
    assert wrote[1] <= wrote[0] * 1.2


def test_two_publishers_lose_nothing(spark, tmp_path):
    d = PublishedDataset(spark, str(tmp_path), "id", spark.range(500).selectExpr("cast(id as string) id", "'0' n"), buckets=2)
    link = Link("k", "id", [FieldMap("n", "n", ADD)])
    rows = spark.createDataFrame([(1, "7", 1.0)], "o int, k string, n double")
    failed = []

    def work(name):
        try:
            own = PublishedDataset(spark, str(tmp_path), "id", buckets=2)
            for b in range(4):
                own.publish(rows, link, ["o"], name, b)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(w,)) for w in "xy"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and d.read().where("id = '7'").first()["n"] == "8" and d.commit().seen == {"x": 3, "y": 3}
    assert d.versions() == list(range(d.versions()[-1] + 1))


def test_conflicts_and_appended_rows(spark, tmp_path):
    d = PublishedDataset(spark, str(tmp_path), "id", start(spark), buckets=2)
    read = d.commit().version
    d.append(spark.createDataFrame([("q", "5", "new")], "id string, n string, extra string"))
    assert {r.id: r.asDict().get("extra") for r in d.read().collect()} == {"a": None, "z": None, "q": "new"}
    with pytest.raises(Conflict):
        d.replace(start(spark), read)
    d.replace(d.read().where("id <> 'z'"), d.commit().version)
    assert sorted(r.id for r in d.read().collect()) == ["a", "q"]
    late = d.commit()
    assert not d._put(late)  # its number is taken
