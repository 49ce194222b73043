import numpy as np
import pytest

from formloom.llm.ann_forest import Forest, best, nearest


def brute(ids, x, k=10, every=100):
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), d[j]) for j in order]
    return out


def held(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_and_scores(spark, folder):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    p = df.toPandas()
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding.to_list()).astype(float)
    got, want = held(nearest(df).collect()), brute(ids, x)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 10 >= 0.9
    for q, found in got.items():
        assert len(found) == 10
        for i, s in found:
            assert abs(s - np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum())) < 1e-12


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (200, [float("inf"), 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<double>, score string")
    got = held(nearest(df).collect())
    assert [i for i, _ in got[0]] == [1, 9, 2, 100] and [i for i, _ in got[100]] == [2, 0, 1, 9]
    assert nearest(df.limit(0)).count() == 0 and nearest(df.where("vec_id = 0")).count() == 0


def test_many_copies(spark, monkeypatch):
    import formloom.llm.ann_forest as ann

    monkeypatch.setattr(ann, "ROW_BLOCK", 50)
    monkeypatch.setattr(ann, "QUERIES", 2)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    x[:400] = x[0]
    df = spark.createDataFrame([(k, x[k].tolist()) for k in range(900)], "vec_id bigint, embedding array<double>")
    got, want = held(nearest(df, recall=1.0).collect()), brute(np.arange(900), x)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_forest_visits_all_and_ties():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 6))
    f = Forest(x, 3, 32, 1)
    assert sorted(f.visit(x[0], f.n_leaves)) == list(range(1, f.n_leaves + 1))
    assert set(f.leaves(x)[0]) & set(f.visit(x[0], 3))
    same = list(best(np.zeros((1, 2)), np.array([7]), np.ones((4, 2)), np.array([9, 3, 7, 5]), 2))
    assert same[0][1].tolist() == [3, 5]


def test_an_id_repeated_more_than_k_times(spark, monkeypatch):
    import formloom.llm.ann_forest as ann

    monkeypatch.setattr(ann, "ROW_BLOCK", 100)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 8))
    ids = np.arange(900)
    ids[1:300] = 5  # near the query and one of a third of all rows
    x[1:300] = x[0] + 1e-3 * rng.standard_normal((299, 8))
    found = list(best(x[:1], ids[:1], x, ids, 3))[0]
    assert len(set(found[1].tolist())) == 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip([*ids, *ids], [*x, *x])], "vec_id bigint, embedding array<double>")
    got = held(nearest(df, recall=1.0).collect())
    for q in (0, 300, 800):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want: dict = {}
        for j in np.lexsort((ids, d)):
            if ids[j] != q:
                want.setdefault(int(ids[j]), d[j])
        assert [i for i, _ in got[q]] == list(want)[:10] and np.allclose([s for _, s in got[q]], list(want.values())[:10])
    assert len(np.unique(ann.vector_salt(x[1:300]) % np.uint64(97))) > 50


def test_structured_vectors_need_few_leaves(spark):
    from formloom.llm.ann_forest import usable, visits_for

    rng = np.random.default_rng(6)
    centres = rng.standard_normal((200, 16))
    x = centres[rng.integers(0, 200, 20_000)] + 0.05 * rng.standard_normal((20_000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    forest = Forest(x[::5], 4, 64, 1)
    assert visits_for(usable(df, "vec_id", "embedding"), forest, 10, 100, 64, 0.96) < forest.n_leaves / 8
    got, want = held(nearest(df).collect()), brute(np.arange(len(x)), x)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]) / 10 >= 0.9


def test_lengths_are_counted_over_the_table(spark):
    rows = [(k, [1.0, float(k)]) for k in range(1, 40)] + [(100, [0.5, 0.5])] + [(1000 + k, [1.0, 2.0, 3.0]) for k in range(39)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {r["vec_id"] for r in nearest(df, sample=8).collect()} <= set(range(1, 40))
