import subprocess
import sys

import pytest
from compare import assert_same, connect

from formloom.catalogue import CATALOGUE


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, data, con, name):
    q = CATALOGUE[name]
    df = q.build(spark, data)
    if q.oracle:
        assert_same(df, con, q.oracle)
    else:
        assert df.count() > 0


@pytest.mark.parametrize("module", ["catalogue", "queries_data", "queries_forms", "queries_more", "queries_rules", "queries_scale"])
def test_modules_import_first(module):
    subprocess.run([sys.executable, "-c", f"import formloom.{module}"], check=True)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chance_is_stable(spark, data):
    build = CATALOGUE["treatment_assignment"].build
    a, b = build(spark, data).collect(), build(spark, data).repartition(7).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    share = sum(r["arm"] == "treatment" for r in a) / len(a)
    assert 0.3 < share < 0.7 and all(0 <= r["draw"] < 1 for r in a) and len({r["code"] for r in a}) == len(a)
