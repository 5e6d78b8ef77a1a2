"""Every registered query against its SQL, on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from layerlens.plans.catalog import QUERIES
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
EQUAL = sorted(n for n, q in QUERIES.items() if q.sql is not None)
ROWS = sorted(n for n, q in QUERIES.items() if q.sql is None)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", EQUAL)
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name].run(spark, SF), con, QUERIES[name].sql) is None


@pytest.mark.parametrize("name", ROWS)
def test_gives_rows(spark, con, name):
    """The embeddings' labels are noise, so fits are checked for shape here and for what
    they learn in test_probes."""
    rows = QUERIES[name].run(spark, SF).collect()
    assert rows
    if "y_pred" in rows[0].asDict() and "y_true" in rows[0].asDict():
        split = "substr(md5(concat(vec_id, '-7')), 1, 8) < '33333333'"
        test_rows = con.sql(f"SELECT count(*) FROM embeddings WHERE {split}").fetchall()[0][0]
        assert len(rows) == test_rows == len({r.id for r in rows})
        assert {r.y_pred for r in rows} <= set(range(10))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset", "pooling", "accuracy", "layer", "probe"]
    assert df.count() == 4


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
