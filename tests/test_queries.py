"""Every named query runs, and agrees with its SQL where it has one."""

import pytest

from marquee.plans import catalogue

from . import oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF_DIR)
    if name in catalogue.ORACLES:
        assert oracle.difference(df, catalogue.ORACLES[name], con) is None
    else:
        assert df.count() >= 0


def test_entry(spark):
    rows = catalogue.flagship(spark, SF_DIR).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(0 <= r["popularity_score"] <= 100 for r in rows)
