"""Every registered query against its oracle SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
#: Queries of this package's own operators; add-ons bring their own tests.
QUERIES = {k: f for k, f in entry.queries().items() if f.__module__.startswith("auditlake.plans.")}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert QUERIES and set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 1 and "site" in df.columns
