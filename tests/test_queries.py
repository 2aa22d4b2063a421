"""Every registered query against its SQL twin, and a look at its plan."""

import re

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck

SF_DIR = "/root/testdata/sf0.001"
# No hour has all five pollutants at this size.
EMPTY = {"drop_null_rows", "merge_on_interval_inner"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert not problem, problem
    assert rows > 0 or name in EMPTY
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in entry.queries())


def test_scan_reads_only_needed_columns(spark):
    made = entry.queries()["lag_per_key"](spark, SF_DIR)
    plan = made._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("props" not in s and "event_type" not in s for s in schemas)
