"""Every registered query against its SQL, or by its rows alone, and the entry module's contract."""

from __future__ import annotations

import pytest

import __spark_entry__
from sectionlake import catalogue
from tests.conftest import SMALL, check_against_sql


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_sql(spark, name):
    check_against_sql(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["id", "path", "tier", "score"]
