"""Queries that SQL can express, against DuckDB."""

import os

import pytest

from cellweave.llm import entries

from .. import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_rows_equal_the_oracle(spark, name):
    assert oracle.spark_rows(entries.queries()[name](spark, SF)) == oracle.duck_rows(oracle.connect(SF), entries.oracle_sql()[name])
