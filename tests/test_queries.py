"""Every registered query of the panel engine against its oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from cellweave.plans import catalog

from . import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_equal_the_oracle(spark, con, name):
    assert oracle.spark_rows(catalog.queries()[name](spark, SF)) == oracle.duck_rows(con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["stat_two_sample_p_values", "stat_bootstrap_interval", "idx_verdicts", "idx_blended_outliers", "ml_ridge", "ml_wind_clusters"])
def test_queries_without_sql_have_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("partitions", ["1", "8"])
@pytest.mark.parametrize("name", ["agg_band_decay_table", "win_global_percent_rank", "join_nearest_by_tiles", "stat_bootstrap_interval"])
def test_results_do_not_depend_on_partitions(spark, name, partitions):
    before = oracle.spark_rows(catalog.queries()[name](spark, SF))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert oracle.spark_rows(catalog.queries()[name](spark, SF)) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
