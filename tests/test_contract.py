"""The driver contract: every query has a stable schema; SQL names match."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
SLOW = {"leiden_membership", "setcover_clusters", "umap_layout", "score_table_pca"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["target_cluster", "query_cluster", "similarity"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - SLOW))
def test_query_matches_sql(spark, con, name):
    verdict = compare(
        spark, con, FOLDER, name, contract.queries()[name], contract.oracle_sql().get(name)
    )
    assert verdict.startswith(("ok", "rows-only")), verdict
