"""Catalogue queries against their DuckDB twins on the smallest tables."""

import os

import pytest

from tallywick.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
SOME = ["cleaned_orders", "drop_reasons", "recency_floor", "score_q4", "segment_summary", "segment_advice", "cohort_long", "clv_heuristic", "customer_lists", "quality_summary", "median_impute", "davies_bouldin", "roc_auc", "permutation_balance", "beeswarm_ranks", "dbscan_clusters", "tree_contributions", "quality_findings", "clv_repeat_buyers", "pca_axes", "shap_summary", "shap_waterfall"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "events", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(catalogue.oracle_sql()[name])
    at = {c: k for k, c in enumerate(rel.columns)}
    assert sorted(at) == columns
    assert got == sorted(tuple(str(r[at[c]]) for c in columns) for r in rel.fetchall())
