"""Registered queries against their SQL. The long ones run with ALL_QUERIES=1; the driver runs all of them anyway."""

import os

import duckdb
import oracle
import pytest

from verbaloom.plans.oracles import ORACLES
from verbaloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LONG = {
    "accepted_venn", "layer_ablation", "layer1_ablation", "filter_ablation", "lane_ablation", "tam_shuffle", "comp_shuffle", "perm_summary", "perm_histogram", "stable_schemas",
    "schema_stability", "globally_stable", "example_semantics", "multi_schema_verbs", "layer1_attribution", "lemma_counts", "dual_lane_tpch", "dual_lane_discovery", "fdr_tpch", "g2_tpch",
    "verb_shuffle", "venn_json", "inventory_csv", "filtering_cascade", "schema_inventory", "pattern_names", "results_json", "sensitivity_grid",
}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    return oracle.connection(DATA)


@pytest.mark.parametrize("name", [n for n in ORACLES if n not in LONG or os.environ.get("ALL_QUERIES")])
def test_query_equals_sql(spark, con, name):
    got, want, _ = oracle.compare(spark, QUERIES[name], ORACLES[name], DATA, con)
    spark.catalog.clearCache()
    assert got == want


@pytest.mark.parametrize("texts", [["It is kept."], [None, "", "No verb here."]])
def test_cascade_of_empty_stages_equals_sql(spark, tmp_path, texts):
    """Without patterns, or without rows, a share of nothing is NaN, as in the SQL."""
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    own = duckdb.connect()
    own.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want, _ = oracle.compare(spark, QUERIES["filtering_cascade"], ORACLES["filtering_cascade"], str(tmp_path), own)
    assert got == want and (0, "nan", "accepted") in got[1]
