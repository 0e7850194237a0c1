"""Queries against their SQL twins, Spark against DuckDB.

One query of every family; FEATWRIGHT_ALL=1 runs them all, as does
``python -m workload.compare``.
"""

import os

import pytest

from workload import compare, registry

SF_DIR = "/root/testdata/sf0.001"
FAMILIES = (
    "ensemble_aggregate agg_borda_ranked fold_scores robust_features scan_labelled_cells stratified_folds "
    "yeojohnson_lambda corr_pearson store_results check_standard best_trial reverse_best_trial "
    "linear_attribution power_windows elect_coombs"
).split()
KEYS = list(registry.queries()) if os.environ.get("FEATWRIGHT_ALL") else FAMILIES


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("key", KEYS)
def test_same_rows(spark, con, key):
    message, _, _ = compare.differences(spark, con, key, SF_DIR)
    # some expectations have nothing to report on the smallest tables
    assert message is None or (message == "no rows" and key.startswith("check_"))


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
