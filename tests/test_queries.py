"""A few registered queries of every kind against their SQL; ``python -m tests.oracle`` runs all."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "apply_ignore", "surface_dice", "connected_components_26", "dilate", "patch_index", "class_stats", "intensity_histogram",
    "augment_rot90", "normalize_zscore", "missing_files", "scroll_summary", "aggregate_by_scroll", "worst_k", "metric_gate",
    "kfold_split", "stratified_group_split", "fold_distribution", "plug_holes", "write_masks", "read_splits",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    n, problem = compare(spark, FOLDER, queries()[name], oracle_sql()[name])
    assert problem is None and n > 0


def test_entry(spark):
    assert entry(spark).count() > 0


def test_names():
    assert set(oracle_sql()) <= set(queries())
