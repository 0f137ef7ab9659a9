"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from checks import catalog, compare

FOLDER = os.environ.get("CHECK_DIR", "/root/testdata/sf0.001")
# The rest run with CHECK_ALL=1, or with ``python -m checks.compare``.
HEADLINE = [
    "s05_standardize_base", "s06_extract_links", "s12_board_a_postings", "s13_board_b_postings", "s18_label_upsert",
    "p03_label_provenance", "j01_history_join", "a05_crosstab_margins", "a12_classification_report", "w01_history_page",
    "w02_annotation_shuffle", "t03_clean_keep_lines", "t26_parse_notes", "f18_extract_features", "m01_group_stratified_split",
    "m06_cv_results", "m19_score_postings", "m20_build_dataset", "m21_build_annotation_batch", "m22_evaluate", "st1_score_stream",
]


@pytest.fixture(scope="module")
def database():
    return compare.database(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES) if os.environ.get("CHECK_ALL") else HEADLINE)
def test_query_equals_its_sql(spark, database, name):
    assert compare.compare(spark, database, name, FOLDER) is None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_contributions_add_up(spark):
    assert all(r["adds_up"] for r in catalog.QUERIES["m13_tree_shap"](spark, FOLDER).collect())


def test_every_sql_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
