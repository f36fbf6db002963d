"""Registered queries against their SQL; all of them with NEARFOLD_ALL_QUERIES=1."""

import os

import pytest

from checks import registry
from checks.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
# One of each kind; the whole list takes some minutes.
SOME = [
    "knn_pad_to_k", "knn_dense_cosine", "doc_vectors", "score_run", "title_fuzzy_match",
    "stratified_sample", "quality_report", "assemble_records", "scan_typed_csv", "record_size_bytes",
]
NAMES = sorted(registry()) if os.environ.get("NEARFOLD_ALL_QUERIES") else SOME


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    query, oracle = registry()[name]
    got = query(spark, FOLDER).toPandas()
    assert len(got) > 0 or oracle is not None
    if oracle is not None:
        assert differences(got, connect(FOLDER).execute(oracle).df()) == ""


def test_every_query_has_sql_or_a_reason():
    without = {name for name, (_, sql) in registry().items() if sql is None}
    # Whole jobs.
    assert without == {"publish_run", "rollback_run"}
