import os

import pytest

from lodestack.llm import queries as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="the test tables are not here")


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_runs(spark, name):
    df = Q.QUERIES[name](spark, FOLDER)
    assert len(df.collect()) >= 0


def test_columns(spark):
    want = {
        "p2_found": [("facility_id", "string"), ("county_fips", "string")],
        "p4_found": [("fiscal_year", "string"), ("condition", "string"), ("peer_group", "bigint")],
        "p7_found": [("group_id", "string")],
        "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p10_found": [("doc_id", "bigint"), ("lang", "string")],
    }
    for name, types in want.items():
        assert Q.QUERIES[name](spark, FOLDER).dtypes == types
