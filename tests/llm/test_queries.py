"""Every query of the training-data problems over the smallest tables; those with SQL against it."""

import pytest

from quireflow.llm.queries import CATALOG
from tests.oracle import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(spark, name):
    found = CATALOG.queries[name](spark, SF).toPandas()
    if name in CATALOG.sql:
        assert rows(found) == rows(duck(SF).sql(CATALOG.sql[name]).df())
    if name.endswith("_found"):
        assert not found.duplicated().any() and not found.isna().any().any()


def test_found_columns(spark):
    wanted = {
        "p1_found": [("rec", "string"), ("row_id", "bigint")], "p2_found": [("rec", "string"), ("row_id", "bigint")], "p3_found": [("row_id", "bigint")],
        "p4_found": [("query_a", "string"), ("query_b", "string")], "p5_found": [("chunk_id", "string")], "p6_found": [("vec_a", "bigint"), ("vec_b", "bigint")],
        "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p9_found": [("doc_id", "bigint")],
    }
    for name, columns in wanted.items():
        assert CATALOG.queries[name](spark, SF).dtypes == columns
