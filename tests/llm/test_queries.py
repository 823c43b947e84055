"""The registered queries against their SQL twins."""

import pytest

from ledgerloom.llm import queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    verdict, _, n = compare(spark, duck(SF), name, SF)
    assert verdict == "same" and n > 0


@pytest.mark.parametrize("name", ["op7_language_id", "op8_token_ids", "op9_simhash"])
def test_one_row_per_document(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert found.count() == found.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()
