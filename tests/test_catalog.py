"""Every registered query against its SQL twin, and the shape of the plans."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ledgerloom.operators import extract
from ledgerloom.operators.answers import disabled_answer, resolve
from tests.compare import compare, duck
from workload import catalog
from workload import tables as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    verdict, _, n = compare(spark, con, name, SF)
    assert verdict == "same" and n > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(catalog.QUERIES) <= set(queries()) and set(catalog.ORACLES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_is_one_narrow_stage(spark):
    docs = T.load(spark, SF, "documents").selectExpr("text", f"{disabled_answer()} AS answer")
    plan = plan_of(resolve(docs, T.rules()))
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<text:string>" in plan


def test_scan_reads_only_what_is_needed(spark):
    docs = T.load(spark, SF, "documents").filter("lang = 'en'")
    plan = plan_of(docs.selectExpr(f"{extract.amount_of('text')} AS amount"))
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "EqualTo(lang,en)" in plan


def test_one_row_per_key_is_limited_before_the_shuffle(spark):
    plan = plan_of(queries()["registry_upsert"](spark, SF))
    before = plan.split("Exchange")[1]
    assert "WindowGroupLimit" in before and "Partial" in before


def test_totals_are_combined_before_the_shuffle(spark):
    plan = plan_of(queries()["summary_grouping_sets"](spark, SF))
    # Rows are summed by category and month where they are read; only that small table is doubled and shuffled again.
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.index("Expand") < plan.rindex("Exchange hashpartitioning") < plan.rindex("partial_sum")
