"""The sliced scan gives what a plain window gives, also with a group that holds a third of all rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import ordered
from ledgerloom.operators.ordered import Ordering


@pytest.fixture(scope="module")
def rows(spark):
    # Group 'hot' has a third of the rows, NULL is a group too, order values are shuffled.
    return spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 30 = 1 THEN NULL ELSE concat('g', id % 40) END AS g",
        "CASE WHEN id % 6 = 0 THEN NULL ELSE hash(id) % 7 END AS a", "concat('s', id) AS seq",
        "id % 5 AS v").cache()


BY = {"plain": Ordering(("g",), ("a", "seq")), "sliced": Ordering(("g",), ("a", "seq"), 90)}


def test_slices_are_used_and_balanced(rows):
    assert ordered.sliced(rows, BY["plain"]) is None
    sizes = ordered.sliced(rows, BY["sliced"]).filter("g = 'hot'").groupBy("__slice").count().collect()
    assert len(sizes) > 6 and max(r["count"] for r in sizes) < 400


@pytest.mark.parametrize("kind", ["plain", "sliced"])
def test_row_number(rows, kind):
    window = Window.partitionBy("g").orderBy("a", "seq")
    want = rows.withColumn("n", F.row_number().over(window).cast("long"))
    got = ordered.with_row_number(rows, BY[kind], "n")
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


@pytest.mark.parametrize("kind", ["plain", "sliced"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sum(rows, kind, inclusive):
    frame = Window.partitionBy("g").orderBy("a", "seq").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumn("n", F.coalesce(F.sum("v").over(frame), F.lit(0)))
    got = ordered.with_running_sum(rows, BY[kind], "v", "n", inclusive)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


@pytest.mark.parametrize("kind", ["plain", "sliced"])
def test_previous(rows, kind):
    window = Window.partitionBy("g").orderBy("a", "seq")
    want = rows.withColumn("p", F.lag(F.struct("seq", "v")).over(window))
    got = ordered.with_previous(rows, BY[kind], ["seq", "v"], "p")
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_estimated_sizes(rows, monkeypatch):
    monkeypatch.setattr(ordered, "SAMPLE_PER_GROUP", 150)
    by = Ordering(("g",), ("a", "seq"), 600)
    keyed, slices = ordered.large_groups(rows, by)
    assert [r["__group_g"] for r in keyed.collect()] == ["hot"] and slices == 2
    got = ordered.with_previous(rows, by, ["seq"], "p")
    want = rows.withColumn("p", F.lag(F.struct("seq")).over(Window.partitionBy("g").orderBy("a", "seq")))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_many_large_groups_stay_within_the_slice_bound(rows, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_SLICES", 10)
    got = ordered.with_row_number(rows, Ordering(("g",), ("a", "seq"), 5), "n")
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("a", "seq")).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == 3000
