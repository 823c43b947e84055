"""Totals, line items, pages and the CSV export."""

import pytest

from ledgerloom.operators import listing, totals
from ledgerloom.sources.csv import read_csv, write_csv

LEDGER = "week_id string, seq string, date string, vendor string, amount double, category string, source_file string"


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def _ledger(spark, rows):
    return spark.createDataFrame(rows, LEDGER)


@pytest.fixture(scope="module")
def small(spark):
    return _ledger(spark, [
        ("w", "1", "2024-02-03", "B", 0.1, "Meals", "1.pdf"),
        ("w", "2", "2024-02-03", "A", 0.2, "", "2.pdf"),
        ("w", "3", None, "C", None, None, "3.pdf"),
        ("w", "4", "2024-01-09", None, 7.0, "Meals", "4.pdf"),
        ("w", "5", "2024", "D" * 40, 1000.0, "A very long category name", "1.pdf"),
    ])


def test_totals(small):
    assert [tuple(r) for r in totals.category_totals(small).collect()] == [
        ("A very long category name", 1000.0, 1, 0), ("Meals", 7.1, 2, 0), ("Uncategorized", 0.2, 2, 0)]
    assert [tuple(r) for r in totals.month_totals(small).select("month", "total", "caption", "shown").collect()] == [
        ("2024-01", 7.0, "January 2024", "$7.00"), ("2024-02", 0.3, "February 2024", "$0.30"),
        ("Unknown", 1000.0, "Unknown", "$1,000.00")]
    both = rows_of(totals.summary(small), "kind", "name", "total")
    assert len(both) == 6 and ("month", "2024-02", 0.3) in both and ("category", "Meals", 7.1) in both


def test_amounts_beyond_any_decimal(spark):
    rows = _ledger(spark, [("w", str(n), "2024-01-01", "A", a, "Meals", "f") for n, a in enumerate(
        [1.25, 2.0 ** 100, 2.0 ** 100, 1e17, 0.5])])
    assert [tuple(r) for r in totals.category_totals(rows).collect()] == [("Meals", 2.0 ** 101 + (1e17 + 1.75), 5, 2)]
    endless = rows.unionByName(_ledger(spark, [("w", "9", None, "A", float("inf"), "Hotel", "f"), ("w", "9", None, "A", float("nan"), "Odd", "f")]))
    assert [r.total for r in totals.summary(endless).where("name = 'Hotel'").collect()] == [float("inf")]
    assert [r.n_inexact for r in totals.month_totals(endless).where("month = 'Unknown'").collect()] == [2]


def test_line_items(small):
    got = rows_of(listing.line_items(small), "month", "item", "date", "shown_vendor", "shown_category", "shown_amount")
    assert got == [
        ("2024-01", 1, "2024-01-09", "", "Meals", "$7.00"),
        ("2024-02", 1, "2024-02-03", "A", "", "$0.20"),
        ("2024-02", 2, "2024-02-03", "B", "Meals", "$0.10"),
        ("Unknown", 1, "", "C", "", ""),
        ("Unknown", 2, "2024", "D" * 28, "A very long catego", "$1,000.00"),
    ]


@pytest.mark.parametrize("n, pages", [(1, 1), (46, 1), (47, 2), (48, 2), (96, 2), (97, 3), (147, 4)])
def test_pages_of_a_month(spark, n, pages):
    df = spark.createDataFrame([(n,)], "n bigint").selectExpr(listing.pages_of_month("n"))
    assert df.first()[0] == pages


def test_list_page_of_an_item(spark):
    df = spark.range(1, 150).selectExpr("id", f"{listing.list_page_of('id')} AS page")
    first = {}
    for item, page in df.orderBy("id").collect():
        first.setdefault(page, item)
    assert first == {0: 1, 1: 48, 2: 98, 3: 148}


@pytest.mark.parametrize("rows_per_task", [1_000, 2])
def test_manifest_and_links(spark, small, rows_per_task):
    pages = spark.createDataFrame(
        [("w", "1.pdf", 3, "1"), ("w", "1.pdf", 9, "2"), ("w", "2.pdf", 2, "1"), ("w", "4.pdf", 1, "1")],
        "week_id string, source_file string, pages int, seq string")
    manifest = listing.package_manifest(small, pages, 1, rows_per_task)
    # 1 title page and 3 months; by date, then vendor; the file of receipt 3 is missing.
    assert rows_of(manifest, "start_page", "seq", "pages") == [(10, "1", 3), (4, "5", 3), (7, "4", 1), (8, "2", 2)]
    links = listing.link_table(listing.line_items(small, rows_per_task), listing.list_pages(small), manifest)
    assert rows_of(links, "source_file", "list_page", "target_page") == [
        ("1.pdf", 2, 10), ("1.pdf", 3, 10), ("2.pdf", 2, 8), ("4.pdf", 1, 7)]


def test_collisions_and_quality(spark, small):
    assert rows_of(totals.name_collisions(small), "source_file", "n_files") == [("1.pdf", 2)]
    marked = small.selectExpr("*", "IF(date IS NULL, NULL, 'regex') AS date_source")
    assert rows_of(totals.quality(marked), "date_source", "n_rows", "no_date", "no_vendor", "no_amount") == [
        ("none", 1, 1, 0, 1), ("regex", 4, 0, 1, 0)]


def test_csv_keeps_every_character(spark, tmp_path):
    rows = [("w 1", "1", None, ' a "b", c\\ ', 0.1, "x\ny", "s.pdf"), ("w 2", "2", "2024-01-01", "é", None, None, "t.pdf")]
    ledger = _ledger(spark, rows).selectExpr("*", "'m' AS matcher", "CAST(NULL AS STRING) AS notes", "sha1(seq) AS sha1")
    path = str(tmp_path / "csv")
    write_csv(ledger, path)
    shown = ["week_id", "date", "vendor", "amount", "category", "notes", "source_file", "sha1"]
    assert rows_of(read_csv(spark, path), *shown) == rows_of(ledger, *shown)
    text = next((tmp_path / "csv" / "week_id=w 1").glob("*.csv")).read_text(encoding="utf-8")
    assert text.splitlines()[0] == "date,vendor,amount,category,matcher,notes,source_file,sha1"
    assert ',' + '" a ""b"", c\\ "' + ',0.1,' in text
