"""Queries on totals, line items and packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import listing, totals
from ledgerloom.plans.weekly import extract
from ledgerloom.sources.csv import read_csv, write_csv
from ledgerloom.sources.documents import keep_documents
from workload import tables as T
from workload.scratch import new_folder
from workload.model_answers import resolved


def _from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(keep_documents(T.receipts(spark, sf_dir)), T.rules())


def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.category_totals(T.ledger(spark, sf_dir))


def month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.month_totals(T.ledger(spark, sf_dir))


def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.summary(T.ledger(spark, sf_dir))


def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: texts to category and month totals in one job."""
    return totals.summary(_from_text(spark, sf_dir))


def totals_with_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over amounts that exceed any decimal, or are infinite, here and there."""
    amount = _OUTLIERS.format(k="k", big="pow(2D, 100D)", large="pow(2D, 57D)", inf="CAST('Infinity' AS DOUBLE)")
    return totals.summary(T.ledger(spark, sf_dir).withColumn("amount", F.expr(amount)))


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.origin_counts(keep_documents(T.receipts(spark, sf_dir)))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.quality(resolved(spark, sf_dir))


def quality_report_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on rows of which some lack vendor, amount or date."""
    return totals.quality(T.ledger(spark, sf_dir).withColumns({
        "vendor": F.expr("CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN '' ELSE vendor END"),
        "amount": F.expr("CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 0D ELSE amount END"),
        "date_source": F.expr("IF(date IS NULL, NULL, 'regex')")}))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.line_items(T.ledger(spark, sf_dir)).drop("seq")


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per year and month, so that months are long enough to break."""
    return listing.list_pages(_by_year(spark, sf_dir))


def _by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ledger(spark, sf_dir).withColumn("week_id", F.substring("week_id", 1, 4))


def package_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_year(spark, sf_dir)
    return listing.package_manifest(rows, T.file_pages(spark, sf_dir, rows)).drop("seq")


def link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_year(spark, sf_dir)
    manifest = listing.package_manifest(rows, T.file_pages(spark, sf_dir, rows))
    return listing.link_table(listing.line_items(rows), listing.list_pages(rows), manifest)


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows, with quotes, commas and line breaks in the notes, through the CSV export."""
    notes = """concat('say "', vendor, '", line\\nbreak, ', file_name)"""
    path = new_folder(spark, "csv")
    write_csv(_by_year(spark, sf_dir).withColumn("notes", F.expr(notes)), path)
    return read_csv(spark, path)


def csv_two_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two exports of different weeks to one folder, the first of them done twice."""
    rows, path = _by_year(spark, sf_dir), new_folder(spark, "csv")
    odd = F.col("week_id").cast("int") % 2 == 1
    write_csv(rows.filter(odd).withColumn("notes", F.lit("old")), path)
    write_csv(rows.filter(~odd), path)
    write_csv(rows.filter(odd).withColumn("notes", F.lit("new")), path)
    return read_csv(spark, path).selectExpr("week_id", "sha1", "source_file", "coalesce(notes, '') AS notes")


QUERIES = {
    "text_summary": text_summary,
    "category_totals": category_totals,
    "month_totals": month_totals,
    "summary_grouping_sets": summary_grouping_sets,
    "totals_with_outliers": totals_with_outliers,
    "batch_counts": batch_counts,
    "quality_report": quality_report,
    "quality_report_gaps": quality_report_gaps,
    "line_items": line_items,
    "list_pages": list_pages,
    "package_manifest": package_manifest,
    "link_table": link_table,
    "csv_roundtrip": csv_roundtrip,
    "csv_two_weeks": csv_two_weeks,
}

_MONTH = "CASE WHEN length(date) >= 7 THEN left(date, 7) ELSE 'Unknown' END"
_CAPTION = "CASE WHEN month = 'Unknown' THEN month ELSE strftime(CAST(month || '-01' AS DATE), '%B %Y') END"
_BEYOND = "abs(coalesce(amount, 0)) >= 1e26"
_TOTAL = f"""coalesce(CAST(sum(CASE WHEN {_BEYOND} THEN NULL ELSE CAST(coalesce(amount, 0) AS DECIMAL(28, 2)) END) AS DOUBLE), 0)
    + coalesce(sum(CASE WHEN {_BEYOND} THEN amount END), 0)"""
_INEXACT = f"CAST(count(*) FILTER ({_BEYOND}) AS BIGINT)"


def _summary_sql(table: str) -> str:
    return f"""
    SELECT 'category' AS kind, category AS name, {_TOTAL} AS total, count(*) AS n_rows, {_INEXACT} AS n_inexact FROM {table} GROUP BY category
    UNION ALL
    SELECT 'month', {_MONTH}, {_TOTAL}, count(*), {_INEXACT} FROM {table} GROUP BY {_MONTH}"""


# Powers of two, so that their sums are exact in any order.
_OUTLIERS = "CASE WHEN {k} % 1000 = 1 THEN {big} WHEN {k} % 500 = 2 THEN {large} WHEN category = 'Wax work' AND {k} % 100 = 5 THEN {inf} ELSE amount END"


def _numbered(week: str) -> str:
    return T.LEDGER_SQL + f""",
numbered AS (
  SELECT {week} AS week_id, {_MONTH} AS month, coalesce(date, '') AS date, vendor, category, amount, source_file, k, copy,
         row_number() OVER (PARTITION BY {week}, {_MONTH} ORDER BY coalesce(date, ''), coalesce(vendor, ''), file_name, origin_rank) AS item,
         row_number() OVER (PARTITION BY {week} ORDER BY coalesce(date, ''), coalesce(vendor, ''), file_name, origin_rank) AS place
  FROM ledger),
months AS (
  SELECT *, 1 + coalesce(sum(pages) OVER (PARTITION BY week_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_page
  FROM (SELECT week_id, month, count(*) AS n_items,
               1 + CASE WHEN count(*) >= 47 THEN 1 + (count(*) - 47) // 50 ELSE 0 END AS pages FROM numbered GROUP BY week_id, month)),
placed AS (
  SELECT n.*, f.pages AS file_pages,
         (SELECT 1 + sum(m.pages) FROM months m WHERE m.week_id = n.week_id)
         + coalesce(sum(f.pages) OVER (PARTITION BY n.week_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_page
  FROM numbered n JOIN (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY l_orderkey) f ON f.l_orderkey = n.k AND n.copy = 0)"""


_YEAR = "left(week_id, 4)"
_PAGE = "CASE WHEN item <= 47 THEN 0 ELSE 1 + (item - 48) // 50 END"

ORACLES = {
    "text_summary": f"WITH {T.LEDGER_SQL} {_summary_sql('ledger')}",
    "category_totals": f"WITH {T.LEDGER_SQL} SELECT category, {_TOTAL} AS total, count(*) AS n_rows, {_INEXACT} AS n_inexact FROM ledger GROUP BY category",
    "month_totals": f"""WITH {T.LEDGER_SQL}, sums AS (SELECT {_MONTH} AS month, {_TOTAL} AS total, count(*) AS n_rows, {_INEXACT} AS n_inexact FROM ledger GROUP BY 1)
        SELECT month, total, n_rows, n_inexact, {_CAPTION} AS caption, '$' || format('{{:,.2f}}', total) AS shown FROM sums""",
    "totals_with_outliers": f"""WITH {T.LEDGER_SQL}, outliers AS (SELECT * EXCLUDE (amount), {_OUTLIERS.format(
        k='k', big='pow(2.0, 100)', large='pow(2.0, 57)', inf="CAST('inf' AS DOUBLE)")} AS amount FROM ledger) {_summary_sql('outliers')}""",
    "summary_grouping_sets": f"WITH {T.LEDGER_SQL} {_summary_sql('ledger')}",
    "batch_counts": f"WITH {T.LEDGER_SQL} SELECT week_id, origin, count(*) AS n_files FROM ledger GROUP BY ALL",
    "quality_report": f"""WITH {T.LEDGER_SQL},
        judged AS (SELECT week_id, CASE WHEN k % 3 = 0 THEN CASE WHEN date IS NULL THEN 'none' WHEN k % 2 = 0 THEN 'model' ELSE 'regex' END
                   WHEN k % 7 IN (0, 1, 6) THEN 'model' WHEN date IS NULL THEN 'none' ELSE 'regex' END AS date_source FROM ledger)
        SELECT week_id, date_source, count(*) AS n_rows, CAST(count_if(date_source = 'none') AS BIGINT) AS no_date,
               CAST(0 AS BIGINT) AS no_vendor, CAST(0 AS BIGINT) AS no_amount FROM judged GROUP BY ALL""",
    "quality_report_gaps": f"""WITH {T.LEDGER_SQL} SELECT week_id, CASE WHEN date IS NULL THEN 'none' ELSE 'regex' END AS date_source, count(*) AS n_rows,
        count(*) FILTER (date IS NULL) AS no_date, count(*) FILTER (k % 11 = 0 OR k % 13 = 0) AS no_vendor,
        count(*) FILTER (k % 17 = 0 OR k % 19 = 0) AS no_amount FROM ledger GROUP BY ALL""",
    "line_items": f"""WITH {_numbered('week_id')} SELECT week_id, month, item, {_PAGE} AS page_in_month, date, vendor, category,
        left(vendor, 28) AS shown_vendor, left(category, 18) AS shown_category, '$' || format('{{:,.2f}}', amount) AS shown_amount, source_file
        FROM numbered""",
    "list_pages": f"""WITH {_numbered(_YEAR)} SELECT week_id, month, {_CAPTION} AS caption, n_items, pages, CAST(first_page AS BIGINT) AS first_page FROM months""",
    "package_manifest": f"""WITH {_numbered(_YEAR)} SELECT week_id, source_file, nullif(date, '') AS date, vendor, file_pages AS pages,
        CAST(start_page AS BIGINT) AS start_page FROM placed""",
    "link_table": f"""WITH {_numbered(_YEAR)},
        targets AS (SELECT week_id, source_file, max(start_page) AS target_page FROM placed GROUP BY ALL)
        SELECT n.week_id, n.month, n.item, n.source_file, CAST(m.first_page + {_PAGE} AS BIGINT) AS list_page, CAST(t.target_page AS BIGINT) AS target_page
        FROM numbered n JOIN months m USING (week_id, month) JOIN targets t USING (week_id, source_file)""",
    "csv_two_weeks": f"""WITH {T.LEDGER_SQL} SELECT left(week_id, 4) AS week_id, sha1, source_file,
        CASE WHEN CAST(left(week_id, 4) AS INTEGER) % 2 = 1 THEN 'new' ELSE '' END AS notes FROM ledger""",
    "csv_roundtrip": f"""WITH {T.LEDGER_SQL} SELECT date, vendor, amount, category, matcher,
        'say "' || vendor || '", line' || chr(10) || 'break, ' || file_name AS notes, source_file, sha1, left(week_id, 4) AS week_id FROM ledger""",
}
