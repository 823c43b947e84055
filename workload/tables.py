"""Inputs of the registered queries, derived by Spark from the given tables.

Each has a twin in SQL (`*_SQL`, a list of common table expressions). FIXTURES.md
describes the columns.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import (
    Sql, fingerprint, fixed2, is_document, quote, source_file, string_array, week_label,
)
from ledgerloom.operators.routing import position
from ledgerloom.rules import Rules, rules_from_dict
from ledgerloom.sources.documents import spread

RULES_PATH = str(Path(__file__).with_name("rules.json"))

# Vendor line, true vendor, true category, matcher name; the key is k % 12.
VENDORS = [
    ("OAKMERE BEE GARDEN", "Oakmere Apiary", "Colonies", "Queens"),
    ("Ferry Link", "Ferry Link", "Freight", "Ferries and carriers"),
    ("LIDWELL GLASS AND CORK", "Lidwell & Daughter", "Glassware", "Jars"),
    ("Corner Sugarhouse", "Corner Sugarhouse", "Feed", "Millers"),
    ("PADDOCK HIRE", "PADDOCK HIRE", "Meadow lease", "Meadows"),
    ("Wicker Waxworks", "Wicker Waxworks", "Wax work", "Wax"),
    ("MITE CLINIC", "MITE CLINIC", "Hive health", "Mites"),
    ("Valley Post Riders", "Valley Post Riders", "Freight", "Ferries and carriers"),
    ("Thistle Down Mill", "Thistle Down Mill", "Feed", "Millers"),
    ("Harrow and Pine", "Harrow and Pine", "Uncategorized", None),
    ("LANTERN MARKET STALL", "Lantern Market Hall", "Meadow lease", "Stalls"),
    ("Copper Finch Tools", "Copper Finch Tools", "Uncategorized", None),
]
HEADERS = ["CUSTOMER: Customer #", "THANK YOU", "*****", "VISA"]
TOTALS = ["TOTAL: $", "Grand Total ", "Amount due: $ ", "Charged $"]
SUFFIXES = [".jpg", ".PDF", ".png", ".txt"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For queries that do much work per row: small tables are spread over the cores."""
    return spread(load(spark, sf_dir, name))


def rules() -> Rules:
    """The workload's rules; the file is small and the same for every session."""
    return rules_from_dict(json.loads(Path(RULES_PATH).read_text(encoding="utf-8")))


def _pick(values: list[str | None], n: int) -> Sql:
    return f"{string_array(values)}[CAST(k % {n} AS INT)]"


def receipts_from_orders(orders: DataFrame) -> DataFrame:
    """One receipt text per order, and a second copy of every twentieth. A map: no shuffle."""
    date_text = """CASE
        WHEN k % 50 = 24 THEN concat(year(d), '-13-40')
        WHEN k % 5 = 0 THEN date_format(d, 'yyyy-MM-dd')
        WHEN k % 5 = 1 THEN date_format(d, 'yyyy/M/d')
        WHEN k % 5 = 2 THEN date_format(d, 'MM/dd/yyyy')
        WHEN k % 5 = 3 THEN date_format(d, 'MMMM d, yyyy')
        WHEN dayofmonth(d) > 12 THEN date_format(d, 'dd-MM-yyyy')
        ELSE date_format(d, 'MM-dd-yyyy') END"""
    text = f"""concat_ws('\\n',
        IF(k % 4 = 0, concat('{HEADERS[0]}', k), {_pick(HEADERS, 4)}),
        {_pick([v[0] for v in VENDORS], 12)},
        '12 Main Street Suite 4',
        IF(k % 50 <> 49, concat('Date: ', {date_text}), NULL),
        concat(1 + k % 3, ' x ', p),
        concat('1 x status ', s),
        IF(k % 40 = 7, concat('TOTAL ', {fixed2('a')}), concat({_pick(TOTALS, 4)}, format_number(a, 2))),
        IF(copy = 1, 'COPY', NULL))"""
    padded = "lpad(CAST(k AS STRING), 10, '0')"
    name = f"IF(copy = 1, concat('s', {padded}, '.pdf'), concat('r', {padded}, {_pick(SUFFIXES, 4)}))"
    shifted = "date_add(d, IF(copy = 1 AND k % 40 <> 0, 7, 0))"
    return (
        orders.selectExpr(
            "o_orderkey AS k", "CAST(o_orderdate AS DATE) AS d", "o_totalprice AS a",
            "o_orderpriority AS p", "o_orderstatus AS s",
            "explode(IF(o_orderkey % 20 = 0, array(0, 1), array(0))) AS copy")
        .selectExpr(
            "k", "copy", f"{name} AS file_name", "IF(k % 10 = 3, 'processed', 'incoming') AS origin",
            f"{week_label(shifted)} AS week_id", f"{text} AS text",
            "CASE WHEN k % 50 NOT IN (24, 49) THEN date_format(d, 'yyyy-MM-dd') END AS true_date",
            "IF(k % 40 = 7, CAST(left(CAST(CAST(floor(a) AS BIGINT) AS STRING), 3) AS DOUBLE), a) AS true_amount",
            f"{_pick([v[1] for v in VENDORS], 12)} AS true_vendor",
            f"{_pick([v[2] for v in VENDORS], 12)} AS true_category",
            f"{_pick([v[3] for v in VENDORS], 12)} AS true_matcher")
        .selectExpr("*", "sha1(text) AS sha1", f"{position('file_name', 'origin', quote(''))} AS seq")
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts_from_orders(load_spread(spark, sf_dir, "orders"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with the true values, of the receipts that are documents."""
    return receipts(spark, sf_dir).filter(is_document("file_name")).selectExpr(
        "k", "copy", "week_id", "file_name", "origin", "seq", "true_date AS date", "true_vendor AS vendor",
        "true_amount AS amount", "true_category AS category", "true_matcher AS matcher", "'' AS notes",
        f"{source_file('file_name')} AS source_file", "sha1",
    )


def raw_answers(rows: DataFrame) -> DataFrame:
    """(k, copy, file_hash, response): seven kinds of model response, by k % 7."""
    body = """to_json(named_struct('vendor', concat(true_vendor, ' Ltd'), 'date', '2002-02-02',
        'category', IF(k % 7 = 6, upper(true_category), true_category),
        'confidence', IF(k % 7 = 2, 0.2D, 0.95D), 'reasoning', 'read from the header'))"""
    response = f"""CASE k % 7
        WHEN 1 THEN concat('```json\\n', {body}, '\\n```')
        WHEN 3 THEN '{{"vendor": null, "confidence": 0.9}}'
        WHEN 4 THEN concat('{{"vendor": ', k, '}}')
        WHEN 5 THEN concat('The vendor is ', true_vendor)
        ELSE {body} END"""
    return rows.selectExpr("k", "copy", "sha1 AS file_hash", f"{response} AS response")


def cache(rows: DataFrame) -> DataFrame:
    """Cached answers of the receipts with k % 3 = 0."""
    return rows.filter("k % 3 = 0").selectExpr(
        "sha1 AS file_hash", "concat(true_vendor, ' Cached') AS vendor", "true_date AS date",
        "true_category AS category", "IF(k % 2 = 0, 0.95D, 0.2D) AS confidence", "'stored' AS reasoning",
        "TIMESTAMP '2024-01-01 00:00:00' AS cached_at",
    )


def registered(rows: DataFrame) -> DataFrame:
    """Registry: every first copy, and the second copies with k % 60 = 0."""
    return rows.filter("copy = 0 OR k % 60 = 0").selectExpr(
        f"{fingerprint('date', 'vendor', 'amount')} AS fingerprint", "sha1 AS file_hash",
        "week_id", "date", "vendor", "amount", "source_file", "seq",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts: every fifth conversation is blank."""
    return load(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS doc", "turn AS page_no", "IF(conv_id % 5 = 0, ' \\n\\t', text) AS text")


def file_pages(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Page count per file: an order's line items stand for the pages of its first copy."""
    counted = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.expr("count(1) AS pages"))
    return rows.filter("copy = 0").select("k", "week_id", "source_file", "seq").join(counted, "k").drop("k")


def purchases_from_events(events: DataFrame) -> DataFrame:
    """Coarse purchases, so that fingerprints repeat: (event_id, ts, fingerprint, sha1)."""
    identity = fingerprint("date_format(ts, 'yyyy-MM-dd')", "CAST(user_id % 10 AS STRING)",
                           "floor(value / 5) * 5")
    return events.filter("event_type = 'purchase'").selectExpr(
        "event_id", "ts", f"{identity} AS fingerprint", "sha1(CAST(event_id AS STRING)) AS sha1")


# --- the same in SQL ----------------------------------------------------------

def _sql_list(values: list[str | None]) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return "[" + ", ".join(quoted) + "]"


def _sql_pick(values: list[str | None], n: int) -> str:
    return f"({_sql_list(values)})[1 + CAST(k % {n} AS INTEGER)]"


VENDOR_LINE_SQL = _sql_pick([v[0] for v in VENDORS], 12)

IS_DOCUMENT_SQL = "NOT ends_with(file_name, '.txt')"

RECEIPTS_SQL = f"""
base AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS a, o_orderpriority AS p,
         o_orderstatus AS s, unnest(CASE WHEN o_orderkey % 20 = 0 THEN [0, 1] ELSE [0] END) AS copy
  FROM orders),
rendered AS (
  SELECT k, copy,
    CASE WHEN copy = 1 THEN 's' || lpad(CAST(k AS VARCHAR), 10, '0') || '.pdf'
         ELSE 'r' || lpad(CAST(k AS VARCHAR), 10, '0') || {_sql_pick(SUFFIXES, 4)} END AS file_name,
    CASE WHEN k % 10 = 3 THEN 'processed' ELSE 'incoming' END AS origin,
    strftime(CASE WHEN copy = 1 AND k % 40 <> 0 THEN d + 7 ELSE d END, '%Y-W%U') AS week_id,
    concat_ws(chr(10),
      CASE WHEN k % 4 = 0 THEN '{HEADERS[0]}' || k ELSE {_sql_pick(HEADERS, 4)} END,
      {_sql_pick([v[0] for v in VENDORS], 12)},
      '12 Main Street Suite 4',
      CASE WHEN k % 50 <> 49 THEN 'Date: ' || CASE
        WHEN k % 50 = 24 THEN strftime(d, '%Y') || '-13-40'
        WHEN k % 5 = 0 THEN strftime(d, '%Y-%m-%d')
        WHEN k % 5 = 1 THEN strftime(d, '%Y/%-m/%-d')
        WHEN k % 5 = 2 THEN strftime(d, '%m/%d/%Y')
        WHEN k % 5 = 3 THEN strftime(d, '%B %-d, %Y')
        WHEN day(d) > 12 THEN strftime(d, '%d-%m-%Y')
        ELSE strftime(d, '%m-%d-%Y') END END,
      (1 + k % 3) || ' x ' || p,
      '1 x status ' || s,
      CASE WHEN k % 40 = 7 THEN 'TOTAL ' || format('{{:.2f}}', a)
           ELSE {_sql_pick(TOTALS, 4)} || format('{{:,.2f}}', a) END,
      CASE WHEN copy = 1 THEN 'COPY' END) AS text,
    CASE WHEN k % 50 NOT IN (24, 49) THEN strftime(d, '%Y-%m-%d') END AS true_date,
    CASE WHEN k % 40 = 7 THEN CAST(left(CAST(CAST(floor(a) AS BIGINT) AS VARCHAR), 3) AS DOUBLE) ELSE a END AS true_amount,
    {_sql_pick([v[1] for v in VENDORS], 12)} AS true_vendor,
    {_sql_pick([v[2] for v in VENDORS], 12)} AS true_category,
    {_sql_pick([v[3] for v in VENDORS], 12)} AS true_matcher
  FROM base),
receipts AS (SELECT *, sha1(text) AS sha1, CASE WHEN origin = 'incoming' THEN 0 ELSE 1 END AS origin_rank FROM rendered)"""

LEDGER_SQL = RECEIPTS_SQL + f""",
ledger AS (
  SELECT k, copy, week_id, file_name, origin, origin_rank, true_date AS date, true_vendor AS vendor,
         true_amount AS amount, true_category AS category, true_matcher AS matcher, '' AS notes,
         regexp_replace(file_name, '\\.[^.]*$', '') || '.pdf' AS source_file, sha1
  FROM receipts WHERE {IS_DOCUMENT_SQL})"""

FINGERPRINT_SQL = ("sha256(coalesce(date, '') || '|' || lower(trim(coalesce(vendor, ''))) || '|' || "
                   "coalesce(format('{:.2f}', amount), ''))")

MARKED_SQL = LEDGER_SQL + f""",
marked AS (SELECT *, {FINGERPRINT_SQL} AS fingerprint FROM ledger),
registry AS (SELECT * FROM marked WHERE copy = 0 OR k % 60 = 0)"""

CACHE_SQL = RECEIPTS_SQL + """,
cache AS (
  SELECT sha1 AS file_hash, true_vendor || ' Cached' AS vendor, true_date AS date, true_category AS category,
         CASE WHEN k % 2 = 0 THEN 0.95 ELSE 0.2 END::DOUBLE AS confidence
  FROM receipts WHERE k % 3 = 0)"""

PAGES_SQL = """
pages_text AS (
  SELECT conv_id AS doc, turn AS page_no, CASE WHEN conv_id % 5 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END AS text
  FROM conversations)"""

PURCHASES_SQL = """
purchases AS (
  SELECT event_id, ts, sha1(CAST(event_id AS VARCHAR)) AS sha1,
         sha256(strftime(ts, '%Y-%m-%d') || '|' || (user_id % 10) || '|' || format('{:.2f}', floor(value / 5) * 5)) AS fingerprint
  FROM events WHERE event_type = 'purchase')"""


__all__ = [
    "CACHE_SQL", "FINGERPRINT_SQL", "LEDGER_SQL", "MARKED_SQL", "PAGES_SQL", "PURCHASES_SQL",
    "RECEIPTS_SQL", "RULES_PATH", "VENDOR_LINE_SQL", "cache", "file_pages", "ledger", "load", "load_spread", "pages",
    "purchases_from_events", "raw_answers", "receipts", "receipts_from_orders", "registered",
    "rules",
]
