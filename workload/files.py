"""Queries on files: scanning, hashing, ordering, routing, page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.functions.text import extension, slug, source_file
from ledgerloom.operators import routing, totals
from ledgerloom.sources import documents
from workload import tables as T
from workload.scratch import new_folder, write_files


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.keep_documents(T.receipts(spark, sf_dir)).select(
        "week_id", "file_name", "origin", "sha1")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load(spark, sf_dir, "documents").selectExpr("doc_id", f"{documents.content_hash('text')} AS sha1")


def scan_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as one file each, scanned, then scanned again after every tenth one has come and every seventh has gone from another folder."""
    root = new_folder(spark, "files")
    docs = T.load_spread(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(text, '') AS text")

    def put(part: DataFrame, folder: str) -> None:
        write_files(part, "doc_id", "text", "\x00", f"{root}/{folder}")

    put(docs.filter("doc_id % 10 <> 0"), "stay")
    put(docs.filter("doc_id % 7 = 0"), "go")
    seen = documents.manifest(spark, root)
    documents.scan_changes(spark, [f"{root}/stay", f"{root}/go"], seen, "first", recursive=True)
    put(docs.filter("doc_id % 10 = 0"), "stay")
    found = documents.scan_changes(spark, [f"{root}/stay"], seen, "second", recursive=True)
    return found.selectExpr("CAST(regexp_extract(path, 'doc_id=([0-9]+)', 1) AS BIGINT) AS doc_id", "contains(path, '/stay/') AS stays", "sha1", "change")


def assemble_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.assemble_pages(T.load(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def has_text_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.has_text_layer(T.pages(spark, sf_dir), "doc", "text")


def union_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.receipts(spark, sf_dir)
    kept = ["week_id", "file_name", "sha1"]
    incoming = rows.filter("origin = 'incoming'").select(*kept)
    processed = rows.filter("origin = 'processed'").select(*kept)
    return routing.union_origins(incoming, processed)


def processing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents.keep_documents(T.receipts(spark, sf_dir)).select("week_id", "file_name", "origin", "seq")
    return routing.processing_order(files).drop("seq")


def source_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.receipts(spark, sf_dir).selectExpr("file_name", f"{source_file('file_name')} AS source_file")


def _shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows by year whose names repeat: three orders share one."""
    name = f"concat('scan', k DIV 3, {extension('file_name')})"
    folder = f"IF(k % 20 = 3, 'old-folder', {slug('category')})"
    return T.ledger(spark, sf_dir).selectExpr(
        "k", "left(week_id, 4) AS week_id", f"{name} AS file_name", "category", "sha1", "origin", "seq",
        f"IF(origin = 'processed', {folder}, NULL) AS folder",
        f"{source_file(name)} AS source_file")


def routing_plan_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and hashes that repeat very often, and a numbered name that is taken: every target is one of a kind."""
    rows = T.ledger(spark, sf_dir).selectExpr(
        "k", "copy", "left(week_id, 4) AS week_id", "concat('scan', k % 5, '.jpg') AS file_name", "category", "sha1(CAST(k % 11 AS STRING)) AS sha1",
        "'incoming' AS origin", "seq", "CAST(NULL AS STRING) AS folder")
    occupied = rows.selectExpr("week_id", f"{slug('category')} AS category_slug",
                               "concat('scan0_', substring(sha1('0'), 1, 8), '_3.jpg') AS file_name").distinct()
    plan = routing.routing_plan(rows, occupied)
    return plan.join(rows.select("k", "copy", "week_id", "seq"), ["week_id", "seq"]).select("k", "copy", "category_slug", "target_name")


def source_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals.name_collisions(_shared_names(spark, sf_dir))


def routing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared_names(spark, sf_dir)
    occupied = rows.filter("k % 7 = 0").selectExpr(
        "week_id", f"{slug('category')} AS category_slug", "file_name")
    plan = routing.routing_plan(rows, occupied)
    return plan.select("week_id", "category_slug", "file_name", "action", "target_name")


def undo_restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _shared_names(spark, sf_dir)
    plan = routing.undo_plan(rows, rows.filter("k % 5 = 0"))
    return plan.select("week_id", "file_name", "action")


_SHARED_SQL = T.LEDGER_SQL + """,
shared AS (
  SELECT k, copy, left(week_id, 4) AS week_id, origin, file_name AS old_name, origin_rank,
         'scan' || CAST(k // 3 AS VARCHAR) || regexp_extract(file_name, '\\.[^.]*$') AS file_name,
         trim(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '-') AS category_slug,
         CASE WHEN origin = 'processed' THEN CASE WHEN k % 20 = 3 THEN 'old-folder'
              ELSE trim(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '-') END END AS folder, sha1
  FROM ledger)"""

QUERIES = {
    "scan_documents": scan_documents,
    "content_hash": content_hash,
    "assemble_pages": assemble_pages,
    "has_text_layer": has_text_layer,
    "union_origins": union_origins,
    "processing_order": processing_order,
    "source_file_name": source_file_name,
    "source_name_collisions": source_name_collisions,
    "scan_manifest": scan_manifest,
    "routing_plan": routing_plan,
    "routing_plan_clashes": routing_plan_clashes,
    "undo_restore_plan": undo_restore_plan,
}

ORACLES = {
    "scan_documents": f"WITH {T.RECEIPTS_SQL} SELECT week_id, file_name, origin, sha1 FROM receipts WHERE {T.IS_DOCUMENT_SQL}",
    "content_hash": "SELECT doc_id, sha1(text) AS sha1 FROM documents",
    "assemble_pages": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations GROUP BY conv_id",
    "has_text_layer": f"WITH {T.PAGES_SQL} SELECT doc, bool_or(length(trim(text, ' ' || chr(10) || chr(9))) > 0) AS has_text FROM pages_text GROUP BY doc",
    "union_origins": f"""WITH {T.RECEIPTS_SQL}
        SELECT week_id, file_name, sha1, 'incoming' AS origin FROM receipts WHERE origin = 'incoming' AND {T.IS_DOCUMENT_SQL}
        UNION ALL
        SELECT week_id, file_name, sha1, 'processed' FROM receipts WHERE origin = 'processed' AND {T.IS_DOCUMENT_SQL}""",
    "processing_order": f"""WITH {T.RECEIPTS_SQL} SELECT week_id, file_name, origin,
        row_number() OVER (PARTITION BY week_id ORDER BY file_name, origin_rank) AS n
        FROM receipts WHERE {T.IS_DOCUMENT_SQL}""",
    "source_file_name": f"WITH {T.RECEIPTS_SQL} SELECT file_name, regexp_replace(file_name, '\\.[^.]*$', '') || '.pdf' AS source_file FROM receipts",
    "source_name_collisions": f"""WITH {_SHARED_SQL} SELECT week_id, regexp_replace(file_name, '\\.[^.]*$', '') || '.pdf' AS source_file,
        count(*) AS n_files FROM shared GROUP BY 1, 2 HAVING count(*) > 1""",
    "scan_manifest": """
        WITH f AS (SELECT doc_id, sha1(coalesce(text, '') || chr(0)) AS sha1 FROM documents)
        SELECT doc_id, true AS stays, sha1, CASE WHEN doc_id % 10 = 0 THEN 'new' ELSE 'same' END AS change FROM f
        UNION ALL SELECT doc_id, false, sha1, 'gone' FROM f WHERE doc_id % 7 = 0""",
    "routing_plan_clashes": f"""WITH {T.LEDGER_SQL},
        files AS (
          SELECT k, copy, left(week_id, 4) AS week, trim(regexp_replace(lower(category), '[^a-z0-9]+', '-', 'g'), '-') AS category_slug, k % 5 AS name,
                 left(sha1(CAST(k % 11 AS VARCHAR)), 8) AS piece, k % 11 AS hashed, file_name, origin_rank FROM ledger),
        owned AS (SELECT *, row_number() OVER (PARTITION BY week, category_slug, name ORDER BY file_name, origin_rank) = 1 AS own FROM files),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY week, category_slug, name, hashed, own ORDER BY file_name, origin_rank) AS r FROM owned)
        SELECT k, copy, category_slug, 'scan' || name || CASE WHEN own THEN '' WHEN r = 1 THEN '_' || piece
               ELSE '_' || piece || '_' || CASE WHEN name = 0 AND hashed = 0 AND r >= 3 THEN r + 1 ELSE r END END || '.jpg' AS target_name
        FROM ranked""",
    "routing_plan": f"""WITH {_SHARED_SQL},
        acted AS (SELECT *, CASE WHEN folder = category_slug THEN 'stay' WHEN origin = 'processed' THEN 'reroute' ELSE 'move' END AS action FROM shared),
        present AS (SELECT week_id, folder AS category_slug, file_name FROM acted WHERE origin = 'processed'
                    UNION SELECT week_id, category_slug, file_name FROM acted WHERE k % 7 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY week_id, category_slug, file_name, action = 'stay'
                   ORDER BY old_name, origin_rank) AS place FROM acted)
        SELECT r.week_id, r.category_slug, r.file_name, r.action,
               CASE WHEN r.action <> 'stay' AND (r.place > 1 OR p.file_name IS NOT NULL)
                    THEN regexp_replace(r.file_name, '\\.[^.]*$', '') || '_' || left(r.sha1, 8) || regexp_extract(r.file_name, '\\.[^.]*$')
                    ELSE r.file_name END AS target_name
        FROM ranked r LEFT JOIN present p USING (week_id, category_slug, file_name)""",
    "undo_restore_plan": f"""WITH {_SHARED_SQL},
        present AS (SELECT DISTINCT week_id, file_name FROM shared WHERE k % 5 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY week_id, file_name ORDER BY old_name, origin_rank) AS place FROM shared)
        SELECT r.week_id, r.file_name, CASE WHEN r.place = 1 AND p.file_name IS NULL THEN 'move' ELSE 'skip' END AS action
        FROM ranked r LEFT JOIN present p USING (week_id, file_name)""",
}
