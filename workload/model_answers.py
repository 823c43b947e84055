"""Queries on model answers: requests, parsing, the cache, and the resolved ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import answers as A
from ledgerloom.operators import lookup
from ledgerloom.plans.weekly import canonical_rows, extract
from ledgerloom.rules import Rules
from ledgerloom.sources import tables
from ledgerloom.sources.documents import keep_documents
from workload import tables as T
from workload.scratch import new_folder
from workload.scratch import ensure_shared_folder, new_folder


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.receipts(spark, sf_dir)
    found = lookup.cache_lookup(rows.select("k", "copy", "sha1"), T.cache(rows))
    return found.selectExpr("k", "copy", "answer.vendor AS vendor", "answer.confidence AS confidence",
                            "coalesce(answer.cached, false) AS cached")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.receipts(spark, sf_dir)
    return lookup.cache_misses(rows.select("k", "copy", "sha1"), T.cache(rows))


def extraction_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the documents table, whose copies share one, against a cache of every third."""
    docs = T.load_spread(spark, sf_dir, "documents").selectExpr("doc_id", "text", "sha1(text) AS sha1")
    cache = docs.filter("doc_id % 3 = 0").selectExpr("sha1 AS file_hash")
    return A.requests(docs, cache, T.rules())


def extraction_requests_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole texts in the prompts."""
    docs = T.load_spread(spark, sf_dir, "documents").selectExpr("doc_id", "text", "sha1(text) AS sha1")
    cache = docs.filter("doc_id % 3 = 0").selectExpr("sha1 AS file_hash")
    return A.requests(docs, cache, T.rules(), text_limit=None)


def batch_inference_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that echoes the second line of the text as the vendor."""
    def stub_provider():
        import json

        def answer(prompts):
            for prompt in prompts:
                body = prompt.split("Text:\n", 1)[1].split("\n")
                yield json.dumps({"vendor": body[1] if len(body) > 1 else "", "date": "",
                                  "category": "feed", "confidence": 0.8})

        return answer

    ensure_shared_folder(spark)
    rows = T.receipts(spark, sf_dir)
    raw = A.infer(A.requests(rows, T.cache(rows), T.rules()), stub_provider)
    return raw.selectExpr("file_hash", f"{A.parse_answer('response', T.rules())} AS a").select(
        "file_hash", "a.vendor", "a.date", "a.category", "a.confidence")


def batch_inference_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers, asked in waves whose answers are stored; a second call finds all of them there."""
    def stub_provider():
        import json

        return lambda prompts: [json.dumps({"vendor": p.split("Text:\n", 1)[1].split("\n")[1],
                                            "category": "feed", "confidence": 0.8}) for p in prompts]

    def no_provider():
        raise RuntimeError("all prompts were answered before")

    rows, spool = T.receipts(spark, sf_dir), new_folder(spark, "spool")
    wanted = A.requests(rows, T.cache(rows), T.rules())
    A.ask_in_waves(wanted, stub_provider, spool, wave_prompts=5000)
    raw = A.ask_in_waves(wanted, no_provider, spool, wave_prompts=5000)
    return raw.selectExpr("file_hash", f"{A.parse_answer('response', T.rules())} AS a").select(
        "file_hash", "a.vendor", "a.date", "a.category", "a.confidence")


def batch_inference_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider that raises for some prompts and leaves others unanswered: those alone are without an answer."""
    def shaky_provider():
        import json

        def answer(prompts):
            out = []
            for prompt in prompts:
                body = prompt.split("Text:\n", 1)[1]
                if "Wicker" in body:
                    raise RuntimeError("no such service")
                if "Ferry" not in body:
                    out.append(json.dumps({"vendor": body.split("\n")[1], "category": "feed", "confidence": 0.8}))
            return out

        return answer

    ensure_shared_folder(spark)
    rows = T.receipts(spark, sf_dir)
    raw = A.infer(A.requests(rows, T.cache(rows), T.rules()), shaky_provider)
    return raw.selectExpr("file_hash", "error", f"{A.answer_of('response', 'error', T.rules())} AS a").select(
        "file_hash", "a.vendor", "a.category", "a.confidence", "error", "a.reasoning")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.raw_answers(T.receipts(spark, sf_dir))


def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put between fences, with a second fenced part after some prose."""
    fenced = ("IF(doc_id % 3 = 0, text, concat('```text\\n', text, '\\n```\\nprose\\n```\\n', source, '\\n```'))"
              " AS fenced")
    return T.load_spread(spark, sf_dir, "documents").selectExpr("doc_id", fenced).selectExpr(
        "doc_id", f"{A.strip_fences('fenced')} AS kept")


def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).selectExpr("k", "copy", f"{A.parse_answer('response', T.rules())} AS a").select(
        "k", "copy", "a.vendor", "a.date", "a.category", "a.confidence", "a.reasoning")


def canonical_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = """CASE k % 4 WHEN 0 THEN upper(true_category) WHEN 1 THEN lower(true_category)
        WHEN 2 THEN concat(true_category, 's') ELSE true_category END AS written"""
    return T.receipts(spark, sf_dir).selectExpr("k", "copy", written).selectExpr(
        "k", "copy", f"{A.canonical_category('written', T.rules())} AS category")


def rejects_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = A.split_rejects(_raw(spark, sf_dir))
    kept = ["k", "copy", "error"]
    return good.selectExpr(*kept, "true AS usable").unionByName(bad.selectExpr(*kept, "false AS usable"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).selectExpr("file_hash", f"{A.parse_answer('response', T.rules())} AS answer")


def cache_write_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cache_rows(_parsed(spark, sf_dir)).select("file_hash", "vendor", "category", "confidence")


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache table after new answers came to the stored ones; `written` is the commit of each row."""
    state = tables.answer_cache(spark, new_folder(spark, "cache"))
    state.upsert(T.cache(T.receipts(spark, sf_dir)), "stored")
    state.upsert(A.cache_rows(_parsed(spark, sf_dir)).withColumn("cached_at", F.lit("2024-02-02").cast("timestamp")), "new")
    return state.read().selectExpr("file_hash", "vendor", "confidence", "CAST(version AS INT) AS written")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_documents(T.receipts(spark, sf_dir)).select("k", "copy", "week_id", "file_name", "seq", "sha1", "text")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resolved with the cache, else the parsed answers, else their text."""
    rows = T.receipts(spark, sf_dir)
    read = A.read_texts(_documents(spark, sf_dir), T.rules())
    return A.settle(A.with_answers(read, T.cache(rows), _parsed(spark, sf_dir)))


def resolve_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select(
        "k", "copy", "date", "vendor", "amount", "category", "matcher", "date_source")


def resolve_no_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_documents(spark, sf_dir), T.rules()).select(
        "k", "copy", "date", "vendor", "amount", "category", "matcher", "date_source")


def hint_without_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hint decides vendor and category even if no matcher applies: the category is then Uncategorized."""
    rules = Rules(categories=("Feed",), hints=(("corner SUGAR", "The Sugarhouse"),))
    answered = _documents(spark, sf_dir).withColumn("answer", F.expr(A.answer_struct(
        vendor="'Model'", date="NULL", category="'Feed'", confidence="IF(k % 2 = 0, 0.9D, 0.1D)", reasoning="''")))
    return A.resolve(answered, rules).select("k", "copy", "vendor", "category", "matcher")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical_rows(extract(_documents(spark, sf_dir), T.rules()), "claim 7")
    return rows.drop("seq", "date_source")


QUERIES = {
    "cache_lookup": cache_lookup,
    "cache_misses": cache_misses,
    "extraction_requests": extraction_requests,
    "extraction_requests_full": extraction_requests_full,
    "batch_inference_stub": batch_inference_stub,
    "batch_inference_waves": batch_inference_waves,
    "batch_inference_errors": batch_inference_errors,
    "strip_fences": strip_fences,
    "parse_answers": parse_answers,
    "canonical_category": canonical_category,
    "rejects_split": rejects_split,
    "cache_write_gate": cache_write_gate,
    "cache_upsert": cache_upsert,
    "resolve_receipts": resolve_receipts,
    "resolve_no_model": resolve_no_model,
    "hint_without_matcher": hint_without_matcher,
    "canonical_rows": canonical,
}

# What each response of the fixture parses to.
_ANSWERS_SQL = T.CACHE_SQL + """,
answers AS (
  SELECT k, copy, sha1 AS file_hash, k % 7 IN (0, 1, 2, 6) AS usable,
         CASE WHEN k % 7 IN (0, 1, 2, 6) THEN true_vendor || ' Ltd' END AS vendor,
         CASE WHEN k % 7 IN (0, 1, 2, 6) THEN '2002-02-02' END AS date,
         CASE WHEN k % 7 IN (0, 1, 2, 6) THEN true_category ELSE 'Uncategorized' END AS category,
         CASE WHEN k % 7 = 2 THEN 0.2 WHEN k % 7 IN (0, 1, 6) THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence,
         CASE k % 7 WHEN 3 THEN 'vendor is not text' WHEN 4 THEN 'vendor is not text' WHEN 5 THEN 'not JSON' END AS error
  FROM receipts)"""

_DOCS_SQL = f"docs AS (SELECT * FROM receipts WHERE {T.IS_DOCUMENT_SQL})"

_PROMPT_SQL = "'" + (A.PROMPT_HEAD + ", ".join(T.rules().categories) + A.PROMPT_TAIL).replace("'", "''") + "'"

ORACLES = {
    "cache_lookup": f"""WITH {T.CACHE_SQL} SELECT r.k, r.copy, c.vendor, c.confidence, c.file_hash IS NOT NULL AS cached
        FROM receipts r LEFT JOIN cache c ON r.sha1 = c.file_hash""",
    "cache_misses": f"WITH {T.RECEIPTS_SQL} SELECT k, copy, sha1 FROM receipts WHERE k % 3 <> 0",
    "extraction_requests": f"""SELECT DISTINCT sha1(text) AS file_hash, {_PROMPT_SQL} || left(text, 2000) AS prompt FROM documents
        WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 0)""",
    "extraction_requests_full": f"""SELECT DISTINCT sha1(text) AS file_hash, {_PROMPT_SQL} || text AS prompt FROM documents
        WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE doc_id % 3 = 0)""",
    "batch_inference_stub": f"""WITH {T.RECEIPTS_SQL} SELECT sha1 AS file_hash, string_split(text, chr(10))[2] AS vendor,
        CAST(NULL AS VARCHAR) AS date, 'Feed' AS category, CAST(0.8 AS DOUBLE) AS confidence FROM receipts WHERE k % 3 <> 0""",
    "batch_inference_errors": f"""WITH {T.RECEIPTS_SQL},
        asked AS (SELECT *, CASE WHEN k % 12 = 5 THEN 'RuntimeError: no such service' WHEN k % 12 = 1 THEN '0 answers to one prompt' END AS error
                  FROM receipts WHERE k % 3 <> 0)
        SELECT sha1 AS file_hash, CASE WHEN error IS NULL THEN string_split(text, chr(10))[2] END AS vendor,
               CASE WHEN error IS NULL THEN 'Feed' ELSE 'Uncategorized' END AS category,
               CAST(CASE WHEN error IS NULL THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence, error,
               CASE WHEN error IS NULL THEN '' ELSE 'provider failed: ' || error END AS reasoning FROM asked""",
    "strip_fences": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE text || chr(10) || source END AS kept FROM documents",
    "parse_answers": f"""WITH {_ANSWERS_SQL} SELECT k, copy, vendor, date, category, confidence,
        CASE WHEN usable THEN 'read from the header' ELSE 'no usable answer: ' || error END AS reasoning FROM answers""",
    "canonical_category": f"""WITH {T.RECEIPTS_SQL} SELECT k, copy,
        CASE WHEN k % 4 = 2 THEN 'Uncategorized' ELSE true_category END AS category FROM receipts""",
    "rejects_split": f"WITH {_ANSWERS_SQL} SELECT k, copy, usable, error FROM answers",
    "cache_write_gate": f"WITH {_ANSWERS_SQL} SELECT file_hash, vendor, category, confidence FROM answers WHERE k % 7 IN (0, 1, 6)",
    "cache_upsert": f"""WITH {_ANSWERS_SQL},
        new AS (SELECT file_hash, vendor, confidence, 2 AS written FROM answers WHERE k % 7 IN (0, 1, 6))
        SELECT * FROM new UNION ALL SELECT file_hash, vendor, confidence, 1 FROM cache WHERE file_hash NOT IN (SELECT file_hash FROM new)""",
    "resolve_receipts": f"""WITH {_ANSWERS_SQL}, {_DOCS_SQL},
        judged AS (SELECT *, k % 12 IN (0, 2, 10) AS hinted, k % 3 = 0 AS in_cache,
                   CASE WHEN k % 3 = 0 THEN k % 2 = 0 ELSE k % 7 IN (0, 1, 6) END AS strong FROM docs)
        SELECT k, copy,
          coalesce(CASE WHEN strong THEN CASE WHEN in_cache THEN true_date ELSE '2002-02-02' END END, true_date) AS date,
          CASE WHEN hinted OR NOT strong THEN true_vendor WHEN in_cache THEN true_vendor || ' Cached' ELSE true_vendor || ' Ltd' END AS vendor,
          true_amount AS amount, true_category AS category,
          CASE WHEN hinted OR NOT strong THEN coalesce(true_matcher, 'Regex fallback')
               WHEN in_cache THEN 'LLM (confidence: 0.95) [cached]' ELSE 'LLM (confidence: 0.95)' END AS matcher,
          CASE WHEN strong AND NOT in_cache THEN 'model' WHEN strong AND true_date IS NOT NULL THEN 'model'
               WHEN true_date IS NOT NULL THEN 'regex' END AS date_source
        FROM judged""",
    "resolve_no_model": f"""WITH {T.RECEIPTS_SQL}, {_DOCS_SQL} SELECT k, copy, true_date AS date, true_vendor AS vendor,
        true_amount AS amount, true_category AS category, coalesce(true_matcher, 'Regex fallback') AS matcher,
        CASE WHEN true_date IS NOT NULL THEN 'regex' END AS date_source FROM docs""",
    "hint_without_matcher": f"""WITH {T.RECEIPTS_SQL}, {_DOCS_SQL}
        SELECT k, copy, CASE WHEN k % 12 = 3 THEN 'The Sugarhouse' WHEN k % 2 = 0 THEN 'Model' ELSE {T.VENDOR_LINE_SQL} END AS vendor,
               CASE WHEN k % 12 <> 3 AND k % 2 = 0 THEN 'Feed' ELSE 'Uncategorized' END AS category,
               CASE WHEN k % 12 = 3 THEN 'Manual hint' WHEN k % 2 = 0 THEN 'LLM (confidence: 0.90)' ELSE 'Regex fallback' END AS matcher FROM docs""",
    "canonical_rows": f"""WITH {T.RECEIPTS_SQL}, {_DOCS_SQL} SELECT true_date AS date, true_vendor AS vendor, true_amount AS amount,
        true_category AS category, coalesce(true_matcher, 'Regex fallback') AS matcher, 'claim 7' AS notes,
        regexp_replace(file_name, '\\.[^.]*$', '') || '.pdf' AS source_file, sha1, week_id FROM docs""",
}
ORACLES["batch_inference_waves"] = ORACLES["batch_inference_stub"]
