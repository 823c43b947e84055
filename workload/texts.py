"""Queries on texts: dates, amounts, vendors, categories and the scalar functions."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import patterns as P
from ledgerloom.functions.text import fingerprint, let, lines, money, quote, slug, week_label
from ledgerloom.operators import extract, lookup, manyrules
from ledgerloom.plans.recategorize import StoredVerdicts
from ledgerloom.rules import Condition, Matcher, Rules, load_rules
from workload import tables as T
from workload.scratch import new_folder

DOC_RULES = Rules(
    categories=("Legal", "Negative", "Contact", "Other"),
    matchers=(
        Matcher("Licence", "Legal", any=(Condition(text_re="licen[sc]e"), Condition(text_re="copyright"))),
        Matcher("Harsh", "Negative", any=(Condition(text_re="worthless|terrible|awful"),)),
        Matcher("Mail", "Contact", all=(Condition(text_re="[a-z0-9]+@[a-z0-9]+"), Condition(text_re="the"))),
        Matcher("Odd source", "Other", any=(Condition(vendor_re="src1[0-9]"),), all=(Condition(text_re="un[ae]? "),)),
        Matcher("English", "Plain", any=(Condition(vendor_re="^src[0-4]$", text_re="ing the "),)),
    ),
)


def _receipts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return T.receipts(spark, sf_dir).selectExpr("k", "copy", *columns)


def extract_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir, f"{extract.date_of('text')} AS date")


def extract_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir, f"{extract.amount_of('text')} AS amount")


def vendor_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir, f"{extract.hint_vendor('text', T.rules())} AS vendor")


def vendor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir, f"{extract.pattern_vendor('text', T.rules())} AS vendor")


def extract_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _receipts(spark, sf_dir, f"{extract.vendor_of('text', T.rules())} AS vendor")


def vendor_line_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best vendor line of every document with its score, and the last-resort line."""
    return _line_scores(spark, sf_dir, P.VENDOR_LINES, P.LAST_RESORT_LINES)


def vendor_line_score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all lines of every document."""
    return _line_scores(spark, sf_dir, None, None)


def _line_scores(spark: SparkSession, sf_dir: str, best_of: int | None, last_resort_of: int | None) -> DataFrame:
    found = let("ls", lines("text"), f"named_struct('best', {extract.best_line('ls', Rules(), best_of)}, "
                f"'last_resort', {extract.last_resort_line('ls', Rules(), last_resort_of)})")
    return T.load_spread(spark, sf_dir, "documents").selectExpr("doc_id", f"{found} AS found").selectExpr(
        "doc_id", "CAST(found.best.score AS BIGINT) AS score", "found.best.line AS best_line",
        "found.last_resort AS last_resort")


def categorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = extract.categorize("true_vendor", "text", T.rules())
    return _receipts(spark, sf_dir, f"{verdict} AS verdict").select("k", "copy", "verdict.category", "verdict.matcher")


def categorize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = extract.categorize("source", "text", DOC_RULES)
    return T.load_spread(spark, sf_dir, "documents").selectExpr("doc_id", f"{verdict} AS v").select(
        "doc_id", "v.category", "v.matcher")


def _from_file(spark: SparkSession, raw: dict) -> Rules:
    path = f"{new_folder(spark, 'rules')}/rules.json"
    spark.createDataFrame([(json.dumps(raw),)], "value string").coalesce(1).write.text(path)
    return load_rules(spark, path)


def _as_json(rules: Rules) -> dict:
    return {"categories": rules.categories, "matchers": [
        {"name": m.name, "category": m.category, **{
            kind: [{"vendor_re": c.vendor_re, "text_re": c.text_re} for c in group] for kind, group in (("any", m.any), ("all", m.all))}}
        for m in rules.matchers]}


def amount_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts that only their currency names, and that no other label does."""
    text = "concat('Shop\\nUSD ', IF(o_orderkey % 2 = 0, '$ ', ''), format_number(o_totalprice, 2), ' paid')"
    return T.load_spread(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{text} AS text").selectExpr(
        "o_orderkey", f"{extract.amount_of('text')} AS amount")


def categorize_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules loaded from a file, with what Python's dialect writes differently."""
    patterns = {"Ends": "[a-z]\\.\\Z", "Signs": "[&&#]{3}", "Few": "^[A-Z][a-z]{,2} ", "Bracket": "[[|]"}
    raw = {"categories": list(patterns), "matchers": [
        {"name": n, "category": n, "any": [{"text_re": p}]} for n, p in patterns.items()]}
    verdict = extract.categorize("source", "text", _from_file(spark, raw))
    return T.load_spread(spark, sf_dir, "documents").selectExpr("doc_id", f"{verdict} AS v").select("doc_id", "v.category", "v.matcher")


def rules_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a file as a table of conditions in order, each with its hits over all documents.

    One pass with one counter per condition; rules are configuration, so their
    number does not grow with the data.
    """
    rules = _from_file(spark, _as_json(DOC_RULES))
    conditions = [
        (pos, m.name, kind, i, c)
        for pos, m in enumerate(rules.matchers)
        for kind, group in (("any", m.any), ("all", m.all))
        for i, c in enumerate(group)
    ]
    hits = [F.expr(f"count_if({extract.condition_hits('source', 'text', c[4])}) AS c{n}")
            for n, c in enumerate(conditions)]
    table = ", ".join(
        f"named_struct('pos', {pos}, 'name', {quote(name)}, 'kind', '{kind}', 'condition', {i}, "
        f"'vendor_re', {quote(c.vendor_re)}, 'text_re', {quote(c.text_re)}, 'hits', c{n})"
        for n, (pos, name, kind, i, c) in enumerate(conditions))
    return T.load_spread(spark, sf_dir, "documents").agg(*hits).selectExpr(f"inline(array({table}))")


def blacklist_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors with a blacklist entry that is marked as an example, as the library takes it and with such entries dropped."""
    rules = Rules(blacklist=("EXAMPLE: Ferry Link", "example: wicker", "copper finch"))
    text = "replace(replace(text, 'Ferry Link', 'Example: Ferry Link'), 'Wicker', 'Example: Wicker')"
    return T.receipts(spark, sf_dir).selectExpr("k", "copy", f"{text} AS text").selectExpr(
        "k", "copy", f"{extract.vendor_of('text', rules)} AS vendor", f"{extract.vendor_of('text', rules.without_example_blacklist())} AS vendor_without")


def changed_rules() -> Rules:
    """The workload's rules with a matcher put in the middle, one of another category, and one left out."""
    rules = T.rules()
    kept = [replace(m, category="Candles") if m.name == "Wax" else m for m in rules.matchers if m.name != "Mites"]
    return replace(rules, matchers=(*kept[:3], Matcher("Grand", "Totals", any=(Condition(text_re="grand total"),)), *kept[3:]))


def recategorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts after a change of the rules, and which documents were judged again for it."""
    docs = T.receipts(spark, sf_dir).selectExpr("k", "copy", "sha1 AS doc", "true_vendor AS vendor", "text")
    verdicts = StoredVerdicts(spark, new_folder(spark, "verdicts"))
    verdicts.refresh(docs.select("doc", "vendor", "text"), T.rules())
    verdicts.refresh(docs.select("doc", "vendor", "text"), changed_rules())
    return docs.join(verdicts.table.read(), "doc").selectExpr("k", "copy", "category", "matcher", "version = 2 AS judged_again")


SYLLABLES = ("th er on an re in st nd ou ea ha he en ti or as is es ed at le ly nt sh wh ing ion ere ent the and for are tha ble un de la el os").split()


def categorize_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,764 rules, one for each word of two syllables: the first whose word stands in the document decides."""
    rules = Rules(categories=tuple(f"C{n}" for n in range(7)), matchers=tuple(
        Matcher(a + b, f"C{(i * len(SYLLABLES) + j) % 7}", any=(Condition(text_re=rf"\b{a}{b}\b"),))
        for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES)))
    docs = T.load_spread(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return manyrules.with_category(docs, "source", "text", "verdict", rules).select("doc_id", "verdict.category", "verdict.matcher")


def hint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hint_join(spark, sf_dir, lookup.MAX_INLINE_HINTS)


def hint_join_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every hint found by its q-grams, in texts that are dealt out anew."""
    hints = T.load(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS pos", "text AS pattern", "concat('item ', item_id) AS vendor")
    texts = T.load_spread(spark, sf_dir, "documents").select("doc_id", "text")
    return lookup.first_hint(texts.repartition("doc_id"), hints, "doc_id", inline_limit=0)


def hint_join_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the q-gram index used for hint tables that are too large to compile."""
    return _hint_join(spark, sf_dir, 0)


def _hint_join(spark: SparkSession, sf_dir: str, inline_limit: int) -> DataFrame:
    """Which benchmark item, as a whole, stands in each document."""
    hints = T.load(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS pos", "text AS pattern", "concat('item ', item_id) AS vendor")
    texts = T.load_spread(spark, sf_dir, "documents").select("doc_id", "text")
    return lookup.first_hint(texts, hints, "doc_id", inline_limit=inline_limit)


def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = "concat_ws(' / ', '', p_type, p_brand, concat(p_name, ' #!'))"
    return T.load(spark, sf_dir, "part").selectExpr("p_partkey", f"{slug(label)} AS slug")


def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{money('o_totalprice')} AS shown")


def week_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{week_label('CAST(o_orderdate AS DATE)')} AS week_id")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = fingerprint("date_format(o_orderdate, 'yyyy-MM-dd')",
                           "concat('  Customer#', o_custkey, ' ')", "o_totalprice")
    return T.load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{identity} AS fingerprint")


QUERIES = {
    "extract_date": extract_date,
    "extract_amount": extract_amount,
    "vendor_hint": vendor_hint,
    "vendor_extract": vendor_extract,
    "amount_usd": amount_usd,
    "extract_vendor": extract_vendor,
    "vendor_line_score": vendor_line_score,
    "categorize": categorize,
    "categorize_documents": categorize_documents,
    "categorize_dialect": categorize_dialect,
    "rules_flatten": rules_flatten,
    "blacklist_examples": blacklist_examples,
    "categorize_many": categorize_many,
    "recategorize": recategorize,
    "hint_join": hint_join,
    "hint_join_anchored": hint_join_anchored,
    "hint_join_blocks": hint_join_blocks,
    "vendor_line_score_all": vendor_line_score_all,
    "slugify": slugify,
    "money_format": money_format,
    "week_label": week_labels,
    "fingerprint": fingerprints,
}

# In the regular expressions below \s is ASCII, as no document holds other blanks
# next to a line break.
_SKIPPED_SQL = " OR ".join(f"regexp_matches(line, '(?i){p}')" for p in P.SKIP_LINE_PATTERNS)


def _vendor_lines_sql(best_of: int | None, last_resort_of: int | None) -> str:
    """CTEs; None means all lines."""
    far = 1 << 31
    return _VENDOR_LINES_SQL.replace("$skipped", _SKIPPED_SQL).replace("$best_of", str(best_of or far)).replace(
        "$last_resort_of", str(last_resort_of or far))


def _line_score_sql(best_of: int | None, last_resort_of: int | None) -> str:
    return f"""WITH {_vendor_lines_sql(best_of, last_resort_of)}
        SELECT s.doc_id, CAST(b.score AS BIGINT) AS score, b.line AS best_line, coalesce(u.line, s.ls[1]) AS last_resort
        FROM split_lines s LEFT JOIN best b USING (doc_id) LEFT JOIN usable u USING (doc_id)"""


_VENDOR_LINES_SQL = r"""
split_lines AS (
  SELECT doc_id, list_filter(list_transform(
           regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1c-\x1e]'),
           lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(31) || chr(160))), lambda l: l <> '') AS ls
  FROM documents),
numbered AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM split_lines),
measured AS (
  SELECT *, length(regexp_replace(line, '[^\p{L}]', '', 'g')) AS letters,
         length(regexp_replace(line, '[^\p{Nd}]', '', 'g')) AS digits,
         length(line) - length(replace(line, ' ', '')) AS spaces,
         length(line) AS size,
         $skipped AS skipped
  FROM numbered),
scored AS (
  SELECT doc_id, i, line,
         100 - 3 * i + CASE WHEN upper(line) = line AND size BETWEEN 3 AND 40 THEN 50 ELSE 0 END
         + CASE WHEN size BETWEEN 5 AND 30 THEN 20 ELSE 0 END - CASE WHEN size > 50 THEN 30 ELSE 0 END
         - CASE WHEN spaces > 2 THEN 15 ELSE 0 END AS score
  FROM measured
  WHERE i < $best_of AND size BETWEEN 3 AND 80 AND NOT skipped AND letters >= 3 AND digits < greatest(2, letters // 3) AND spaces < 5),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1),
usable AS (SELECT doc_id, line FROM measured WHERE i < $last_resort_of AND size >= 3 AND NOT skipped
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)
"""

_HITS = {
    "licence": "regexp_matches(text, '(?i)licen[sc]e')",
    "copyright": "regexp_matches(text, '(?i)copyright')",
    "harsh": "regexp_matches(text, '(?i)worthless|terrible|awful')",
    "mail": "regexp_matches(text, '(?i)[a-z0-9]+@[a-z0-9]+')",
    "the": "regexp_matches(text, '(?i)the')",
    "source": "regexp_matches(source, '(?i)src1[0-9]')",
    "un": "regexp_matches(text, '(?i)un[ae]? ')",
    "english": "(regexp_matches(source, '(?i)^src[0-4]$') OR regexp_matches(text, '(?i)ing the '))",
}


def _hint_sql() -> str:
    return """
      SELECT d.doc_id, min(b.item_id) AS pos, arg_min('item ' || b.item_id, b.item_id) AS vendor
      FROM documents d LEFT JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY d.doc_id"""


ORACLES = {
    "extract_date": f"WITH {T.RECEIPTS_SQL} SELECT k, copy, true_date AS date FROM receipts",
    "extract_amount": f"WITH {T.RECEIPTS_SQL} SELECT k, copy, true_amount AS amount FROM receipts",
    "amount_usd": "SELECT o_orderkey, o_totalprice AS amount FROM orders",
    "vendor_hint": f"WITH {T.RECEIPTS_SQL} SELECT k, copy, CASE WHEN k % 12 IN (0, 2, 10) THEN true_vendor END AS vendor FROM receipts",
    "vendor_extract": f"WITH {T.RECEIPTS_SQL} SELECT k, copy, CASE WHEN k % 12 = 8 THEN true_vendor END AS vendor FROM receipts",
    "extract_vendor": f"WITH {T.RECEIPTS_SQL} SELECT k, copy, true_vendor AS vendor FROM receipts",
    "vendor_line_score": _line_score_sql(P.VENDOR_LINES, P.LAST_RESORT_LINES),
    "vendor_line_score_all": _line_score_sql(None, None),
    "categorize": f"WITH {T.RECEIPTS_SQL} SELECT k, copy, true_category AS category, true_matcher AS matcher FROM receipts",
    "categorize_documents": f"""SELECT doc_id,
        CASE WHEN {_HITS['licence']} OR {_HITS['copyright']} THEN 'Legal' WHEN {_HITS['harsh']} THEN 'Negative'
             WHEN {_HITS['mail']} AND {_HITS['the']} THEN 'Contact' WHEN {_HITS['source']} AND {_HITS['un']} THEN 'Other'
             WHEN {_HITS['english']} THEN 'Plain' ELSE 'Uncategorized' END AS category,
        CASE WHEN {_HITS['licence']} OR {_HITS['copyright']} THEN 'Licence' WHEN {_HITS['harsh']} THEN 'Harsh'
             WHEN {_HITS['mail']} AND {_HITS['the']} THEN 'Mail' WHEN {_HITS['source']} AND {_HITS['un']} THEN 'Odd source'
             WHEN {_HITS['english']} THEN 'English' END AS matcher
        FROM documents""",
    "categorize_dialect": r"""SELECT doc_id, coalesce(name, 'Uncategorized') AS category, name AS matcher FROM (
        SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[a-z]\.\z') THEN 'Ends' WHEN regexp_matches(text, '[&#]{3}') THEN 'Signs'
            WHEN regexp_matches(text, '(?i)^[A-Z][a-z]{0,2} ') THEN 'Few' WHEN regexp_matches(text, '[\[|]') THEN 'Bracket' END AS name FROM documents)""",
    "rules_flatten": " UNION ALL ".join(
        f"SELECT {pos} AS pos, '{name}' AS name, '{kind}' AS kind, {i} AS condition, {v} AS vendor_re, {t} AS text_re, count(*) AS hits FROM documents WHERE {test}"
        for pos, name, kind, i, v, t, test in [
            (0, "Licence", "any", 0, "CAST(NULL AS VARCHAR)", "'licen[sc]e'", _HITS["licence"]),
            (0, "Licence", "any", 1, "NULL", "'copyright'", _HITS["copyright"]),
            (1, "Harsh", "any", 0, "NULL", "'worthless|terrible|awful'", _HITS["harsh"]),
            (2, "Mail", "all", 0, "NULL", "'[a-z0-9]+@[a-z0-9]+'", _HITS["mail"]),
            (2, "Mail", "all", 1, "NULL", "'the'", _HITS["the"]),
            (3, "Odd source", "any", 0, "'src1[0-9]'", "NULL", _HITS["source"]),
            (3, "Odd source", "all", 0, "NULL", "'un[ae]? '", _HITS["un"]),
            (4, "English", "any", 0, "'^src[0-4]$'", "'ing the '", _HITS["english"]),
        ]),
    "blacklist_examples": f"""WITH {T.RECEIPTS_SQL},
        shown AS (SELECT k, copy, replace(replace({T.VENDOR_LINE_SQL}, 'Ferry Link', 'Example: Ferry Link'), 'Wicker', 'Example: Wicker') AS line FROM receipts)
        SELECT k, copy, CASE WHEN k % 12 IN (1, 5, 11) THEN '12 Main Street Suite 4' WHEN copy = 1 AND k % 12 = 8 THEN 'COPY' ELSE line END AS vendor,
               CASE WHEN k % 12 = 11 THEN '12 Main Street Suite 4' WHEN copy = 1 AND k % 12 = 8 THEN 'COPY' ELSE line END AS vendor_without FROM shown""",
    "recategorize": f"""WITH {T.RECEIPTS_SQL}
        SELECT k, copy, CASE WHEN again AND k % 4 = 1 THEN 'Totals' WHEN k % 12 = 6 THEN 'Uncategorized' ELSE true_category END AS category,
               CASE WHEN again AND k % 4 = 1 THEN 'Grand' WHEN k % 12 = 6 THEN NULL ELSE true_matcher END AS matcher, again AS judged_again
        FROM (SELECT *, k % 12 NOT IN (1, 3, 4, 7, 8) AS again FROM receipts)""",
    "categorize_many": f"""
        WITH s(syllable, i) AS (VALUES {", ".join(f"('{x}', {n})" for n, x in enumerate(SYLLABLES))}),
        r AS (SELECT a.syllable || b.syllable AS word, min(a.i * {len(SYLLABLES)} + b.i) AS pos FROM s a, s b GROUP BY 1),
        w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'))) AS word FROM documents),
        f AS (SELECT doc_id, min_by(word, pos) AS word, min(pos) AS pos FROM w JOIN r USING (word) GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN pos IS NULL THEN 'Uncategorized' ELSE 'C' || (pos % 7) END AS category, word AS matcher
        FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id""",
    "hint_join": _hint_sql(),
    "hint_join_anchored": _hint_sql(),
    "hint_join_blocks": _hint_sql(),
    "slugify": """SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' / ', '', p_type, p_brand, p_name || ' #!')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""",
    "money_format": "SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS shown FROM orders",
    "week_label": "SELECT o_orderkey, strftime(o_orderdate, '%Y-W%U') AS week_id FROM orders",
    "fingerprint": """SELECT o_orderkey, sha256(strftime(o_orderdate, '%Y-%m-%d') || '|customer#' || o_custkey || '|' || format('{:.2f}', o_totalprice)) AS fingerprint FROM orders""",
}
