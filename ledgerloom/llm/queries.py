"""Registered queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import alignment, decontam, exact, langid, lm, mixing, phrases, sharding, simhash, tokencount, tokenids, urls, warc
from ledgerloom.llm.parameters import URL_RULES, byte_tokenizer, piece_tokenizer, source_schedules, source_weights, word_tokenizer

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(_table(spark, sf_dir, "documents"), train=_remainder(7) != 2)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), [urls.Rule(*r) for r in URL_RULES])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.report(_table(spark, sf_dir, "documents"), source_weights, source_schedules)
    return found.withColumn("first_position", F.round("first_position", 9))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def language_models(docs: DataFrame) -> langid.Models:
    return langid.fit(docs, train=_remainder(4) != 2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_models(docs))
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.written_ids(_table(spark, sf_dir, "documents"), byte_tokenizer())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(_table(spark, sf_dir, "documents"), shingle_words=4, radius=4, n_words=1)
    return found.select("doc_id", simhash.hex_of(F.col("fp0")).alias("fingerprint"), "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.report(_table(spark, sf_dir, "documents"), word_tokenizer())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_table(spark, sf_dir, "documents"), byte_tokenizer(), piece_tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_mix_sources": op5_mix_sources,
    "op6_shard": op6_shard,
    "op7_language_id": op7_language_id,
    "op8_token_ids": op8_token_ids,
    "op9_simhash": op9_simhash,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_token_counts": op12_token_counts,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op3_url_filter": r"""
        WITH a AS (
            SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
            FROM pages),
        b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM a),
        c AS (
            SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM b),
        r(verdict, rule_host, rule_path) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES) + r"""),
        m AS (
            SELECT page_id, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict),
                                   length(rule_host || rule_path)) AS best
            FROM c JOIN r ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
            GROUP BY page_id)
        SELECT c.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
        FROM c LEFT JOIN m ON c.page_id = m.page_id""",
    "op4_decontaminate": r"""
        WITH lowered AS (
            SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents
            UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
        split AS (
            SELECT kind, id, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
        items AS (SELECT id, w, least(10, len(w)) AS n FROM split WHERE kind = 'b' AND len(w) > 0),
        wanted AS (SELECT DISTINCT id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM items, unnest(range(1, len(w) - n + 2)) AS u(i)),
        sizes AS (SELECT DISTINCT n FROM items),
        windows AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM split, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE kind = 'd'),
        hits AS (SELECT doc_id, n, i, id FROM windows JOIN wanted USING (n, win)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
        SELECT s.doc_id, len(s.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id LEFT JOIN found f ON s.doc_id = f.doc_id WHERE s.kind = 'd'""",
    "op5_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CAST('0x' || substr(sha256('mix ' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
        s AS (
            SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
        r AS (SELECT *, k % 3 + 1 AS weight, 3.0 * source_size / (k % 3 + 1) AS ratio FROM s),
        c AS (
            SELECT *, coalesce(sum(3 * source_size) OVER below, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS open_weight,
                   sum(source_size) OVER () AS total
            FROM r WINDOW below AS (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        u AS (SELECT CAST(total - capped AS DOUBLE) / CAST(open_weight AS DOUBLE) AS unit FROM c
              WHERE ratio >= CAST(total - capped AS DOUBLE) / CAST(open_weight AS DOUBLE) ORDER BY ratio, k LIMIT 1),
        t AS (
            SELECT source, source_size, k, CASE WHEN weight * unit > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * unit END AS target
            FROM r, u),
        p AS (
            SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words, 1.0 + k % 3 AS v, 3.0 - k % 3 AS x,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM p),
        m AS (
            SELECT *, epochs * size + least(greatest(words - epochs * source_size - met, 0), size) AS taken,
                   CAST(met AS DOUBLE) / nullif(words, 0) * ((v + x) / 2) AS due FROM e)
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(taken AS BIGINT) AS taken,
               CASE WHEN taken > 0 THEN round(CAST(CASE WHEN due > 0 THEN 2 * due / (v + sqrt(v * v + 2 * (x - v) * due)) ELSE 0 END AS DOUBLE), 9) END AS first_position
        FROM m""",
    "op6_shard": rf"""
        WITH r AS (
            SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents),
        levels AS (
            SELECT doc_id, n_bytes, d, left(lpad(bin(h), 60, '0'), d) AS prefix,
                   sum(n_bytes) OVER (PARTITION BY d, left(lpad(bin(h), 60, '0'), d)) AS shard_bytes
            FROM r, unnest(range(0, 25)) AS u(d)),
        fits AS (SELECT * FROM levels WHERE shard_bytes <= {sharding.MAX_BYTES} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1)
        SELECT doc_id, n_bytes, 'b' || prefix AS shard, CAST(d AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM fits""",
    "op10_warc": r"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
                   FROM pages),
        u AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM t)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM u""",
    "op11_phrases": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        sizes AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
        f AS (
            SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f FROM w, unnest(range(1, 5)) AS u(m), unnest(range(1, len(w) - m + 2)) AS v(i)
            GROUP BY ALL HAVING count(*) >= 30),
        within AS (
            SELECT lang, part, max(f) AS longer FROM (
                SELECT lang, f, g[:m - 1] AS part FROM f WHERE m > 2 UNION ALL SELECT lang, f, g[2:] FROM f WHERE m > 2) GROUP BY ALL),
        kept AS (
            SELECT f.* FROM f LEFT JOIN within x ON f.lang = x.lang AND f.g = x.part
            WHERE m > 1 AND (longer IS NULL OR 100 * longer < 80 * f)),
        cuts AS (
            SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * c.f // (x.f + y.f) AS score
            FROM kept c, unnest(range(1, m)) AS u(k) JOIN f x ON x.lang = c.lang AND x.g = c.g[:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
               a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM best b JOIN sizes s ON b.lang = s.lang QUALIFY rank <= 2000""",
}
