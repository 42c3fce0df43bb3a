"""The registered queries of the operators, with their production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, language_id, packing, quality_classifier, quality_rules, ranked_search, sharding, simhash, substring_dedup, token_files, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(operator: Callable, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(spark, _table(spark, sf_dir, "documents"), *(_table(spark, sf_dir, t) for t in tables))


def _warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark, _table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": _documents(packing.pack),
    "op2_simhash_near_dedup": _documents(simhash.near_duplicates),
    "op3_ring_sharding": _documents(sharding.shard),
    "op4_crf_language_id": _documents(language_id.identify),
    "op5_qgram_decontamination": _documents(decontamination.matches, "benchmark"),
    "op6_host_quality_rules": _documents(quality_rules.judge),
    "op7_difference_cover_dedup": _documents(substring_dedup.digest),
    "op8_dictionary_warc": _warc,
    "op9_levenshtein_toxicity": _documents(toxicity.detect, "labels"),
    "op10_compression_quality": _documents(quality_classifier.classify, "labels"),
    "op11_best_position_search": _documents(ranked_search.search, "benchmark"),
    "op12_token_list_parquet": _documents(token_files.encoded_documents),
    "op13_heap_bound_clustering": lambda spark, sf_dir: centroids.clustered(spark, _table(spark, sf_dir, "embeddings")),
}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLE_SQL: dict[str, str] = {
    "op6_host_quality_rules": rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(source AS VARCHAR), '') AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), places AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM places) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r
), lined AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM split
), rules AS (
  SELECT s.r, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s JOIN lined USING (r) LEFT JOIN covered c ON c.r = s.r
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1 * word_chars OR n_dup_lines > 0.3 * n_words / 10 AS failed
  FROM rules
), hosts AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS k FROM judged GROUP BY host
), moments AS (
  SELECT sum(k) / sum(n) AS mean, avg(k / n * k / n) - avg(k / n) * avg(k / n) - sum(k) / sum(n) * (1 - sum(k) / sum(n)) * avg(1 / n) AS spread FROM hosts
), prior AS (
  SELECT mean, CASE WHEN spread > 0 AND mean * (1 - mean) > 0 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1000.0 END AS strength FROM moments
), verdicts AS (
  SELECT host, (k + mean * strength) / (n + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > 0.3 AND failed) AS kept,
  round(rate, 9) AS host_rate, rate > 0.3 AS host_bad
FROM judged JOIN verdicts USING (host)""",
    "op7_difference_cover_dedup": rf"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), starts AS (
  SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM split WHERE len(w) >= 35)
), covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM starts WHERE n > 1
), words AS (
  SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM split)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN covered USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)""",
    "op8_dictionary_warc": """
WITH sized AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), same AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM sized
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM same""",
    "op11_best_position_search": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark
), asked AS (
  SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM items) GROUP BY q, item_id, t
), size AS (
  SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), held AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY r, t
), terms AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, size GROUP BY t, n
), scored AS (
  SELECT q, item_id, doc_id, r, CAST(sum(times * terms.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * n) // l)))) AS BIGINT) AS score
  FROM asked JOIN terms USING (t) JOIN held USING (t) JOIN d USING (r), size GROUP BY q, item_id, doc_id, r
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""",
    "op13_heap_bound_clustering": centroids.oracle_sql(),
}
