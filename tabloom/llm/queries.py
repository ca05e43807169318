"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import licenses, mixing, packing, quality, simhash, substrings, toxicity, urls, warc, winnowing

TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stutter", "failed")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(*toxicity.sample(docs, _table(spark, sf_dir, "labels"))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_comparison(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_license_scan, op4_simhash, op5_mixing, op6_substring_dedup, op7_toxicity, op8_warc, op9_winnowing, op10_url_filters)}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN lines ON d.doc_id = lines.doc_id
),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
     + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
     + 32 * (word_chars > 15 * n_words)::INT + 64 * (100 * n_stutter > 30 * n_words)::INT)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = 0 AS kept, n_lines, n_stutter, failed FROM j
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix|' || doc_id) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
    1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
),
k AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM s),
fill AS (
  SELECT a.place, a.cap / a.weight AS ratio,
    ((SELECT sum(source_size) FROM k) - coalesce((SELECT sum(cap) FROM k b WHERE b.place < a.place), 0))
    / (SELECT sum(weight) FROM k b WHERE b.place >= a.place) AS level
  FROM k a
),
final AS (SELECT level FROM fill WHERE level < ratio ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM final)) AS target FROM k),
r AS (
  SELECT doc_id, d.source, size, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
    source_size, target
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (floor(target)::BIGINT // greatest(source_size, 1) * size
   + greatest(0, least(size, floor(target)::BIGINT % greatest(source_size, 1) - ahead)))::BIGINT AS taken
FROM r
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
),
again AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT a.doc_id, string_agg(a.v, ' ' ORDER BY a.p) AS t
  FROM (SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM d) a ANTI JOIN gone ON a.doc_id = gone.doc_id AND a.p = gone.p
  GROUP BY a.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(lost.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

OP8 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS s FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS low FROM x)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(s, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = low THEN NULL ELSE low END AS refers_to
FROM f
"""

OP10 = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
),
rules(rh, rp, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (
  SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN b ON p.page_id = b.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op3_license_scan": licenses.oracle_sql(), "op5_mixing": OP5, "op6_substring_dedup": OP6, "op8_warc": OP8, "op10_url_filters": OP10}
