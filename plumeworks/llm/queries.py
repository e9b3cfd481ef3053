"""One query for each operator over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, clusters, lines, packing, pii, quality, simhash, tokens, topk, toxicity, urls, warc, wordbpe
from .common import checkpoint_folder, table

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
POLICY = "v1"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return of.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), POLICY)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lines.drop_lines(table(spark, sf_dir, "documents"), counts=("lines_before", "lines_after"))
    return of.select("doc_id", "text", "lines_before", "lines_after")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digest_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_in_documents(docs, pii.train(docs))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(table(spark, sf_dir, "pages"), f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return warc.read(index, payloads=False).select(long("id", "page_id"), "payload_bytes", "payload_digest", "record_type", long("refers_to_id", "refers_to"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = clusters.cluster(table(spark, sf_dir, "embeddings"))
    return of.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_toxicity, op3_url_filters, op4_simhash, op5_quality_rules, op6_top_k, op7_line_dedup, op8_token_counts, op9_bpe, op10_pii, op11_warc, op12_clusters, op13_filter_audit)
}

_URLS = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^?#]*') ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(rest, '')[length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1:] AS path FROM p
), r AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d
), t AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), u AS (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) > 1 AND c IS NOT NULL AS twice FROM t
), v AS (SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered FROM u WINDOW o AS (PARTITION BY r ORDER BY i)
), n AS (SELECT r, count(*) FILTER (covered) AS n_repeat_words FROM v GROUP BY r
), c AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r
), l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), k AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_kinds FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (coalesce(n_lines, 0) - coalesce(n_kinds, 0))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r) LEFT JOIN k USING (r)
), b AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, n_words > 1000000 AS f2, word_chars < 2 * n_words AS f3,
         word_chars > 15 * n_words AS f4, 10 * n_symbols > 3 * n_words AS f5, 10 * n_dup_lines > 3 * n_lines AS f6 FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
       (f0::BIGINT + 2 * f1::BIGINT + 4 * f2::BIGINT + 8 * f3::BIGINT + 16 * f4::BIGINT + 32 * f5::BIGINT + 64 * f6::BIGINT)::BIGINT AS failed_bits,
       f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6) AS kept FROM b
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), x AS (SELECT r, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d WHERE text IS NOT NULL
), n AS (SELECT source, line, count(DISTINCT text) AS n FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line
), h AS (SELECT source, count(DISTINCT text) AS total FROM d WHERE text IS NOT NULL GROUP BY source
), b AS (SELECT n.source, line FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source WHERE n >= 3 AND n > 0.05 * total
), k AS (SELECT x.r, string_agg(x.line, chr(10) ORDER BY i) AS text, count(*) AS lines_after FROM x LEFT JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.line = b.line WHERE b.line IS NULL GROUP BY x.r)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(len(ls), 0)::BIGINT AS lines_before, coalesce(lines_after, 0)::BIGINT AS lines_after FROM d LEFT JOIN k USING (r)
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha256(html) AS digest FROM p
), f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""


def _clusters_sql(k: int = clusters.K, rounds: int = clusters.ROUNDS, dim: int = clusters.DIM) -> str:
    """The rounds one after another: distances to all centroids, the nearest, the floors of the means."""
    steps = [f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({clusters.SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (SELECT (row_number() OVER (ORDER BY sha256('{clusters.SALT}:' || coalesce(vec_id::VARCHAR, '')), e) - 1)::INTEGER AS c, e FROM v QUALIFY c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
d{n} AS (SELECT r, c, list_sum(list_transform(list_zip(v.e, c{n}.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{n}
), a{n} AS (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""
x{n} AS (SELECT r, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v
), m{n} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM x{n} JOIN a{n} USING (r) GROUP BY c, i
), f{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM m{n} GROUP BY c
), c{n + 1} AS (SELECT c, coalesce(f{n}.e, c{n}.e) AS e FROM c{n} LEFT JOIN f{n} USING (c))""")
    return ",".join(steps) + f"""
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)
"""


_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id
), s AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INTEGER + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INTEGER + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INTEGER
         + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INTEGER AS mask
  FROM d LEFT JOIN g USING (doc_id)
), m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM s GROUP BY part, mask
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b
), o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM l p, l q, l r, l s, l t
  WHERE p.b | q.b | r.b | s.b | t.b = 31
), k AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step, bits FROM o
), j AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INTEGER AS before FROM k
), c AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0), 0)::BIGINT AS toxic_lost
  FROM m CROSS JOIN j GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c
"""

ORACLE_SQL = {"op3_url_filters": _URLS, "op5_quality_rules": _QUALITY, "op6_top_k": _TOP_K, "op7_line_dedup": _LINES, "op11_warc": _WARC, "op12_clusters": _clusters_sql(), "op13_filter_audit": _AUDIT}
