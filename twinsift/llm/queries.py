"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import (
    bytepairs,
    decontaminate,
    embeddings,
    hmm,
    licenses,
    packing,
    quality,
    simhash,
    spelling,
    tokens,
    urlfilter,
    warc,
    whitening,
)

QUERIES: dict = {}
SQL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids")


@query
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors by cosine of at least 0.95."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probability and selection of every document, learnt from a bounded sample of the labels."""
    docs = table(spark, sf_dir, "documents")
    return quality.select(docs, quality.fit(docs, quality.graded(table(spark, sf_dir, "labels"))))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths of all documents, with suffix sums."""
    return tokens.token_histogram(table(spark, sf_dir, "documents"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), 2048)


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints differ in at most 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), errors=4)


RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL by the longest rule, else by its aliases."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=1000)


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under word counts and a hidden Markov model."""
    return hmm.score_texts(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four leading principal components, with unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


@query
def op12_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids, and of the text decoded from them."""
    return bytepairs.round_trip(table(spark, sf_dir, "documents"))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, their forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

SQL["op1_decontamination"] = f"""
WITH d AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), b AS (
  SELECT item_id, {WORDS} AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)
), pos AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op7_url_filter"] = r"""
WITH RECURSIVE u AS (
  SELECT page_id, html, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node
  FROM u
), t AS (
  SELECT node, host, path, unnest([
    regexp_extract(html, '(?is)<link\b[^>]*?(?:^|[\s"''/])rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''|canonical(?:[\s/>]|$))[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*?(?:^|[\s"''/])rel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''|canonical(?:[\s/>]|$))', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*0*(?:\.0*)?\s*[;,]\s*url\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
  FROM (SELECT node, host, path, rest, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)|<textarea\b.*?(?:</textarea\b|\z)|<template\b.*?(?:</template\b|\z)', ' ', 'g') AS html FROM p) WHERE rest <> ''
), tr AS (
  SELECT node, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(target, position('://' IN target) + 3)
    WHEN starts_with(target, '//') THEN substr(target, 3)
    WHEN starts_with(target, '/') THEN host || target
    ELSE host || CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || target END AS rest
  FROM t WHERE target <> ''
), e AS (
  SELECT node AS a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b FROM tr
), links AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (
  SELECT a AS node, a AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), urls AS (
  SELECT DISTINCT host, path FROM p
  UNION SELECT regexp_extract(node, '^[^/?#]*'), regexp_extract(node, '^[^/?#]*([^?#]*)', 1) FROM reach
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
), aliased AS (
  SELECT r.node FROM reach r JOIN best b ON b.host = regexp_extract(r.seen, '^[^/?#]*') AND b.path = regexp_extract(r.seen, '^[^/?#]*([^?#]*)', 1)
  GROUP BY r.node HAVING bool_or(b.verdict = 'block') AND NOT bool_or(b.verdict = 'allow')
)
SELECT page_id, p.host, p.path, rule, coalesce(best.verdict, CASE WHEN aliased.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN best ON best.host = p.host AND best.path = p.path LEFT JOIN aliased ON aliased.node = p.node
"""

SQL["op8_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""

SQL["op2_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.seen
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
), c AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON node = vec_id
"""
