"""The queries of the text operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.llm import bpe, jaccard_join, kneser_ney, line_dedup, media, mixing, periodic_runs, quality_rules, recurrent_lm, source_divergence, toxicity, url_filters, warc
from trackmill.llm.common import table

#: Vocabulary file of the public byte-level tokenizer.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.scored(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "dedup.n_lines", "dedup.n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.interleave(docs).select("doc_id", "source", "mix.*")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes")
    return quality_rules.judge(docs, keep_text=False).select("doc_id", *[F.col(f"quality.{c}") for c in names])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    names = ("host", "path", "rule", "verdict", "template", "purity")
    return url_filters.judge(pages).select("page_id", *[F.col(f"filter.{c}") for c in names])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def text_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_quality_rules counts, without the verdict of its model."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return op7_quality_rules(spark, sf_dir).select("doc_id", *names)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_url_filters reads from urls and explicit rules, without the verdict of its tree."""
    return op10_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP2_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS raw FROM l
), f AS (
  SELECT doc_id, raw, ls[raw] AS line,
         len(list_filter(regexp_split_to_array(ls[raw], '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w
  FROM e
), g AS (
  SELECT doc_id, raw, line, w, row_number() OVER p AS ln, sum(w) OVER p AS c
  FROM f WHERE w > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY raw)
), p AS (
  SELECT doc_id, a.ln AS s, b.ln AS t FROM g a JOIN g b USING (doc_id)
  WHERE b.ln >= a.ln AND b.c - a.c + a.w >= 50 AND (b.c - b.w - a.c + a.w < 50 OR b.c - a.c < 50)
), body AS (
  SELECT doc_id, list(line ORDER BY ln) AS ls FROM g GROUP BY doc_id
), q AS (
  SELECT p.doc_id, s, t, array_to_string(ls[s:t], chr(10)) AS content FROM p JOIN body USING (doc_id)
), first AS (
  SELECT content, min(struct_pack(d := doc_id, s := s)) AS fst FROM q GROUP BY content HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, t + 1)) AS ln FROM q JOIN first USING (content)
  WHERE doc_id <> fst.d OR s <> fst.s
), rest AS (
  SELECT f.doc_id, count(*) AS n_lines, count(gone.ln) AS n_deleted,
         string_agg(CASE WHEN gone.ln IS NULL THEN f.line END, chr(10) ORDER BY f.raw) AS kept,
         count(*) FILTER (WHERE gone.ln IS NULL AND f.w > 0) AS solid
  FROM f LEFT JOIN g ON f.doc_id = g.doc_id AND f.raw = g.raw
  LEFT JOIN gone ON gone.doc_id = g.doc_id AND gone.ln = g.ln
  GROUP BY f.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
       sha256(CASE WHEN coalesce(n_deleted, 0) = 0 THEN coalesce(d.text, '') WHEN solid = 0 THEN '' ELSE kept END) AS text_sha256
FROM documents d LEFT JOIN rest USING (doc_id)
"""


COUNTS_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM d, unnest(range(1, greatest(1, len(ws) - 6))) AS t(i)
), twice AS (
  SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT win.doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.k = twice.k) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), c AS (
  SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN hit ON hit.doc_id = d.doc_id
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
"""


RULES_SQL = """
WITH r(rule) AS (VALUES ('org/'), ('example.org/es/'), ('example.org/en/1'), ('com/fr/'), ('com/de/')
), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
), f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule FROM p JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id
)
SELECT p.page_id, host, path, f.rule FROM p LEFT JOIN f ON f.page_id = p.page_id
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w
), t AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (
  SELECT u, v FROM p UNION ALL SELECT v, u FROM p
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id WHERE r.c < e.v
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(sh)
"""

OP12_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, strlen(html) AS n, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p
), b AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, 5 * i + 1, 5) AS BIGINT)) AS parts FROM h
)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((parts[1 + j // 4] >> (5 * (3 - j % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact
FROM b
"""


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS u,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), o AS (
  SELECT lang, source, u, unnest(ts) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS lc FROM o GROUP BY lang, term HAVING count(DISTINCT u) >= 3
), c AS (
  SELECT o.lang, o.source, o.term, count(*) AS c FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY o.lang, o.source, o.term
), v AS (
  SELECT lang, count(*) AS v, sum(lc) AS n FROM k GROUP BY lang
), n AS (
  SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v) AS p,
         1 + (1000000000::HUGEINT * (k.lc + 1)) // (v.n + v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), parts AS (
  SELECT pairs.lang, pairs.source, 'pair' AS part, pairs.item, coalesce(s.value, 0) AS value
  FROM pairs LEFT JOIN s ON s.lang = pairs.lang AND s.source = pairs.source AND s.item = pairs.item
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict:
    return {
        "op1_recurrent_lm": op1_recurrent_lm,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_mixing": op4_mixing,
        "op5_bpe": op5_bpe,
        "op6_media_columns": op6_media_columns,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_url_filters": op10_url_filters,
        "text_quality_counts": text_quality_counts,
        "url_rules": url_rules,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_warc": op12_warc,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict:
    return {"op2_line_dedup": OP2_SQL, "op9_jaccard_join": OP9_SQL, "op12_warc": OP12_SQL, "text_quality_counts": COUNTS_SQL, "url_rules": RULES_SQL, "op13_source_divergence": OP13_SQL}
