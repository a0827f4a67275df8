"""One query for each operator, over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.llm import quality_rules as rules
from tickloom.llm.common import read
from tickloom.llm.fingerprint import edited_report
from tickloom.llm.line_dedup import dedup_lines
from tickloom.llm.mixing import mix
from tickloom.llm.near_dedup import near_duplicates
from tickloom.llm.packing import pack_documents
from tickloom.llm.perplexity import classify
from tickloom.llm.substring_dedup import remove_repeated_words
from tickloom.llm.suffix_dedup import remove_repeated_bytes
from tickloom.llm.warc import fixity, to_records


def op5_quality_classifier(spark, sf_dir):
    out = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "low", "high", "kept")


def op6_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op1_line_dedup(spark, sf_dir):
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_suffix_array_dedup(spark, sf_dir):
    return remove_repeated_bytes(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_warc_fixity(spark, sf_dir):
    """All pages against a replica: the last byte of each record of a page_id divisible by 97 has rotted, records of 3
    modulo 89 are lost, and those of 7 modulo 83 stand there a second time, one byte on, as page -1 - page_id."""
    pages = read(spark, sf_dir, "pages")
    records = to_records(pages)
    rotten = F.when(F.col("page_id") % 97 == 0, F.concat(F.expr("left(record, length(record) - 1)"), F.lit("#"))).otherwise(F.col("record"))
    more = records.where("page_id % 83 = 7").select("file", (F.col("offset") + 1).alias("offset"), "length", (-1 - F.col("page_id")).alias("page_id"), "record")
    kept = records.where("coalesce(page_id % 89 != 3, true)").withColumn("record", rotten)
    return fixity(pages, kept.unionByName(more))


def op9_substring_dedup(spark, sf_dir):
    return remove_repeated_words(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_quality_rules(spark, sf_dir):
    out = rules.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_document_fingerprints(spark, sf_dir):
    return edited_report(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_suffix_array_dedup, op3_mixing, op4_document_fingerprints, op5_quality_classifier, op6_minhash_near_dedup, op7_best_fit_packing, op8_warc_fixity, op9_substring_dedup, op10_quality_rules)}

_SPACED = "[^\\x20\\x09-\\x0D]+"
_LEVELS = ", ".join(map(str, rules.LEVELS))
_CHARS = "length(t) - length(translate(t, '{}', ''))"

ORACLES: dict[str, str] = {
    "op10_quality_rules": f"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, '{_SPACED}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_SPACED}')) AS ls FROM a),
win AS (SELECT r, i, w[i:i + 7] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM b)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
gap AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS n FROM again),
rep AS (SELECT r, sum(n)::BIGINT AS n_repeat_words FROM gap GROUP BY r),
c AS (SELECT r, doc_id, lang, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, ({_CHARS.format(rules.SYMBOLS)})::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutter FROM b),
d AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(n_words, 1) AS ws, greatest(word_chars, 1) AS cs FROM c LEFT JOIN rep USING (r)),
e AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed, greatest(
  n_symbols / ws / {rules.UNITS["symbols_per_word"]}, ({_CHARS.format("!")}) / ws / {rules.UNITS["shouts_per_word"]}, ({_CHARS.format("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}) / cs / {rules.UNITS["upper_share"]},
  ({_CHARS.format("0123456789")}) / cs / {rules.UNITS["digit_share"]}, word_chars / ws / {rules.UNITS["mean_word"]}, n_dup_lines / greatest(n_lines, 1) / {rules.UNITS["dup_line_share"]},
  n_repeat_words / ws / {rules.UNITS["repeat_share"]}, stutter / ws / {rules.UNITS["stutter_share"]}) AS score FROM d),
hold AS (SELECT lang, score FROM e WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
lev AS (SELECT unnest([{_LEVELS}])::DOUBLE AS cut),
k AS (SELECT lang, cut, count(*) AS n, count(*) FILTER (score >= cut) AS k FROM hold, lev GROUP BY ALL),
p AS (SELECT lang, cut, CASE WHEN k >= n THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rules.ALPHA}) + (n - i) * ln(1 - {rules.ALPHA})))) END AS p FROM k),
f AS (SELECT lang, cut, max(p) OVER (PARTITION BY lang ORDER BY cut DESC) <= {rules.DELTA} / (SELECT count(DISTINCT lang) FROM hold) AS ok FROM p),
cuts AS (SELECT lang, min(cut) AS cut FROM f WHERE ok GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(score < cut, true) AS kept FROM e LEFT JOIN cuts USING (lang)
""",
    "op8_warc_fixity": """
WITH r AS (
  SELECT page_id, url, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), o AS (
  SELECT *, strlen(record) AS length, coalesce(sum(strlen(record)) OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM r
)
SELECT page_id, 0::BIGINT AS file, "offset", length::BIGINT AS length, sha256("offset" || ':' || length || ':' || sha256(record)) AS digest,
  CASE WHEN page_id % 89 = 3 THEN 'extra' WHEN page_id % 97 = 0 THEN 'corrupt' ELSE 'ok' END AS status
FROM o
UNION ALL
SELECT -1 - page_id, 0, "offset" + 1, NULL, NULL, 'missing' FROM o WHERE page_id % 83 = 7
""",
}
