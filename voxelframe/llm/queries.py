"""The registered queries of these operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import bpe, interactions, jaccard, langid, mixing, packing, pii, ppm, quality, sketches, substrings, warc, whitening
from voxelframe.llm.common import crc_mod, read
from voxelframe.session import scratch_path


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 10) == 0, F.lit(True))
    return ppm.score(read(spark, sf_dir, "documents"), ~held_out).withColumn("held_out", held_out)


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.apply(docs, quality.estimate(docs))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.predict(docs, langid.fit(docs, ~held_out)).withColumn("held_out", held_out)


def op6_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_versions(read(spark, sf_dir, "documents"))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"), with_masked=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))).drop("url")


def op10_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read(spark, sf_dir, "documents"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_best_fit_packing, op3_ppm_score, op4_quality_cascade, op5_language_id, op6_iblt_fingerprints, op7_pii_spans,
                                   op8_byte_bpe, op9_warc_archives, op10_jaccard_components, op11_source_mix, op12_filter_audit, op13_whitening)}
WORD = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {"op11_source_mix": mixing.ORACLE, "op12_filter_audit": interactions.ORACLE, "op4_quality_cascade": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY 1),
f AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY 1, 2)
      GROUP BY 1),
m AS (SELECT doc_id, t, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, coalesce(top, 0) AS top,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\v\f\r]*$'))) AS n_ellipsis
      FROM w LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars NOT BETWEEN 2 * n_words AND 25 * n_words OR 10 * n_symbols > 3 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 2 * len(regexp_extract_all(t, '\p{{L}}')) < word_chars
            OR 2 * len(regexp_extract_all(t, '[A-Z]')) > word_chars OR 10 * top > 4 * n_words OR 10 * n_ellipsis > 3 * n_lines) AS kept
FROM b""", "op9_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages),
x AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS s, f FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM x"""}
