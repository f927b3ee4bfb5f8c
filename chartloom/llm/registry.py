"""The queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm import avi, bpe, divergence, infill, langid, licenses, linedup, packing, quality, sharding, simhash, tokenfiles, warc
from chartloom.llm.shared import table, written


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, budget=4, similarity=None)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(langid.document_evidence(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator over web pages, whose markup and addresses are evidence; the text model is that of the documents."""
    fitted = langid.fit(langid.document_evidence(table(spark, sf_dir, "documents")))
    return langid.identify(langid.page_evidence(table(spark, sf_dir, "pages")), fitted).withColumnRenamed("id", "page_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = F.lit(1_600_000_000) + F.pmod(F.xxhash64("page_id"), F.lit(100_000_000))  # the table has no times
    index = warc.capture_index(table(spark, sf_dir, "pages").select("page_id", "url", "html", captured.alias("ts")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    return found.select("doc_id", "text", "removed_lines", "removed_words")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op8_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(avi.write_media(table(spark, sf_dir, "documents")), "media")
    read = avi.read_media(media)
    clips = F.concat_ws(",", F.transform("clips", lambda c: F.concat_ws("-", c.first_frame.cast("string"), c.last_frame.cast("string"))))
    feature = F.concat(F.lit("frames="), "frames", F.lit(";mean="), "mean_grey", F.lit(";shots="), F.size("clips"), F.lit(";clips="), clips)
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=3, top=200)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.stored_and_filled(table(spark, sf_dir, "documents"), seed=1, infill_percent=90, spm_percent=20))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def queries() -> dict:
    every = (op1_simhash, op2_language, op3_warc, op4_packing, op5_sharding, op6_line_dedup, op7_quality, op8_avi, op9_token_files, op10_bpe, op11_divergence, op12_infill, op13_licenses, pages_language)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _WARC, "op11_divergence": _DIVERGENCE, "op12_infill": _INFILL}


_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

#: All arithmetic in 128 bits; p and q for every kept term of every group, pairs and terms from them.
_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT row_id) >= 3),
     v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
     n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
     g AS (SELECT DISTINCT lang, source FROM d),
     a AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
     p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + v.v) AS p FROM a JOIN v USING (lang)),
     m AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM a GROUP BY 1, 2),
     q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + v.v) AS q FROM m JOIN v USING (lang)),
     s AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
     pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
     terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS low, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS high FROM u),
     f AS (SELECT doc_id, t, n, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s,
                  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""
