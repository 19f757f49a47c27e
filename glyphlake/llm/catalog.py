"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import decontam, langid, lines, neardup, packing, quality, sharding, spotsigs, urls, warc
from glyphlake.llm.shared import remainder, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    return quality.classify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs, learn=~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.shuffle(rows, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edits(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), every_line=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_warc,
        op3_best_fit_packing,
        op4_decontamination,
        op5_language_id,
        op6_url_filters,
        op7_sharding,
        op8_near_dedup,
        op9_fingerprints,
        op10_line_dedup,
    )
}

OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT hex, min(page_id) AS first, count(*) AS n FROM p GROUP BY hex)
SELECT page_id, octet_length(payload) AS payload_bytes,
    translate(concat(to_base(('0x' || substr(hex, 1, 10))::BIGINT, 32, 8), to_base(('0x' || substr(hex, 11, 10))::BIGINT, 32, 8),
        to_base(('0x' || substr(hex, 21, 10))::BIGINT, 32, 8), to_base(('0x' || substr(hex, 31, 10))::BIGINT, 32, 8)),
        '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (hex)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op6_url_filters": urls.judge_sql(),
    "op9_fingerprints": spotsigs.edits_sql(),
}
