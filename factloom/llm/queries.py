"""The queries of this subpackage: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import centroids, chat, exact_dedup, language, licenses, near, negatives, packing, pieces, quality, repeats, urls, warc
from factloom.llm.store import new_path

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out())
    return language.identify(docs, model).withColumn("held_out", language.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, urls.fit(pages, RULES))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_read(spark, sf_dir, "documents"), PIECES)


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write(warc.deduplicated(_read(spark, sf_dir, "pages")), path)
    return warc.read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), *BYTES)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return negatives.mine(_read(spark, sf_dir, "embeddings").withColumn("label", F.coalesce(moved, F.col("label"))))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_url_filter, op4_exact_dedup, op5_quality_rules, op6_chat_rotation, op7_sentencepiece, op8_warc_revisits, op9_packing, op10_jaccard_join, op11_hard_negatives, op12_suffix_dedup, op13_centroid_clustering)}

_WHITE = r"[\x20\x09-\x0D]"
ORACLE_SQL = {
    "op2_license_scan": licenses.SQL,
    "op4_exact_dedup": f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
""",
    "op6_chat_rotation": chat.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_suffix_dedup": repeats.SQL,
    "op13_centroid_clustering": centroids.sql(),
}
