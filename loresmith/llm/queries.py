"""The queries of the training-data operators, each over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, exact_dedup, hpylm, media_wav, nbest, near_dedup, packing, subword_classifier, token_spans, warc
from .staging import small_batches

WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op2_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_texts(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) == 2)


def op3_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = bitpack.write_token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)
    return bitpack.read_token_shards(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule="largest")


def op5_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_wav.wav_fingerprints(media_wav.to_wav_column(table(spark, sf_dir, "documents")))
    codes, times = F.array_join("codes", ","), F.array_join("times", ",")
    return found.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("codes").cast("string"), F.md5(codes.cast("binary")), F.md5(times.cast("binary"))).alias("feature"),
    )


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, folder).select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op7_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1, capacity=4096)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(pieces, "length", 4096)


def op8_n_best_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.n_best_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


def op9_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op10_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    model = subword_classifier.fit(docs, table(spark, sf_dir, "labels").where(~held_out), "quality")
    return subword_classifier.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_pitman_yor_scores,
        op3_bit_packed_ids,
        op4_section_token_counts,
        op5_wav_fingerprints,
        op6_warc_salvage,
        op7_configuration_packing,
        op8_n_best_segmentations,
        op9_bagminhash_classes,
        op10_subword_quality,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
