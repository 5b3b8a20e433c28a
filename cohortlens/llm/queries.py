"""The queries opN: each operator over its whole table, with the digest columns its result is compared by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, decontaminate, line_dedup, lm_score, minhash, quality_rules, quality_trees, ranked_search, repeats, sentencepiece_codec, token_counts, token_files, warc
from .common import read_table
from .oracles import ORACLES
from ..session import scratch_path

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, folder, "documents"), rules=minhash.FOUR_WORDS)


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(read_table(spark, folder, "documents"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    done = sentencepiece_codec.encode_and_decode(read_table(spark, folder, "documents"), tokenizer(PIECES))
    return done.select("doc_id", "n_chars", "n_pieces", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "same")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    to = scratch_path(spark, "token-files")
    token_files.write_ids(read_table(spark, folder, "documents"), tokenizer(WORDS), to, end_id=1)
    return token_files.read_digests(spark, to)


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, folder, "documents"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, folder, "documents"), tokenizer(PIECES))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    to = scratch_path(spark, "warc")
    warc.write_warc(read_table(spark, folder, "pages"), to)
    records = warc.read_warc(spark, to, payloads=False)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    return records.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce("block_digest", "digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"),
    )


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("row.text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.clean(read_table(spark, folder, "documents")).drop("text")


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(read_table(spark, folder, "embeddings"))


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_trees.classify(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_lm_score,
        op3_sentencepiece,
        op4_token_files,
        op5_suffix_dedup,
        op6_token_counts,
        op7_warc,
        op8_decontaminate,
        op9_line_dedup,
        op10_quality_rules,
        op11_ranked_search,
        op12_centroid_clusters,
        op13_quality_classifier,
        pipeline,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
