"""A training corpus from raw documents: quality rules, line dedup, near-duplicates, decontamination, SentencePiece ids.

Each stage takes all documents that the one before it kept and returns the columns of documents; the last one returns ids and the decoded
text. Rows without an id pass the stages that compare documents untouched, since nothing can name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import decontaminate, line_dedup, minhash, quality_rules, sentencepiece_codec
from cohortlens.llm.common import read_table, stage
from cohortlens.llm.queries import PIECES, tokenizer

#: Stretches a worker remembers in the last stage, which shares its executors' memory with the stages before it.
REMEMBERED = 250_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cleaned documents that pass the quality rules (operator 10)."""
    return quality_rules.keep_clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without frequent lines (operator 9)."""
    done = line_dedup.dedup_lines(docs).select("row.*")
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates, on five-word shingles (operator 1)."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(stage(gone, "near-duplicates"), F.col("doc_id") == F.col("__gone"), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (operator 8)."""
    found = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    gone = found.select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(stage(gone, "contaminated"), F.col("doc_id") == F.col("__gone"), "left_anti")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text, ids): SentencePiece ids, and the text as they decode (operator 3)."""
    return sentencepiece_codec.encode_and_decode(docs, tokenizer(PIECES), remembered=REMEMBERED).select("doc_id", F.col("decoded").alias("text"), "ids")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: Components of near-duplicates and merges of pieces have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
