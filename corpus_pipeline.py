"""A corpus pipeline of five operators; each stage's documents are written as Parquet and read as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, language, mixing, near_dedup, secrets
from tallyforge.llm.scratch import dropped, written


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is known, each judged by its own text; null texts and texts without a letter go. lang stays as it was given."""
    return language.with_language(docs).filter((F.col("lang_pred") != language.UNKNOWN) & F.col("text").isNotNull()).select(*docs.columns)


#: Near-duplicates of the corpus: similarity of five-word shingle sets in percent, wider than op2's own threshold.
NEAR_PERCENT = 80


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of documents linked at NEAR_PERCENT or more.

    Of rows with one doc_id the one with the greatest text is the document; rows without doc_id, which the mix could not draw, go.
    """
    docs = near_dedup.one_row_each(docs)
    kept = near_dedup.near_duplicates(docs, NEAR_PERCENT).filter("kept").select("doc_id")
    # The kept ids grow with the input: never broadcast them, so that small inputs are dealt as large ones are.
    return docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; a document of which no word stays, and one without a word, goes. Repeated rows are cut each."""
    out = decontamination.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.length("text").cast("long")).filter(F.col("text").rlike(r"[^ \t-\r]"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; null and empty texts and repeated rows stay."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(shard, place, doc_id, text): the mixed corpus, drawn blocks shuffled within shards."""
    return mixing.mixed_texts(docs)


STAGES = [("language", keep_identified), ("near_dedup", keep_one_of_each_group), ("decontamination", cut_benchmark), ("secrets", cut_secrets), ("mixing", mix)]

#: Learned, hashed and sampled decisions are not SQL's to make; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is dropped when the next one's is written. Empty tables give empty ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        old, docs = docs, written(out, name)
        dropped(old)
    return docs
