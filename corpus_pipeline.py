"""A training corpus from raw documents: each stage reads all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import bpe, decontamination, near_duplicates, pseudonyms, quality_rules
from episodica.llm.common import durable, forget
from episodica.llm.queries import pseudonym_key, vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    A null or empty text goes; null ids are judged like others; repeated rows all stay or all go; further columns stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.score_documents(docs, labels).where("kept").select("record.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the row of its smallest id, ties by column order.

    Null ids come last; texts without words are one class; further columns stay.
    """
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null and empty texts have none and stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.with_matches(docs, benchmark)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced by pseudonyms; the character count follows the text and is null for a null text."""
    return pseudonyms.pseudonymize(docs, pseudonym_key(spark)).select(*docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of ids and decoded text; a null text counts as empty."""
    out = bpe.encode_and_decode(docs, vocabulary_path("word_bpe_49k.json"), keep=("doc_id", "lang", "source"), with_decoded=False)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", personal_data),
    ("BPE encoding and decoding", encode),
]

#: The stages hash, permute and tokenize as SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read by the next; an empty table stays empty.

    A stage's table goes as soon as the next one's is written; the last stage reads the only one that is left.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, f"stage{k}")
            if before is not None:
                forget(before)
            before = docs
    return docs
