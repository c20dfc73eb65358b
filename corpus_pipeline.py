"""From raw documents to token ids: five stages, each a table of documents to the next one.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``docs``. ``run`` writes what a stage returns as Parquet in the shared folder and reads it
again as the next one's input, so a lost executor costs at most a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepflow.llm import jaccard, line_dedup, mixing, quality, tokenization
from prepflow.llm.vocabularies import PATTERN, tokenizer_file
from prepflow.session import scratch_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels among them, does not reject."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.train(docs, labels)
    return docs.where(quality.score(model, F.col("text")) >= quality.CUT)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat a run of lines of an earlier one."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = line_dedup.remove_repeated_lines(docs, carry=others)
    kept = kept.select("doc_id", F.col("kept").alias("text"), *others, F.length("kept").cast("bigint").alias("n_chars"))
    return kept.select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-copies: the smallest id, null last, then the smallest text hash."""
    return jaccard.one_of_each_class(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest source once, smaller ones up to twice: repeated rows are repeated documents."""
    return mixing.mix(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row, with their digest and that of the text they decode to."""
    encoded = tokenization.encode_documents(
        docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), PATTERN, give=("ids",)
    )
    return encoded.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("SimHash near-dedup", one_of_each_class),
    ("mixing sources", mixture),
    ("byte-level BPE", token_ids),
]
# No stage can be said in SQL: a fitted model, hashes of windows, SimHash, hashed permutations, BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
