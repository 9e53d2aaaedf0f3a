"""A corpus pipeline: quality classifier, line dedup, SimHash near-dedup, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
into the cluster's shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.llm import scratch
from petrel.llm.line_dedup import dedup_lines
from petrel.llm.mixing import mixed_rows
from petrel.llm.quality_classifier import accepted, fit
from petrel.llm.sentencepiece_codec import encode
from petrel.llm.simhash import keep_one_similar


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, trained on the labelled ones among these."""
    return accepted(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated runs of lines; n_chars follows."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle similarity of 0.8 or more."""
    return keep_one_similar(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, as repeated rows."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the checks of decoding and parity."""
    return encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", tokens),
]

#: Sampling hashes, fingerprints, a trained network and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs, written = scratch.save(out, f"stage{i}")
        if path:
            scratch.drop(spark, path)
        path = written
    return docs
