"""A corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftloom.llm import common, compression_classifier, lattice, mixing, near_copies, substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, trained on all labels of these documents, rejects go."""
    model = compression_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression_classifier.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id: Jaccard similarity of five-word shingles of 0.8 or more."""
    return near_copies.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 35-word windows that start more than once go; a document of nothing else stays with an empty text."""
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and round_trip of every document of the mix."""
    import public_tokenizers

    return lattice.sentencepiece(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

ORACLE_SQL = None  # compression, fingerprints and merges are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.kept(docs, name.replace(" ", "-"))
    return docs
