"""From raw documents to packed training sequences: the stages of one corpus job.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each result as Parquet in
the shared folder and reads it again for the next stage, so a lost executor never goes back
further than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import compression_bands, histogram_packing, jaccard_groups, ordinal_quality, secret_automaton
from barloom.session import settle


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being good is a half or more and that are not likely toxic, by the model of the labelled documents among the raw ones."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ordinal_quality.trained(raw, ordinal_quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return ordinal_quality.selected(docs, model)


def regular_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose compression lies in the bands."""
    return compression_bands.passing(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with a similarity of 0.8 or more."""
    return jaccard_groups.one_of_each(docs, jaccard_groups.JaccardRule(words=5, percent=80))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secret_automaton.cleaned(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return histogram_packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), payload="crc32")


STAGES = [
    ("quality classifier", good_documents),
    ("quality rules", regular_documents),
    ("n-gram jaccard join", one_of_near_copies),
    ("secret scans", without_secrets),
    ("best-fit packing", packed_sequences),
]
#: SQL can express neither the trained classifier nor zstandard nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
