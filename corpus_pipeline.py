"""From raw documents to a training corpus: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfold.llm import decontaminate, mixing, quality, shingle_join, token_store
from nearfold.llm.common import table
from nearfold.llm.queries import tokenizer_file
from nearfold.scale import scratch_path

METADATA = ("n_chars",)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, does not reject."""
    machine = quality.train_quality(docs, table(spark, sf_dir, "labels"), metadata=METADATA)
    return quality.keep_good(docs, machine, metadata=METADATA)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return shingle_join.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as the mix takes them."""
    return mixing.repeat_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token ids in a store; a row for each document (and copy), read back from its files."""
    path = scratch_path(spark, "corpus-tokens")
    token_store.write_store(docs, path, tokenizer_file())
    found = token_store.find(docs.select("doc_id").distinct(), path)
    return token_store.token_digests(found.unionByName(token_store.unindexed(spark, path)), path)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing sources to target weights", mixed_documents),
    ("token-ID / binary output", token_ids),
]

# The classifier is fitted by gradient steps, which SQL cannot express; tests hold each stage
# against a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on `documents`; what each returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"corpus-stage-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
