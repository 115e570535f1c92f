"""A training corpus from raw documents: each stage works on all that the one before kept.

Every stage but the last returns the columns of ``documents``; the last returns
(doc_id, ids, decoded, n_tokens).

Defined results: a row with a null or empty text is dropped by the first stage, as
it has no words (where there are no labels, nothing else is); rows of one id or
text share their fate in the first stage, and of rows with equal texts or near ones
the second keeps those of the smallest id, so rows that are equal in id and text
all stay; rows without an id are no copies; an empty table gives an empty one;
further columns of documents go through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import bpe, decontaminate, ngram_join, pii, quality
from verisift.llm.queries import pii_key, read, vocabulary
from verisift.scratch import materialize


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary()).withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_personal_data),
    ("BPE encoding and decoding", encode_tokens),
]

#: SQL can't express the stages; the tests hold run() against its stages one by one, and the operators of each against brute force or planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
