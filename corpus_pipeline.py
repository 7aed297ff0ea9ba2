"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

1. toxicity: documents that the learned lexicon scores 0.7 or more go.
2. near_duplicates: of each group of documents linked by five-word shingles (Jaccard 0.8 or more) one stays, the smallest id.
3. decontamination: documents with a word inside ten consecutive words of a benchmark item go.
4. personal_data: detected entities get surrogates; no document goes.
5. tokens: every text becomes byte-level BPE ids, which decode to the text again.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cleanframe.llm import bpe, decontaminate, ngram_join, pii, toxicity
from cleanframe.llm.common import read, written_alone
from cleanframe.llm.queries import SURROGATE_KEY, toxicity_model

#: SQL cannot express the learned lexicon, the surrogates or the merges; tests hold the stages against plain versions.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from the labelled documents of the input folder, the same rows whatever an earlier stage dropped."""
    return toxicity.keep_clean(docs, toxicity_model(spark, read(spark, sf_dir, "documents"), sf_dir))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, words=5, num=80, den=100)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = pii.replace(docs, SURROGATE_KEY)
    length = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", length).select(docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): decoded is the text that the ids give back."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, vocabulary)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("decoded"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("personal_data", replace_personal_data),
    ("tokens", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written_alone(spark, partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return docs
