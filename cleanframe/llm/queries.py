"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cleanframe.llm import bpe, conversation_repair, decontaminate, embedding_dedup, language_id, ngram_join, oracles, pii, sharding, syncmers, token_alignment, token_counts, toxicity, url_filter
from cleanframe.llm.common import hashed_share, read, utf8
from cleanframe.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

#: The secret of the surrogates in these queries; a user gives their own.
SURROGATE_KEY = "an example key"
#: The URL rules that these queries are asked for.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    """Learned from labelled rows whose crc32(id) mod 3 is not 1."""
    return toxicity.fit(docs, read(spark, sf_dir, "labels").filter(hashed_share("doc_id", 3) != 1))


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).select(
        "doc_id",
        F.coalesce(hashed_share("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_hits",
        "n_quoted",
    )


@query(oracles.SHINGLE_CLASSES)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents"), words=3, num=90, den=100)


@query(oracles.CONTAMINATION)
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(read(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_entities")


@query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(read(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe.decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    judged = url_filter.UrlFilter.fit(url_filter.labelled_by_rules(pages, URL_RULES), URL_RULES)
    return judged.judge(pages, "page_id")


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces and scores of the file, read as a unigram vocabulary."""
    vocabulary = token_counts.UnigramVocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary)


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(hashed_share("doc_id", 5) != 0))
    return language_id.predict(docs, model).select(
        "doc_id", F.coalesce(hashed_share("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages")
    )


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts included, are shuffled into 8 shards whose row counts are at most one apart."""
    text = utf8(F.coalesce("text", F.lit("")))
    return sharding.shuffle_into_shards(read(spark, sf_dir, "documents"), 8).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query(oracles.VECTOR_CLASSES)
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"))


def damaged(turns: DataFrame) -> DataFrame:
    """What op13 repairs: every row's fate is its crc32(conv_id:turn) mod 20; NULLs are one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), fate.alias("fate")).filter("fate != 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


@query()
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    found = conversation_repair.repair(damaged(turns)).conversations()
    ids = turns.select("conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id",
        *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query()
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(read(spark, sf_dir, "documents"))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.align(read(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN)
