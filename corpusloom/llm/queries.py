"""The registered queries of this package, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from corpusloom.llm import (
    chat, decontaminate, fingerprints, hard_negatives, html, interpolation, language, lexical, licenses, packing, quality, simhash,
    token_counts,
)
from corpusloom.llm.common import read, written


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.version_fingerprints(read(spark, sf_dir, "documents"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def document_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(read(spark, sf_dir, "documents"))


def fold_of(key: str, parts: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


#: One conversation more: a user and an assistant row whose texts hold the template's control strings.
CONTROL_CONVERSATION = -7
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def formatted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(CONTROL_CONVERSATION, n, role, CONTROL_TEXT) for n, role in enumerate(("user", "assistant"))], rows.schema)
    turns = chat.format_turns(rows.unionByName(control), tokenizer)
    return chat.digests(chat.read_back(turns, tokenizer)).withColumnRenamed("conversation", "conv_id")


def document_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_all(read(spark, sf_dir, "documents"))


def pack_all(documents: DataFrame) -> DataFrame:
    cut = packing.pieces(documents, public_tokenizers.path("word_bpe_49k.json"))
    table = written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(table)


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def language_model(documents: DataFrame) -> language.Model:
    """Learned from the documents that are not held out; a sixteenth of their texts, copies together, sets the rejection limits
    instead of being counted."""
    learned = documents.where(F.coalesce(fold_of("doc_id", 4), F.lit(0)) != 2)
    limits = F.pmod(F.xxhash64("text"), F.lit(16)) == 0
    return language.calibrate(language.train(learned.where(~limits)), learned.where(limits))


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = language.identify(documents, language_model(documents))
    return found.select("doc_id", (F.coalesce(fold_of("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def quality_model(documents: DataFrame, labels: DataFrame) -> quality.Model:
    """Learned from the labels that are not held out."""
    return quality.train(documents, labels.where(fold_of("doc_id", 3) != 1))


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = quality.scores(documents, quality_model(documents, read(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", (F.coalesce(fold_of("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def ranked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def document_log_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = interpolation.score(read(spark, sf_dir, "documents"), F.coalesce(fold_of("doc_id", 7), F.lit(0)) != 2)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_chat_format": formatted_conversations,
    "op2_token_counts": document_token_counts,
    "op3_best_fit_packing": packed_documents,
    "op4_decontamination": contaminated_documents,
    "op5_language_id": document_languages,
    "op6_fingerprints": document_fingerprints,
    "op7_quality": document_quality,
    "op8_html": page_texts,
    "op9_licenses": document_licenses,
    "op10_simhash": near_duplicate_documents,
    "op11_hard_negatives": mined_negatives,
    "op12_lexical_search": ranked_documents,
    "op13_lm_scores": document_log_probabilities,
}
