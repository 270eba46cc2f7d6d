"""The thin queries over the test tables and their SQL; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .common import sha_hex, table
from .decontaminate import decontaminate
from .html import extract_main_text
from .jaccard import similar_documents
from .langid import held_out, identify, train
from .licenses import scan_licenses
from .oracles import ORACLES  # noqa: F401
from .pii import find_personal_data, spelled
from .quality import judge_quality
from .substrings import remove_repeats
from .unigram import token_counts


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_round_trip(docs, tokenizer_file("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha_hex(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", sha_hex(spelled("base")).alias("base_sha256"), spelled("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, then its id by thousands and by hundreds."""
    docs = table(spark, sf_dir, "documents")
    floor = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    files = docs.select(F.concat_ws("/", "source", floor(1000), floor(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    found = scan_licenses(files, "path", "text")
    return found.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), "path", "license", "score", "origin", "from_path")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", sha_hex(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", sha_hex(F.col("kept_text")).alias("kept_sha256"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_counts, op3_pii, op4_licenses, op5_quality, op6_decontaminate, op7_substrings, op8_jaccard, op9_html, op10_langid)}
