"""A corpus pipeline of five operators; each stage reads what the one before it kept.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.bpe import bpe_round_trip
from evidentia.llm.common import sha_hex, stored, table
from evidentia.llm.decontaminate import decontaminate
from evidentia.llm.jaccard import similar_documents
from evidentia.llm.langid import held_out, identify, train
from evidentia.llm.pii import redact
from evidentia.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction below this is no language.
LEAST_SCORE = 0.5
#: Near copies share at least so many hundredths of their runs of so many words; the query op8 has limits of its own.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that is likelier than all others together."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id; rows without an id have no group and stay."""
    groups = similar_documents(docs, percent=NEAR_PERCENT, size=NEAR_WORDS)
    return docs.join(groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span in its place; n_chars follows the text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left; the ids and a digest of the text they decode to."""
    coded = bpe_round_trip(docs.select(*COLUMNS), tokenizer_file("byte_bpe_50k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", sha_hex(F.col("decoded")).alias("decoded_sha256"))


STAGES = [("language ID", languages), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", contaminated), ("PII", personal_data), ("BPE encoding and decoding", tokens)]

#: Languages are predicted by a trained model and ids come from a tokenizer, neither of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
