"""Claims of an answer against its sources: grounding, the best source, citations put right, and shares supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number that is no part of a word or of a longer number.
NUMBER = r"(?U)(?<![\w.])\d+(?:\.\d+)?(?!\w)"
#: Numbers of sources in brackets.
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def numbers(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.array().cast("array<string>"))


def numbers_grounded(claim: Column, source: Column, recorded: Column) -> Column:
    """Has the claim numbers, and does each stand in the source's text or among the recorded values (an array of text)?"""
    own = numbers(claim)
    known = F.concat(numbers(source), F.coalesce(recorded, F.array().cast("array<string>")))
    return (F.size(own) > 0) & (F.size(F.array_except(own, known)) == 0)


def citations(sentence: Column) -> Column:
    """Numbers cited in a sentence, in order."""
    lists = F.regexp_extract_all(sentence, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda n: n.cast("int"))))


def recited(sentence: Column, number: Column) -> Column:
    """The sentence with its citations replaced by one, before the closing mark."""
    bare = F.trim(F.regexp_replace(sentence, r"\s*" + CITATION, ""))
    end = F.regexp_extract(bare, "[.!?]$", 0)
    return F.concat(F.regexp_replace(bare, "[.!?]$", ""), F.lit(" ["), number.cast("string"), F.lit("]"), end)


def best_sources(judged: DataFrame, claim: str = "claim_id") -> DataFrame:
    """One row a claim: supported, entailment, contradiction and place of its best source.

    judged: (claim, place, cited, supported, entailment, contradiction), a row for each source. Cited sources come
    first, or all where none is cited; another source replaces the best of them only if it supports the claim and that
    one doesn't. Supported goes before entailment, and the smaller place wins a tie. One pass with partial sums, so a
    claim with a third of all rows is spread like any other. Null entailment ranks last.
    """
    found = F.struct(F.col("supported"), F.coalesce(F.col("entailment"), F.lit(-1.0)).alias("rank"), (-F.col("place")).alias("back"), F.col("entailment"), F.col("contradiction"))
    per = judged.groupBy(claim).agg(F.max(F.when(F.col("cited"), found)).alias("own"), F.max(F.when(~F.col("cited"), found)).alias("rest"))
    best = F.when(F.col("own").isNull() | (F.col("rest.supported") & ~F.col("own.supported")), F.col("rest")).otherwise(F.col("own"))
    return per.select(claim, best.alias("best")).select(claim, "best.supported", "best.entailment", "best.contradiction", (-F.col("best.back")).alias("place"))


def repair_citations(checks: DataFrame, sources: DataFrame) -> DataFrame:
    """``checks`` (answer_id, sentence, supported, chunk_id) with ``fixed``: a supported sentence that cites, but not the
    source that supports it, gets that source's number; others stay. sources: (answer_id, chunk_id, number)."""
    own = sources.groupBy("answer_id", "chunk_id").agg(F.max("number").alias("_number"))
    df = checks.join(own, ["answer_id", "chunk_id"], "left")
    cited = citations(F.col("sentence"))
    wrong = F.col("supported") & (F.size(cited) > 0) & F.col("_number").isNotNull() & ~F.array_contains(cited, F.col("_number"))
    return df.withColumn("fixed", F.when(wrong, recited(F.col("sentence"), F.col("_number"))).otherwise(F.col("sentence"))).drop("_number")


def faithfulness(verdicts: DataFrame, answer: str = "answer_id") -> DataFrame:
    """Per answer the share of its statements whose verdict is 1, and how many there are."""
    return verdicts.groupBy(answer).agg(F.avg(F.when(F.col("verdict") == 1, 1.0).otherwise(0.0)).alias("ratio"), F.count("*").alias("n_statements"))


def relevancy(asked: DataFrame, written: DataFrame, answer: str = "answer_id", vector: str = "vector") -> DataFrame:
    """Per answer the mean cosine, between 0 and 1, of its question with the questions written for it; vectors are of
    length one. 0 where the answer is marked noncommittal, whatever was written."""
    dot = F.aggregate(F.zip_with(F.col("_q"), F.col(vector), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = written.join(asked.select(answer, F.col(vector).alias("_q"), F.col("noncommittal").alias("_no")), answer)
    return pairs.groupBy(answer).agg(F.avg(F.when(F.col("_no"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)))).alias("relevancy"))
