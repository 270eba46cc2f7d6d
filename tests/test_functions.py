"""Conditions that cover one another, and mined pairs against a plain version."""

import itertools

import pytest
from pyspark.sql import functions as F

from evidentia.functions.conditions import covers
from evidentia.operators.conflicts import mine_pairs

CASES = [
    ("model", "BERT", "BERT-large", True), ("model", "BERT-base", "bert large uncased", False), ("model", "Our BERT", "BERT", True), ("model", "BERT", "RoBERTa", False),
    ("model", "LLaMA 65B", "LLaMA-7B", False), ("model", "LLaMA", "LLaMA 65B", True), ("model", None, "BERT", False), ("model", "BERT", None, False),
    ("dataset", "SQuAD", "SQuAD 2.0", True), ("dataset", "XNLI", "IndicXNLI", False), ("dataset", "GLUE", "MNLI-m", True), ("dataset", "GLUE", "XNLI", False), ("dataset", "ab", "abc", False),
    ("dataset_version", "v2", "2.0", True), ("dataset_version", "1.1", "2.0", False), ("dataset_version", "Version beta", "beta", True),
    ("language", "en", "English", True), ("language", "English-to-German", "de", True), ("language", "en-de", "French", False), ("language", "Hindi", "Kannada", False),
    ("model_size", "1.5B", "1500 million", True), ("model_size", "340M", "110M", False), ("model_size", "large", "Large", True), ("model_size", "large", "340M", False),
    ("setting", "zero-shot", "zero shot, test", True), ("setting", "few-shot", "zero-shot", False), ("setting", "each", "each N", True), ("setting", "own", "other", False),
    ("task", "QA", "question answering", True), ("task", "NER", "NLI", False), ("metric", "accuracy", "Accuracy (%)", True), ("metric", "f1", "f1x", False),
]


@pytest.mark.parametrize("field", sorted({c[0] for c in CASES}))
def test_covers(spark, field):
    own = [(r, o, w) for f, r, o, w in CASES if f == field]
    df = spark.createDataFrame(own, "r string, o string, wanted boolean")
    assert [(x["r"], x["o"]) for x in df.filter(covers(field, F.col("r"), F.col("o")) != F.col("wanted")).collect()] == []


def test_mined_pairs(spark):
    rows = [(f"p{i}", f"S{i % 5}", f"m{i % 2}", "d", "a", 7 if i % 3 else None, "en", "s", float((i * 37) % 23)) for i in range(60)]
    df = spark.createDataFrame(rows, "profile_id string, paper_id string, model string, dataset string, metric string, model_size int, language string, setting string, value double")
    found = {(r["paper_a"], r["paper_b"], r["model"]): (round(r["rel"], 9), r["profile_a"], r["profile_b"]) for r in mine_pairs(df).collect()}
    wanted = {}
    for a, b in itertools.permutations(rows, 2):
        if a[1] < b[1] and a[2] == b[2]:
            x, y = round(a[8] * 100), round(b[8] * 100)
            rel = abs(x - y) / max(abs(x), abs(y), 1)
            own = {r[0]: r for r in rows}
            best = wanted.get((a[1], b[1], a[2]))
            if rel > 0.02 and _extreme(rows, a, b, own) and (best is None or (-rel, a[0], b[0]) < best):
                wanted[a[1], b[1], a[2]] = (-rel, a[0], b[0])
    assert found == {k: (round(-r, 9), a, b) for k, (r, a, b) in wanted.items()}


def _extreme(rows, a, b, own):
    """Is one the highest and the other the lowest of its paper and subject, the first by id among equals?"""
    def first(of, sign):
        return min((r for r in rows if r[1:3] == of[1:3]), key=lambda r: (sign * r[8], r[0]))[0]

    return (a[0] == first(a, -1) and b[0] == first(b, 1)) or (a[0] == first(a, 1) and b[0] == first(b, -1))


def test_mined_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "profile_id string, paper_id string, model string, dataset string, metric string, model_size int, language string, setting string, value double")
    assert mine_pairs(df).count() == 0
