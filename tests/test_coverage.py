"""Requests against a handful of results: names that differ, conditions held apart, and empty tables."""

import pytest

from evidentia.operators.coverage import chunks_recording, joint_coverage, matching_results

RESULTS = [
    ("c1", "BERT-large", "XNLI", "German"),
    ("c1", "BERT", "XNLI", "French"),
    ("c2", "BERT", "SQuAD 2.0", "English"),
    ("c2", "BERT", "SQuAD 2.0", "English"),
    ("c3", "RoBERTa", "MNLI-m", None),
    ("c4", "LLaMA 65B", "IndicXNLI", "Kannada"),
    ("c5", None, None, "Hindi"),
]


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(RESULTS, "chunk_id string, model string, dataset string, language string")


def one(found, *request):
    row = joint_coverage(found, [(1, *request)]).first()
    return row["joint"], row["blamed"], row["n_covered"]


def test_held_together(found):
    assert one(found, "bert", "XNLI", "de") == (True, None, 3)
    assert one(found, "RoBERTa", "GLUE", None) == (True, None, 2)
    assert one(found, "LLaMA", "IndicXNLI", "kn") == (True, None, 3)


def test_one_condition_is_blamed(found):
    assert one(found, "BERT", "XNLI", "Kannada") == (False, "language", 2)
    assert one(found, "BERT", "GLUE", "German") == (False, "dataset", 2)
    assert one(found, "LLaMA 7B", "IndicXNLI", "Kannada") == (False, "model", 2)
    assert one(found, "GPT", "Nothing", "Klingon") == (False, "all", 0)


def test_fewer_than_two_conditions(found):
    assert one(found, "BERT", None, "") == (None, None, 1)
    assert one(found, None, None, None) == (None, None, 0)


def test_matching_results(found):
    got = matching_results(found, [(1, "BERT", "SQuAD", None), (2, None, None, None), (3, None, "XNLI", "en-de")]).collect()
    assert sorted((r["request_id"], r["chunk_id"]) for r in got) == [(1, "c2"), (1, "c2"), (3, "c1")]


def test_chunks_recording(found):
    got = chunks_recording(found, [(1, "BERT", "SQuAD", "English"), (2, "BERT", "XNLI", "Kannada"), (3, "BERT", None, None)]).collect()
    assert [(r["request_id"], r["chunk_id"], r["n"]) for r in got] == [(1, "c2", 2)]


def test_nothing(found):
    empty = found.limit(0)
    assert one(empty, "BERT", "XNLI", None) == (False, "all", 0)
    assert matching_results(empty, [(1, "BERT", None, None)]).count() == 0
    assert joint_coverage(found, []).count() == 0


def test_more_requests_than_a_block(found, monkeypatch):
    monkeypatch.setattr("evidentia.operators.coverage.BLOCK", 2)
    assert joint_coverage(found, [(i, "BERT", "XNLI", "fr") for i in range(5)]).filter("joint").count() == 5
