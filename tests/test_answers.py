"""Sections against a plain walk over the elements; claims, sources and citations on a handful of rows."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from evidentia.operators.claims import best_sources, citations, numbers, numbers_grounded, recited, repair_citations
from evidentia.operators.sections import NUMBERED, heading_number, label_elements
from evidentia.plans.scalars import SECTIONS

TITLES = ["1 Introduction", "2 Our Approach", "3 Names", "3.2 Results", "Results", "Conclusion", "B Extra", "Appendix", "Abstract", None, "plain words"]


def walk(elements):
    """elements: (kind, text) in order."""
    def named(text):
        found = re.match(NUMBERED, (text or "").strip())
        number, title = (found[1], found[2]) if found else (None, (text or "").strip())
        return number, title, next((s for s, p in SECTIONS.items() if re.search(p, title.lower())), None)

    current = "other" if any(k == "heading" and named(t)[2] == "abstract" for k, t in elements) else "abstract"
    passed, appendix, out = set(), False, []
    for kind, text in elements:
        if kind == "heading":
            number, title, own = named(text)
            depth = number.count(".") + 1 if number else 0
            appendix = appendix or bool(re.search(r"\bappendix\b", title, re.I)) or depth == 1 and number in set("ABCDEFGH") and bool(passed & {"conclusion", "references"})
            if appendix:
                current = "other"
            elif depth <= 1 and own:
                current = own
                passed.add(own)
            elif depth == 1 and "introduction" in passed and not passed & {"experiments", "results"}:
                current = "methods"
        out.append(current)
    return out


def test_sections_follow_the_walk(spark):
    papers = [[("heading" if (i + j) % 4 else "text", t) for j, t in enumerate(order)] for i, order in enumerate(itertools.islice(itertools.permutations(TITLES, 7), 0, 1_600_000, 8111))]
    rows = [(p, i, k, t) for p, own in enumerate(papers) for i, (k, t) in enumerate(own)]
    df = spark.createDataFrame(rows, "paper_id int, position int, kind string, text string")
    found = {(r["paper_id"], r["position"]): r["section"] for r in label_elements(df).collect()}
    assert found == {(p, i): s for p, own in enumerate(papers) for i, s in enumerate(walk(own))}
    assert label_elements(df.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "number"), [("3.1 Setup", "3.1"), ("A. Proofs", "A"), ("IV Data", "IV"), ("2018 saw", ""), ("Setup", ""), (" 2 Data ", "2")])
def test_heading_number(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(heading_number(F.col("t"))).first()[0] == number


def test_numbers_and_citations(spark):
    df = spark.createDataFrame([("v2.1 has 3.5, .7 and 12a; 4. End é5 6",)], "t string")
    assert df.select(numbers(F.col("t"))).first()[0] == ["3.5", "4", "6"]
    row = spark.createDataFrame([("It is so [1, 3], or not [2].",)], "t string").select(citations(F.col("t")), recited(F.col("t"), F.lit(7))).first()
    assert list(row) == [[1, 3, 2], "It is so, or not [7]."]


def test_numbers_grounded(spark):
    rows = [("gets 5", "5 points", None, True), ("gets 5", "x5", ["5"], True), ("gets 5 of 6", "5", [], False), ("gets none", "5", [], False), (None, None, None, False)]
    df = spark.createDataFrame(rows, "claim string, source string, recorded array<string>, wanted boolean")
    assert df.filter(numbers_grounded(F.col("claim"), F.col("source"), F.col("recorded")) != F.col("wanted")).count() == 0


def test_best_sources(spark):
    rows = [
        (1, 0, True, False, 0.4, 0.1), (1, 1, True, False, 0.4, 0.2), (1, 2, False, False, 0.9, 0.0),
        (2, 0, True, False, 0.3, 0.1), (2, 1, False, True, 0.2, 0.0),
        (3, 0, False, False, 0.3, 0.1), (3, 1, False, False, 0.5, 0.1),
        (4, 0, False, True, 0.9, 0.1), (4, 1, True, True, None, 0.1),
    ]
    df = spark.createDataFrame(rows, "claim_id int, place int, cited boolean, supported boolean, entailment double, contradiction double")
    assert {r["claim_id"]: r["place"] for r in best_sources(df).collect()} == {1: 0, 2: 1, 3: 1, 4: 1}


def test_repair_citations(spark):
    sources = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "answer_id int, chunk_id string, number int")
    rows = [(1, "So [1].", True, "b", "So [2]."), (1, "So [2].", True, "b", "So [2]."), (1, "So.", True, "b", "So."), (1, "So [1].", False, "b", "So [1]."), (1, "So [1].", True, "z", "So [1]."), (1, "So [1].", True, None, "So [1].")]
    checks = spark.createDataFrame(rows, "answer_id int, sentence string, supported boolean, chunk_id string, wanted string")
    assert repair_citations(checks, sources).filter(F.col("fixed") != F.col("wanted")).count() == 0
    assert repair_citations(checks, sources).count() == 6
