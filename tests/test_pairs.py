"""Pairs counted and ranked without listing them, against the listed pairs."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators.conflicts import SUBJECT, first_pairs, fresh_pairs, mine_pairs, mined_kinds, mined_totals

COLUMNS = "profile_id string, paper_id string, model string, dataset string, metric string, model_size int, language string, setting string, value double"
VERDICT = """CASE WHEN size_a <> size_b THEN 'EXPLAINED' WHEN language_a <> language_b THEN 'EXPLAINED' WHEN setting_a <> setting_b THEN 'EXPLAINED'
 WHEN (size_a IS NULL) <> (size_b IS NULL) OR (language_a IS NULL) <> (language_b IS NULL) THEN 'NOT_COMPARABLE' ELSE 'GENUINE' END"""
DIFFERING = "array_join(filter(array(CASE WHEN size_a <> size_b THEN 'model_size' END, CASE WHEN language_a <> language_b THEN 'language' END, CASE WHEN setting_a <> setting_b THEN 'setting' END), x -> x IS NOT NULL), ',')"
VALUES = {
    "equal products": lambda r: r.choice([1.0, 1.01, 1.02, 1.03, 2.0, 4.0, 8.0, 3.0, 6.0, 50.0, 51.0]),
    "zero, below, large": lambda r: r.choice([0.0, -1.0, -1.01, 1.0, 2.0, 0.01, 671088.64, 1e7, 5.0, None]),
    "spread": lambda r: round(r.uniform(1, 30), 2),
}


@pytest.fixture(scope="module")
def profiles(spark):
    r, rows = random.Random(5), []
    for i in range(1200):
        m = r.randrange(6)
        value = list(VALUES.values())[m % 3](r)
        rows.append((f"p{r.random():.6f}-{i}", f"S{r.randrange(40)}", f"m{m}", "d", "a", r.choice([None, 1, 2, 3]), r.choice([None, "x", "y"]), r.choice(["F", "O"] if m < 3 else ["F", "O", None]), value))
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.fixture(scope="module")
def listed(profiles):
    pairs = mine_pairs(profiles.dropna(subset=["value"]))
    return pairs.withColumn("verdict", F.expr(VERDICT)).withColumn("differing", F.expr(DIFFERING)).withColumn("large", F.expr("verdict = 'GENUINE' AND rel > 0.5")).cache()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_totals(profiles, listed):
    wanted = rows(listed.groupBy(*SUBJECT).agg(F.count("*"), F.max("rel"), F.min("profile_a")))
    assert len(wanted) == 6 and rows(mined_totals(profiles)) == wanted


def test_kinds(profiles, listed):
    assert rows(mined_kinds(profiles)) == rows(listed.groupBy(*SUBJECT, "verdict", "differing", "large").agg(F.count("*")))


@pytest.mark.parametrize("n", [1, 6, 300])
def test_first_pairs(profiles, listed, n):
    place = F.expr("row_number() OVER (PARTITION BY model, dataset, metric ORDER BY CASE verdict WHEN 'GENUINE' THEN 0 WHEN 'EXPLAINED' THEN 1 ELSE 2 END, rel DESC, paper_a, paper_b)")
    wanted = listed.withColumn("k", place).filter(F.col("k") <= n).select(*SUBJECT, "verdict", "rel", "paper_a", "paper_b")
    assert rows(first_pairs(profiles, n)) == rows(wanted)


def test_more_pairs_than_could_be_listed(spark):
    size = "CASE WHEN id < 100 THEN id % 2 END"
    one = spark.range(60000).selectExpr("'p' || id AS profile_id", "'S' || id AS paper_id", "'m' AS model", "'d' AS dataset", "'a' AS metric", f"CAST({size} AS int) AS model_size", "CAST(NULL AS string) AS language", "'F' AS setting", "CAST(1 + id % 2 AS double) AS value")
    assert rows(mined_totals(one)) == [("m", "d", "a", 30000 * 30000, 0.5, "p0")]
    assert rows(mined_kinds(one).select("verdict", "differing", "n")) == [("EXPLAINED", "model_size", 2500), ("GENUINE", "", 29950 * 29950), ("NOT_COMPARABLE", "", 2 * 50 * 29950)]
    assert rows(first_pairs(one, 1).select("verdict", "paper_a", "paper_b")) == [("GENUINE", "S100", "S10001")]


def test_no_pairs(spark):
    none = spark.createDataFrame([], COLUMNS)
    alone = spark.createDataFrame([("p", "S", "m", "d", "a", None, None, None, 1.0)], COLUMNS)
    for df in (none, alone):
        assert mined_totals(df).count() == mined_kinds(df).count() == first_pairs(df, 3).count() == 0


@pytest.mark.parametrize("n_datasets", [2, 70])
def test_fresh_pairs(spark, n_datasets):
    r, data = random.Random(n_datasets), []
    for i in range(260):
        many = n_datasets > 62 or i % 2
        dataset, metric = f"d{r.randrange(n_datasets)}", r.choice("ABC")
        data.append((f"p{i // 2 if i < 40 else i}", f"S{r.randrange(20)}", f"m{r.randrange(2)}", dataset if many else "d0", metric, None, None, "F", r.choice([1.0, 1.01, 1.03, 2.0, 0.0, -3.0, 7.5])))
    df = spark.createDataFrame(data, COLUMNS).cache()
    mined = mine_pairs(df).cache()
    mined.createOrReplaceTempView("mined_of_test")
    wanted = spark.sql("""WITH used AS (SELECT * FROM mined_of_test WHERE metric = 'A') SELECT paper_a, paper_b, model, dataset, metric, profile_a, profile_b FROM mined_of_test m
      WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.profile_a = m.profile_a) AND NOT EXISTS (SELECT 1 FROM used u WHERE u.profile_b = m.profile_b)
        AND NOT EXISTS (SELECT 1 FROM used u WHERE u.paper_a = m.paper_a AND u.paper_b = m.paper_b AND u.model = m.model)""")
    found = fresh_pairs(df, "A").select("paper_a", "paper_b", "model", "dataset", "metric", "profile_a", "profile_b")
    assert 0 < wanted.count() < mined.filter("metric <> 'A'").count() and rows(found) == rows(wanted)


def test_fresh_pairs_of_many_papers(spark):
    two = "SELECT id, metric, value FROM range(40000) LATERAL VIEW stack(3, 'A', 1.0D, 'A', 2.0D, 'B', 1.0D + id % 3) v AS metric, value"
    df = spark.sql(f"SELECT concat_ws('-', id, metric, value) AS profile_id, 'S' || id AS paper_id, 'm' AS model, 'd' AS dataset, metric, 1 AS model_size, 'x' AS language, 'F' AS setting, value FROM ({two}) t WHERE metric = 'B' OR id > 2")
    assert sorted((r["paper_a"], r["paper_b"]) for r in fresh_pairs(df, "A").filter("paper_a IN ('S0', 'S1', 'S2') AND paper_b IN ('S0', 'S1', 'S2')").collect()) == [("S0", "S1"), ("S0", "S2"), ("S1", "S2")]
