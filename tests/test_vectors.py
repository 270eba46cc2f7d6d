"""Nearest vectors by tiles against a plain version, and vectors that are not regular."""

import random

import pytest

from evidentia.operators import vectors as V
from evidentia.plans import load


@pytest.mark.parametrize("tile", [(1 << 16, 1 << 11, 1 << 22), (37, 5, 100)])
def test_nearest(spark, monkeypatch, tile):
    for name, size in zip(("ROWS", "ASKED", "HELD"), tile):
        monkeypatch.setattr(V, name, size)
    r = random.Random(3)
    data = [(i, [r.choice([0.0, 0.5, 1.0, -1.0]) if i % 3 else r.uniform(-1, 1) for _ in range(6)] if i % 5 else [1.0] * 6) for i in range(300)]
    data += [(i, [1.0] * 5 + [1.0 + (i - 350) * 2.0**-22]) for i in range(300, 400)]  # apart by less than is kept
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").cache()
    as_floats, wanted = {x["vec_id"]: x["embedding"] for x in df.collect()}, []
    for q in range(0, 400, 20):
        scores = []
        for i, v in as_floats.items():
            total = 0.0
            for x, y in zip(as_floats[q], v):
                total += x * y
            scores.append((-round(total, 6), i))
        wanted += [(q, i, -s, k + 1) for k, (s, i) in enumerate(sorted(scores)[:10])]
    found = V.nearest(df, df.filter("vec_id % 20 = 0"), 10).select("q", "vec_id", "score", "r").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_regular(spark):
    for row, wanted in (([1.0, 2.0], True), ([1.0], False), ([1.0, None], False), ([1.0, float("nan")], False), (None, False)):
        assert V.regular(spark.createDataFrame([(1, [0.0, 1.0]), (2, row)], "vec_id long, embedding array<float>")) == wanted


@pytest.mark.parametrize("name", ["dense_knn", "rrf_fusion"])
def test_no_cross_join_of_vectors(spark, name):
    plan = load().QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan and "vec_id#" not in "".join(line for line in plan.splitlines() if "Join Cross" in line)
