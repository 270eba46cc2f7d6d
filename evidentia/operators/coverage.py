"""Requests of named conditions against reported results: held alone, held together, and which condition to blame.

A request names some of the fields; a null or empty condition isn't asked for. Requests are a stated query set, sent to
the results in blocks of BLOCK. They meet the distinct combinations of the fields, not the results: names are compared
once a combination, and only combinations that fit are joined back by equality.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.conditions import agree, features

FIELDS = ("model", "dataset", "language")
#: The condition to blame is the first of these without which a result holds the others.
BLAME = ("language", "dataset", "model")
#: Requests sent at once.
BLOCK = 1000

Requests = Sequence[tuple]


def _blocks(found: DataFrame, asked: Requests, fields: Sequence[str]) -> list[DataFrame]:
    schema = "request_id int, " + ", ".join(f"r_{f} string" for f in fields)
    return [found.sparkSession.createDataFrame(list(asked[i : i + BLOCK]), schema) for i in range(0, max(len(asked), 1), BLOCK)]


def _given(field: str) -> Column:
    return F.coalesce(F.col(f"r_{field}"), F.lit("")) != ""


def _held(field: str) -> Column:
    """The condition is asked for and covered."""
    return agree(field, F.col(f"_asked_{field}"), F.col(f"_seen_{field}"))


def _fits(field: str) -> Column:
    return ~_given(field) | _held(field)


def _combinations(found: DataFrame, block: DataFrame, fields: Sequence[str], test: Column) -> DataFrame:
    """Distinct combinations of the fields with the requests they pass the test with, features of both beside them."""
    seen = found.select(*fields).distinct().select(*fields, *[features(f, F.col(f).cast("string")).alias(f"_seen_{f}") for f in fields])
    sent = block.select("*", *[features(f, F.col(f"r_{f}")).alias(f"_asked_{f}") for f in fields])
    return seen.join(F.broadcast(sent), test)


def _back(found: DataFrame, combinations: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The results behind combinations, by equality of the fields (null equals null)."""
    own = combinations.select(*[F.col(f).alias(f"_{f}") for f in fields], *[c for c in combinations.columns if c not in fields])
    same = reduce(and_, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields])
    return found.join(own, same).drop(*[f"_{f}" for f in fields])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def matching_results(found: DataFrame, asked: Requests, fields: Sequence[str] = FIELDS) -> DataFrame:
    """request_id and the columns of ``found``: results that cover every condition of a request.

    A request without conditions matches nothing. Repeated rows are each returned; an empty table gives an empty one.
    """

    def one(block: DataFrame) -> DataFrame:
        fit = _combinations(found, block, fields, reduce(or_, map(_given, fields)) & reduce(and_, map(_fits, fields)))
        return _back(found, fit.select("request_id", *fields), fields).select("request_id", *found.columns)

    return _union([one(block) for block in _blocks(found, asked, fields)])


def chunks_recording(found: DataFrame, asked: Requests, missing: str = "language", limit: int = 4, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(request_id, chunk_id, n, k): the first ``limit`` chunks in which one result covers every condition of a request.

    They rank by n, how many of their results cover the ``missing`` condition, then by name. A request that doesn't
    ask for ``missing`` gets none.
    """

    def one(block: DataFrame) -> DataFrame:
        some = _combinations(found, block, fields, _held(missing)).select("request_id", *fields, reduce(and_, map(_fits, fields)).alias("full"))
        per = _back(found.select("chunk_id", *fields), some, fields).groupBy("request_id", "chunk_id").agg(F.count("*").alias("n"), F.bool_or("full").alias("full"))
        return per.filter("full").withColumn("k", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("n"), "chunk_id"))).filter(F.col("k") <= limit).drop("full")

    return _union([one(block) for block in _blocks(found, asked, fields)])


def joint_coverage(found: DataFrame, asked: Requests, fields: Sequence[str] = FIELDS, blame: Sequence[str] = BLAME) -> DataFrame:
    """Per request: what is covered alone, whether one result holds all, and which condition to blame if none does.

    ``has_f`` is null for conditions not asked for. ``joint`` is null below two conditions. Only one condition is blamed:
    the first in ``blame`` without which a result holds the others; if there is none, ``all``. ``n_covered`` counts the
    conditions but for those blamed.
    """

    def one(block: DataFrame) -> DataFrame:
        seen = _combinations(found, block, fields, reduce(or_, map(_held, fields)))
        seen = seen.select("request_id", *[_held(f).alias(f"held_{f}") for f in fields], *[_fits(f).alias(f"fits_{f}") for f in fields])
        fits = {f: F.col(f"fits_{f}") for f in fields}
        without = [F.bool_or(reduce(and_, [fits[g] for g in fields if g != f])).alias(f"without_{f}") for f in fields]
        per = seen.groupBy("request_id").agg(F.bool_or(reduce(and_, fits.values())).alias("full"), *[F.bool_or(f"held_{f}").alias(f"held_{f}") for f in fields], *without)
        out = block.join(per, "request_id", "left").na.fill(False)
        n_asked = sum((_given(f).cast("int") for f in fields), F.lit(0))
        alone = sum((F.col(f"held_{f}").cast("int") for f in fields), F.lit(0))
        joint = F.when(n_asked >= 2, F.col("full"))
        blamed = reduce(lambda c, f: c.when(_given(f) & F.col(f"without_{f}"), F.lit(f)), blame, F.when(n_asked < 2, F.lit(None).cast("string")).when(F.col("full"), F.lit(None).cast("string"))).otherwise(F.lit("all"))
        out = out.select("request_id", joint.alias("joint"), *[F.when(_given(f), F.col(f"held_{f}")).alias(f"has_{f}") for f in fields], blamed.alias("blamed"), n_asked.alias("_asked"), alone.alias("_alone"))
        return out.withColumn("n_covered", F.when(F.col("joint") | F.col("joint").isNull(), F.col("_alone")).when(F.col("blamed") == "all", F.lit(0)).otherwise(F.col("_asked") - 1)).drop("_asked", "_alone")

    return _union([one(block) for block in _blocks(found, asked, fields)])
