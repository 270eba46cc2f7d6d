"""Pairs of papers that report different values of one subject, and what tells the two results apart."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.pairs import FirstPairs, KindCounts, Totals

SUBJECT = ("model", "dataset", "metric")
CONDITIONS = ("model_size", "language", "setting")


def extremes(profiles: DataFrame) -> DataFrame:
    """One row for each paper and subject: its highest and its lowest result, the first by id among equal ones."""
    rows = profiles.select("paper_id", *SUBJECT, "profile_id", *CONDITIONS, F.round(F.col("value") * 100).cast("long").alias("cents"))
    kept = F.struct("profile_id", "cents", *CONDITIONS)
    # The least struct is the one wanted, so each side needs one comparison and sums up before the shuffle.
    least = lambda key: F.min(F.struct(key.alias("key"), F.col("profile_id").alias("by"), kept.alias("row")))["row"]
    return rows.groupBy("paper_id", *SUBJECT).agg(least(-F.col("cents")).alias("hi"), least(F.col("cents")).alias("lo"))


def relative_difference(a: Column, b: Column) -> Column:
    """How far two values in hundredths lie apart, as a share of the larger one."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1))


def _side(papers: DataFrame, x: str) -> DataFrame:
    return papers.select(*SUBJECT, F.col("paper_id").alias(f"paper_{x}"), F.col("hi").alias(f"hi_{x}"), F.col("lo").alias(f"lo_{x}"))


def mine_pairs(profiles: DataFrame, least: float = 0.02) -> DataFrame:
    """One row for each two papers and subject whose results lie more than ``least`` apart, with the pair furthest apart.

    Columns: paper_a < paper_b, the subject, rel, and profile, cents and conditions of either side (_a, _b). Of equally
    distant pairs the first by profile ids is taken. Rows meet once for each two papers, without a window over pairs.
    """
    papers = extremes(profiles)
    both = _side(papers, "a").join(_side(papers, "b"), list(SUBJECT)).filter(F.col("paper_a") < F.col("paper_b"))
    return _furthest(both, least)


def _furthest(both: DataFrame, least: float) -> DataFrame:
    """The rows of ``mine_pairs`` for two papers a row, with the highest and the lowest result of either."""
    meeting = lambda a, b: F.struct((-relative_difference(F.col(f"{a}.cents"), F.col(f"{b}.cents"))).alias("nearness"), F.col(f"{a}.profile_id").alias("first"), F.col(f"{b}.profile_id").alias("second"), F.col(a).alias("a"), F.col(b).alias("b"))
    rel = [relative_difference(F.col(f"{a}.cents"), F.col(f"{b}.cents")) for a, b in (("hi_a", "lo_b"), ("lo_a", "hi_b"))]
    both = both.filter(F.greatest(*rel) > least)  # before anything is built for a pair
    both = both.withColumn("best", F.least(meeting("hi_a", "lo_b"), meeting("lo_a", "hi_b")))
    names = {"profile": "profile_id", "cents": "cents", "language": "language", "size": "model_size", "setting": "setting"}
    sides = [F.col(f"best.{x}.{c}").alias(f"{name}_{x}") for name, c in names.items() for x in ("a", "b")]
    return both.select("paper_a", "paper_b", *SUBJECT, (-F.col("best.nearness")).alias("rel"), *sides)


def _by_subject(profiles: DataFrame, pairs: Callable[[pa.Table], pa.Table], columns: str) -> DataFrame:
    """Runs a function of ``functions.pairs`` on the papers of each subject: their pairs are not listed."""

    def run(table: pa.Table) -> pa.Table:
        return pairs(table)

    papers = extremes(profiles.dropna(subset=["paper_id", *SUBJECT, "value"]))
    side = lambda x: [F.col(f"{x}.{c}").alias(f"{x}_{c}") for c in ("profile_id", "cents", *CONDITIONS)]
    types = dict(profiles.dtypes)
    subject = ", ".join(f"{c} {types[c]}" for c in SUBJECT)
    flat = papers.select(*SUBJECT, "paper_id", *side("hi"), *side("lo"))
    # As many parts as the session has: papers are few bytes, but each subject is much work.
    parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return flat.repartition(parts, *SUBJECT).groupBy(*SUBJECT).applyInArrow(run, f"{subject}, {columns}")


def mined_totals(profiles: DataFrame, least: float = 0.02) -> DataFrame:
    """For each subject with pairs of ``mine_pairs``: n_pairs, the largest rel (most), the first profile_a (first_a)."""
    return _by_subject(profiles, Totals(least), "n_pairs long, most double, first_a string")


def mined_kinds(profiles: DataFrame, least: float = 0.02, large: float = 0.5) -> DataFrame:
    """Pairs of ``mine_pairs`` counted (n) for each subject, verdict, differing conditions, and whether rel is above ``large``.

    A condition recorded on both sides that differs explains a pair, a size or language on one side only leaves it open
    (NOT_COMPARABLE), any other pair is GENUINE; only these are told apart by size of rel.
    """
    return _by_subject(profiles, KindCounts(least, large), "verdict string, differing string, large boolean, n long")


def first_pairs(profiles: DataFrame, n: int, least: float = 0.02) -> DataFrame:
    """The first ``n`` pairs of ``mine_pairs`` of each subject: genuine ones, then explained ones, then open ones; by rel from the largest, by papers."""
    return _by_subject(profiles, FirstPairs(least, n), "verdict string, rel double, paper_a string, paper_b string")


#: Datasets of a model that have a bit; those beyond are compared, too, but rule no pair of papers out beforehand.
BITS = 62
#: Parts that the masks of one model are dealt to.
DEALT = 32


def fresh_pairs(profiles: DataFrame, metric: str, least: float = 0.02) -> DataFrame:
    """Pairs of ``mine_pairs`` whose papers have none of the metric for the same model, and whose profiles are in none of it.

    Nearly every two papers have such a pair, so they are ruled out by bits: a paper whose own results of a dataset lie
    far enough apart makes a pair with every paper that has the dataset. Papers with equal bits are compared once, and
    only papers that these leave are joined and mined.
    """
    papers = extremes(profiles.dropna(subset=["paper_id", *SUBJECT, "value"])).persist(StorageLevel.DISK_ONLY)
    used = F.col("metric") == metric
    # One of the two ends of a wide paper is more than ``least`` away from any other value.
    wide = (F.col("lo.cents") >= 1) & (F.col("hi.cents") * (1 - least) ** 2 > F.col("lo.cents") * 1.001)
    bit = F.expr("dense_rank() OVER (PARTITION BY model ORDER BY dataset) - 1")
    bits = papers.filter(used).select("model", "dataset").distinct().withColumn("bit", bit).filter(F.col("bit") < BITS)
    mask = lambda of: F.coalesce(F.bit_or(F.when(used & of & F.col("bit").isNotNull(), F.expr("shiftleft(1L, bit)"))), F.lit(0).cast("long"))
    masks = papers.join(bits, ["model", "dataset"], "left").groupBy("model", "paper_id").agg(mask(F.lit(True)).alias("held"), mask(wide).alias("wide")).persist(StorageLevel.DISK_ONLY)
    kinds = masks.select("model", "held", "wide").distinct()
    own = lambda df, x: df.select("model", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c != "model"])
    one = own(kinds, 1).withColumn("part", F.expr(f"pmod(xxhash64(held_1, wide_1), {DEALT})"))
    two = own(kinds, 2).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALT - 1).cast("long"))))
    once = F.expr("held_1 < held_2 OR (held_1 = held_2 AND wide_1 <= wide_2)")
    left = one.hint("merge").join(two, ["model", "part"]).filter(F.expr("((wide_1 & held_2) | (held_1 & wide_2)) = 0") & once).drop("part")
    met = left.join(own(masks, 1), ["model", "held_1", "wide_1"]).join(own(masks, 2), ["model", "held_2", "wide_2"])
    met = met.filter(F.expr("CASE WHEN held_1 = held_2 AND wide_1 = wide_2 THEN paper_id_1 < paper_id_2 ELSE true END"))
    met = met.select("model", F.least("paper_id_1", "paper_id_2").alias("paper_a"), F.greatest("paper_id_1", "paper_id_2").alias("paper_b")).persist(StorageLevel.DISK_ONLY)
    pairs = _furthest(met.join(_side(papers, "a"), ["model", "paper_a"]).join(_side(papers, "b"), [*SUBJECT, "paper_b"]), least)
    seen = F.max(used).over(Window.partitionBy("model", "paper_a", "paper_b"))
    fresh = pairs.withColumn("seen", seen).filter(~F.col("seen")).drop("seen").persist(StorageLevel.DISK_ONLY)
    # A profile id may be given twice, once with the metric; the few that could be are looked up.
    of_metric = papers.filter(used)
    for x, y in (("a", "b"), ("b", "a")):
        asked = fresh.select(F.col(f"profile_{x}").alias("id")).distinct()
        holders = of_metric.withColumn("id", F.explode(F.array_distinct(F.array("hi.profile_id", "lo.profile_id")))).join(asked, "id", "left_semi")
        both = _side(holders, x).distinct().join(_side(of_metric, y), list(SUBJECT)).filter(F.col("paper_a") < F.col("paper_b"))
        taken = _furthest(both, least).select(f"profile_{x}").distinct()
        fresh = fresh.join(taken, f"profile_{x}", "left_anti")
    return fresh
