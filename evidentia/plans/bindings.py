"""The engine's relations bound to the test tables.

A result profile is a line item: supplier = paper, brand = dataset, type = model, size = model size, nation =
language, return flag = metric, line status = setting, extended price = value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same binding in SQL, as a CTE body that oracles start from.
PROFILES_SQL = """
  SELECT concat_ws('-', CAST(l_orderkey AS varchar(30)), CAST(l_linenumber AS varchar(30)), CAST(l_partkey AS varchar(30)), CAST(l_suppkey AS varchar(30))) AS profile_id,
         'S' || CAST(l_suppkey AS varchar(30)) AS paper_id,
         'S' || CAST(l_suppkey AS varchar(30)) || ':' || CAST(year(l_shipdate) AS varchar(30)) AS chunk_id,
         p_type AS model, p_brand AS dataset, nullif(n_name, 'NATION_3') AS language, l_returnflag AS metric,
         l_linestatus AS setting, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS model_size,
         l_extendedprice AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reported result; every condition may be null."""
    t = lambda name: table(spark, sf_dir, name)
    paper = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("profile_id"),
            paper.alias("paper_id"),
            F.concat(paper, F.lit(":"), F.year("l_shipdate").cast("string")).alias("chunk_id"),
            F.col("p_type").alias("model"),
            F.col("p_brand").alias("dataset"),
            F.expr("nullif(n_name, 'NATION_3')").alias("language"),
            F.col("l_returnflag").alias("metric"),
            F.col("l_linestatus").alias("setting"),
            F.expr("CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END").alias("model_size"),
            F.col("l_extendedprice").alias("value"),
        )
    )
