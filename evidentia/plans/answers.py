"""Sections of elements and checks of claims over the test tables, with SQL written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.claims import best_sources, faithfulness, numbers_grounded, relevancy, repair_citations
from evidentia.operators.sections import label_elements

from .bindings import table
from .catalogue import query
from .scalars import SECTIONS

#: Headings of the bound papers, by the order's key.
HEADINGS = ("1 Introduction", "2 Related Work", "3 What We Do", "3.1 Experimental Setup", "4 Strange Names", "5 Main Results", "6 Conclusion", "A Proofs", "Appendix", "Abstract", "Acknowledgements", "Training details", "VII Our Model")
_HEADING = "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADINGS)) + " END"
_ELEMENTS = f"SELECT o_custkey % 997 AS paper_id, o_orderkey AS position, CASE WHEN o_custkey % 2 = o_orderkey % 2 THEN 'heading' ELSE 'text' END AS kind, {_HEADING} AS text FROM "


@query(
    "element_sections",
    f"""
WITH e AS ({_ELEMENTS} orders),
h AS (SELECT *, regexp_extract(text, '^((?:[0-9]{{1,2}}|[A-H]|[IVX]{{1,4}})(?:[.][0-9]{{1,2}})*)[.]?\\s+[A-Z]', 1) AS number FROM e),
t AS (SELECT *, CASE WHEN kind = 'heading' THEN len(string_split(number, '.')) - (number = '')::int END AS depth, lower(trim(text[length(number) + 1:])) AS title FROM h),
n AS (SELECT *, CASE {" ".join(f"WHEN kind = 'heading' AND regexp_matches(title, '{p}') THEN '{s}'" for s, p in SECTIONS.items())} END AS named FROM t),
f AS (SELECT *, min(position) FILTER (depth <= 1 AND named IN ('conclusion', 'references')) OVER p AS ended, min(position) FILTER (depth <= 1 AND named = 'introduction') OVER p AS begun,
        min(position) FILTER (depth <= 1 AND named IN ('experiments', 'results')) OVER p AS told, coalesce(bool_or(named = 'abstract') OVER p, false) AS has_abstract FROM n WINDOW p AS (PARTITION BY paper_id)),
g AS (SELECT *, min(position) FILTER (kind = 'heading' AND (contains(title, 'appendix') OR depth = 1 AND number IN ('A', 'B', 'C', 'D', 'E', 'F', 'G', 'H') AND ended < position)) OVER (PARTITION BY paper_id) AS back FROM f),
s AS (SELECT paper_id, position, has_abstract, CASE WHEN back <= position THEN 'other' WHEN depth <= 1 AND named IS NOT NULL THEN named WHEN depth = 1 AND begun < position AND NOT coalesce(told < position, false) THEN 'methods' END AS setter FROM g)
SELECT paper_id, position, coalesce((SELECT arg_max(b.setter, b.position) FROM s b WHERE b.paper_id = s.paper_id AND b.position <= s.position AND b.setter IS NOT NULL), CASE WHEN has_abstract THEN 'other' ELSE 'abstract' END) AS section FROM s
""",
)
def _element_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = spark.sql(_ELEMENTS + "{orders}", orders=table(spark, sf_dir, "orders"))
    return label_elements(elements).select("paper_id", "position", "section")


_JUDGED = """SELECT l_orderkey AS claim_id, l_linenumber AS place, l_partkey AS part, l_returnflag = 'R' AS cited, l_quantity > 40 AS supported, round(l_discount * 10, 4) AS entailment, round(l_tax, 4) AS contradiction FROM """


@query(
    "best_sources",
    f"""
WITH j AS (SELECT DISTINCT ON (claim_id, place) * FROM ({_JUDGED} lineitem) ORDER BY claim_id, place, part, entailment, contradiction, cited, supported), c AS (SELECT claim_id, bool_or(cited) AS quoted FROM j GROUP BY claim_id),
r AS (SELECT j.*, row_number() OVER (PARTITION BY claim_id ORDER BY supported AND (cited OR NOT quoted) DESC, supported DESC, (cited OR NOT quoted) DESC, entailment DESC, place) AS k FROM j JOIN c USING (claim_id))
SELECT claim_id, supported, entailment, contradiction, place FROM r WHERE k = 1
""",
)
def _best_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = spark.sql(_JUDGED + "{lineitem}", lineitem=table(spark, sf_dir, "lineitem"))
    first = F.min_by(F.struct(*judged.columns), F.struct("part", "entailment", "contradiction", "cited", "supported"))
    return best_sources(judged.groupBy("claim_id", "place").agg(first.alias("x")).select("x.*"))


_SOURCES = "SELECT l_orderkey AS answer_id, concat('c', CAST(l_partkey AS varchar(30))) AS chunk_id, l_linenumber AS number FROM "
_CHECKS = """SELECT o_orderkey AS answer_id, concat('It costs ', CAST(o_custkey AS varchar(30)), CASE o_orderkey % 4 WHEN 0 THEN ' [1]' WHEN 1 THEN ' [2, 3]' WHEN 2 THEN ' [1] of them [4,2]' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN '.' ELSE '' END) AS sentence,
 o_orderstatus <> 'P' AS supported, chunk_id FROM """
_FIRST = "(SELECT answer_id, max(chunk_id) AS chunk_id FROM {sources} GROUP BY answer_id) s"


@query(
    "citation_repair",
    f"""
WITH src AS ({_SOURCES} lineitem), checks AS ({_CHECKS} orders JOIN {_FIRST.format(sources='src')} ON o_orderkey = s.answer_id),
n AS (SELECT c.*, (SELECT max(number) FROM src WHERE src.answer_id = c.answer_id AND src.chunk_id = c.chunk_id) AS number, regexp_extract_all(sentence, '[0-9]+', 0)[2:] AS cited FROM checks c)
SELECT answer_id, CASE WHEN supported AND len(cited) > 0 AND NOT list_contains(cited, CAST(number AS varchar)) THEN regexp_replace(trim(regexp_replace(sentence, '\\s*\\[[0-9, ]+\\]', '', 'g')), '([.]?)$', ' [' || number || ']\\1') ELSE sentence END AS fixed FROM n
""",
)
def _citation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.sql(_SOURCES + "{lineitem}", lineitem=table(spark, sf_dir, "lineitem"))
    checks = spark.sql(_CHECKS + "{orders} JOIN " + _FIRST + " ON o_orderkey = s.answer_id", orders=table(spark, sf_dir, "orders"), sources=sources)
    return repair_citations(checks, sources).select("answer_id", "fixed")


_CLAIMS = """SELECT p_partkey, concat('It gets ', CAST(p_size AS varchar(30)), CASE p_partkey % 3 WHEN 0 THEN ' of 3.50, v2.1' WHEN 1 THEN ' (7)' ELSE '' END) AS claim,
 concat('Row ', CAST(p_size + p_partkey % 2 AS varchar(30)), ': 3.50 and x7.') AS source, CASE WHEN p_partkey % 5 = 0 THEN '7' END AS recorded FROM """
_FOUND = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '[\\pL\\pM\\pN_.]+'), lambda w: regexp_extract(w, '^([0-9]+(?:[.][0-9]+)?)(?:[.]|$)', 1)), lambda w: w <> '')"


@query("claims_grounded", f"WITH c AS ({_CLAIMS} part) SELECT p_partkey, len({_FOUND('claim')}) > 0 AND list_has_all(list_append({_FOUND('source')}, recorded), {_FOUND('claim')}) AS grounded FROM c")
def _claims_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.sql(_CLAIMS + "{part}", part=table(spark, sf_dir, "part"))
    return claims.select("p_partkey", numbers_grounded(F.col("claim"), F.col("source"), F.array_compact(F.array("recorded"))).alias("grounded"))


@query("faithfulness_ratio", "SELECT l_orderkey AS answer_id, round(count(*) FILTER (l_returnflag <> 'R') * 1.0 / count(*), 6) AS ratio, count(*) AS n_statements FROM lineitem GROUP BY 1")
def _faithfulness_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer_id"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("verdict"))
    return faithfulness(verdicts).withColumn("ratio", F.round("ratio", 6))


@query(
    "answer_relevancy",
    """
WITH v AS (SELECT vec_id, vec_id // 4 AS answer_id, list_transform(embedding, lambda x: x::double) AS u FROM embeddings)
SELECT q.answer_id, round(avg(CASE WHEN q.answer_id % 7 = 0 THEN 0 ELSE greatest(0, least(1, list_dot_product(q.u, w.u))) END), 5) AS relevancy FROM v q JOIN v w ON q.answer_id = w.answer_id AND q.vec_id % 4 = 0 AND w.vec_id % 4 > 0 GROUP BY 1
""",
)
def _answer_relevancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("answer_id"), (F.col("vec_id") % 4).alias("_k"), F.col("embedding").alias("vector"))
    asked = v.filter("_k = 0").withColumn("noncommittal", F.col("answer_id") % 7 == 0)
    return relevancy(asked, v.filter("_k > 0")).withColumn("relevancy", F.round("relevancy", 5))
