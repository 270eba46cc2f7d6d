"""Ranked retrieval: exact vector search, BM25, rank fusion, and what is measured on rankings."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.operators.vectors import nearest, regular

from .catalogue import query
from .dialect import TABLES, Duck, Spark, sql_query


def dot(d: Spark, a: str, b: str) -> str:
    if type(d) is Spark:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS double) * CAST(y AS double)), CAST(0 AS double), (s, x) -> s + x)"
    return f"list_dot_product(CAST({a} AS double[]), CAST({b} AS double[]))"


_KNN = lambda d, k: f"""SELECT q, vec_id, score, r FROM (SELECT q.vec_id AS q, e.vec_id, round({dot(d, 'q.embedding', 'e.embedding')}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({dot(d, 'q.embedding', 'e.embedding')}, 6) DESC, e.vec_id) AS r
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 20 = 0) t WHERE r <= {k}"""  # noqa: E731
#: Okapi constants, with the floor that rare-term libraries give to terms held by more than half of all texts.
K1, B, EPSILON = 1.5, 0.75, 0.25
_BM25 = lambda d, k: f"""
tok AS (SELECT doc_id, {d.explode}({d.tokens('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY doc_id, term), dl AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY doc_id),
corpus AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT CAST(sum(len) AS double) FROM dl) / (SELECT count(*) FROM documents) AS avg_len), df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
raw AS (SELECT term, ln(total - n + 0.5) - ln(n + 0.5) AS idf FROM df CROSS JOIN corpus), floor_idf AS (SELECT {EPSILON} * avg(idf) AS low FROM raw), idf AS (SELECT term, CASE WHEN idf < 0 THEN low ELSE idf END AS idf FROM raw CROSS JOIN floor_idf),
asked AS (SELECT item_id, {d.explode}({d.tokens('text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
scored AS (SELECT item_id, tf.doc_id, round(sum(idf * n * {K1 + 1} / (n + {K1} * ({1 - B} + {B} * len / avg_len))), 4) AS score FROM asked JOIN tf ON tf.term = asked.term JOIN idf ON idf.term = asked.term JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN corpus GROUP BY item_id, tf.doc_id),
bm25 AS (SELECT item_id, doc_id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0) t WHERE r <= {k})"""  # noqa: E731



def vector_query(name: str, k: int, text: Callable[[Spark, str], str]) -> None:
    """A query whose text takes the first ``k`` neighbours of each asked vector as a relation: by tiles in Spark, by its SQL over vectors that are not regular."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark = spark.newSession()  # its views are not the caller's
        for name in TABLES:
            if re.search(rf"\b{name}\b", text(Spark(), "embeddings")):
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        vectors = spark.table("embeddings")
        if not regular(vectors):
            return spark.sql(text(Spark(), _KNN(Spark(), k)))
        nearest(vectors, vectors.filter("vec_id % 20 = 0"), k).createOrReplaceTempView("neighbours")
        return spark.sql(text(Spark(), "SELECT q, vec_id, score, r FROM neighbours"))

    query(name, text(Duck(), _KNN(Duck(), k)))(run)


vector_query("dense_knn", 10, lambda d, knn: knn)
sql_query("bm25_search", lambda d: f"WITH {_BM25(d, 10)} SELECT item_id, doc_id, score, r FROM bm25")
vector_query("rrf_fusion", 30, lambda d, knn: f"""
WITH {_BM25(d, 30)}, dense AS ({knn}), lists AS (SELECT item_id AS q, doc_id AS id, r FROM bm25 UNION ALL SELECT q, vec_id, r FROM dense),
fused AS (SELECT q, id, round(sum(1e0 / (60 + r)) * CASE WHEN id % 10 = 3 THEN 1.15 ELSE 1 END, 9) AS score FROM lists GROUP BY q, id)
SELECT q, id, score, k FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS k FROM fused) t WHERE k <= 20""")
_RANKED = "SELECT o_custkey AS q, o_orderkey AS id, CAST(floor(o_totalprice) AS bigint) % 17 - 9 AS score, o_orderstatus = 'F' AS relevant, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders"
sql_query("rerank_filter", lambda d: f"""
WITH ranked AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS k, max(score) OVER (PARTITION BY q) AS best FROM ({_RANKED}) t)
SELECT q, id, score, k, best < -3 AS weak FROM ranked WHERE (best >= -3 AND score >= -3 AND k <= 10) OR (best < -3 AND k <= 3)""")
sql_query("retrieval_metrics", lambda d: f"""
WITH per AS (SELECT q, min(CASE WHEN relevant THEN r END) AS first_hit, count(*) AS n FROM ({_RANKED}) t GROUP BY q)
SELECT count(*) AS n_questions, round(avg(CASE WHEN first_hit <= 1 THEN 1e0 ELSE 0e0 END), 6) AS hit1, round(avg(CASE WHEN first_hit <= 5 THEN 1e0 ELSE 0e0 END), 6) AS hit5, round(avg(coalesce(1e0 / first_hit, 0)), 6) AS mrr, round(avg(CAST(n AS double)), 6) AS kept FROM per""")
sql_query("threshold_sweep", lambda d: f"""
WITH t AS (SELECT {d.series('-9', '7')} AS threshold), s AS (SELECT threshold, relevant, score >= threshold AS kept FROM ({_RANKED}) r CROSS JOIN t)
SELECT threshold, CAST(sum(CASE WHEN kept THEN 1 ELSE 0 END) AS bigint) AS n_kept, round(sum(CASE WHEN kept AND relevant THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN relevant THEN 1e0 ELSE 0e0 END), 6) AS recall FROM s GROUP BY threshold""")
sql_query("profile_interleave", lambda d: f"""
WITH p AS (SELECT * FROM ({d.profiles})), n AS (SELECT model, chunk_id, row_number() OVER (PARTITION BY model ORDER BY count(*) DESC, chunk_id) AS r FROM p WHERE model IN ('PROMO', 'SMALL') GROUP BY model, chunk_id),
firsts AS (SELECT chunk_id, min(r * 2 + CASE model WHEN 'PROMO' THEN 0 ELSE 1 END) AS place FROM n GROUP BY chunk_id)
SELECT chunk_id, k FROM (SELECT chunk_id, row_number() OVER (ORDER BY place) AS k FROM firsts) t WHERE k <= 8""")
sql_query("rank_variants", lambda d: f"""
WITH z AS (SELECT q, id, r, (score - avg(CAST(score AS double)) OVER (PARTITION BY q)) / CASE WHEN stddev_pop(score) OVER (PARTITION BY q) = 0 THEN 1 ELSE stddev_pop(score) OVER (PARTITION BY q) END AS z, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r2 FROM ({_RANKED}) t)
SELECT q, id, round(z, 6) AS z, round(1e0 / (60 + r) + 1e0 / (60 + r2), 9) AS fused FROM z""")
sql_query("select_sources", lambda d: f"""
WITH r AS ({_RANKED}), u AS (SELECT q, id, 1 AS why, r AS pos FROM r WHERE r <= 5 UNION ALL SELECT q, id, 2, k FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY r) AS k FROM r WHERE relevant) t WHERE k <= 2 UNION ALL SELECT q, id, 3, k FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score, id) AS k FROM r) t WHERE k <= 2)
SELECT q, id, why FROM (SELECT *, row_number() OVER (PARTITION BY q, id ORDER BY why, pos) AS first FROM u) t WHERE first = 1""")
sql_query("prompt_lines", lambda d: f"SELECT chunk_id, profile_id, k FROM (SELECT chunk_id, profile_id, row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN model = 'PROMO' THEN 1 ELSE 0 END + CASE WHEN language = 'NATION_7' THEN 1 ELSE 0 END DESC, profile_id) AS k FROM ({d.profiles})) t WHERE k <= 6")
sql_query("methods_link", lambda d: f"""
WITH {_BM25(d, 1)} SELECT item_id, source, doc_id AS best FROM (SELECT s.item_id, doc.source, s.doc_id, row_number() OVER (PARTITION BY s.item_id, doc.source ORDER BY s.score DESC, s.doc_id) AS k FROM scored s JOIN documents doc ON doc.doc_id = s.doc_id WHERE s.score > 0) t WHERE k = 1""")
sql_query("page_cooccurrence", lambda d: f"""
WITH terms AS (SELECT * FROM (VALUES (1, 'the'), (1, 'for'), (2, 'der'), (2, 'und'), (3, 'que'), (3, 'de'), (3, 'zzzz')) AS t(combo, term)),
counts AS (SELECT page_id, combo, term, {d.size}({d.where(d.found('lower(html)', '[a-z]+'), 'x', 'x = term')}) AS n FROM pages CROSS JOIN terms),
per AS (SELECT page_id, combo, CAST(sum(n) AS bigint) AS total, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS bigint) AS present, count(*) AS wanted, max(CASE WHEN n = 0 THEN term END) AS missing FROM counts GROUP BY page_id, combo),
ranked AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY present DESC, total DESC, page_id) AS k FROM per WHERE present >= wanted - 1 AND present >= 1)
SELECT combo, page_id, total, present, missing, k FROM ranked WHERE k <= 6""")
