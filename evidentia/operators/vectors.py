"""Exact nearest vectors by inner product, in tiles of queries and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and queries of a tile, and the scores that are held at once within one.
ROWS, ASKED, HELD = 1 << 16, 1 << 11, 1 << 22


def regular(vectors: DataFrame, vector: str = "embedding") -> bool:
    """Do all vectors have one length and only finite numbers?"""
    v = F.col(vector)
    odd = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = vectors.agg(F.min(F.size(v)).alias("least"), F.max(F.size(v)).alias("most"), F.max(odd).alias("odd")).first()
    return not found["odd"] and found["least"] == found["most"] and (found["least"] or 0) > 0


def nearest(vectors: DataFrame, asked: DataFrame, n: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of ``asked`` (q) the first ``n`` of ``vectors`` by score, then key: q, vec_id, score, r.

    The score is the sum of products in order, rounded to six places. Every vector is compared with every query. Tiles
    take what may be among the first from a matrix product, whose sums differ in their last bits, and score that anew.
    """
    parts = [max(1, -(-df.count() // size)) for df, size in ((vectors, ROWS), (asked, ASKED))]
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), dealt(parts[0]).alias("i")).withColumn("j", every(parts[1]))
    queries = asked.select(F.col(key).alias("id"), F.col(vector).alias("v"), dealt(parts[1]).alias("j")).withColumn("i", every(parts[0]))
    tiles = lambda df: df.repartition(parts[0] * parts[1], "i", "j").groupBy("i", "j")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _tile(left, right, n)

    found = tiles(queries).cogroup(tiles(rows)).applyInArrow(run, "q long, vec_id long, score double")
    found = found.withColumn("score", F.round("score", 6))
    return found.withColumn("r", F.expr("row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)")).filter(F.col("r") <= n)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = table["v"].combine_chunks()
    return table["id"].to_numpy(), lists.flatten().to_numpy().astype(np.float64).reshape(len(lists), -1)


def _tile(left: pa.Table, right: pa.Table, n: int) -> pa.Table:
    out = []
    if left.num_rows and right.num_rows:
        (qs, queries), (ids, rows) = _matrix(left), _matrix(right)
        order = np.argsort(ids, kind="stable")
        ids, rows = ids[order], rows[order]
        step, longest = max(1, HELD // len(ids)), np.sqrt((rows**2).sum(1).max())
        for at in range(0, len(qs), step):
            block = queries[at : at + step]
            scores = block @ rows.T
            k = min(n, len(ids))
            # Scores more than one unit of the sixth place below the last kept one are rounded below it, too.
            low = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-6 - 1e-12 * (1 + longest * np.sqrt((block**2).sum(1)))
            a, b = np.nonzero(scores >= low[:, None])
            exact = np.zeros(len(a))
            for d in range(rows.shape[1]):
                exact += block[a, d] * rows[b, d]
            # Of equal scores only the first by id can be wanted; rows come by id.
            by = np.lexsort((b, -exact, a))
            a, b, exact = a[by], b[by], exact[by]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (exact[1:] != exact[:-1])
            place = np.arange(len(a)) - np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
            kept = place < n
            out.append((qs[at : at + step][a[kept]], ids[b[kept]], exact[kept]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"q": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})
