"""Exact top-k inner-product search by columnar branch-and-bound.

Queries are broadcast in blocks of at most QUERY_BLOCK; every task keeps its rows
in vertical layout (one array a dimension, most massive dimensions first) and, for
each query, adds up the product a few dimensions at a time. After each such step a
candidate's product can still grow by at most |rest of q| * |rest of x| (Cauchy and
Schwarz); candidates whose bound lies below the k-th best so far are compacted away.
Ties are kept, so the smaller id wins exactly. Each task returns k rows a query, and
one window over those picks the result.

Vectors that are null, or hold a null or non-finite component, take no part; a
vector is compared with queries of its own length only; a null id takes no part.
Rows with equal ids are separate candidates, none of which meets its own id.
Scores are exact as long as they fit in 64 bits. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import docs_of, prepared, quoted, shared_dir, written

QUERY_BLOCK = 4096
STEP = 8
SEED = 64


def scaled(vectors: pa.Array, ids: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """floor(scale * x) of the usable vectors by their length: (ids, rows as integers in float64 or int64)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lens = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    start = np.cumsum(lens) - lens
    known = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid())
    names = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for size in np.unique(lens[known]).tolist():
        rows = np.flatnonzero(known & (lens == size))
        x = np.floor(flat[start[rows][:, None] + np.arange(size)] * scale)
        good = np.isfinite(x).all(axis=1)
        out[size] = names[rows[good]], x[good]
    return out


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score = k, [np.zeros(0, np.int64)] * n
        self.id = [np.zeros(0, np.int64)] * n

    def floor(self, q: int) -> float:
        return float(self.score[q][-1]) if len(self.score[q]) == self.k else -np.inf

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]


def search(best: _Best, qs: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    """Offers rows x to every query of the same length."""
    n, dim = x.shape
    if not n or not len(qs):
        return
    order = np.argsort(-(x * x).sum(axis=0), kind="stable")
    exact = dim * float(np.abs(x).max(initial=0)) * float(np.abs(qs).max(initial=0)) < 2.0**52
    kind = np.float64 if exact else np.int64
    columns = np.ascontiguousarray(x.T[order]).astype(kind)
    qs = qs[:, order]
    cuts = list(range(0, dim, STEP)) + [dim]
    rest_x = [np.sqrt((x.T[order][c:].astype(np.float64) ** 2).sum(axis=0)) for c in cuts]
    rest_q = [np.sqrt((qs[:, c:].astype(np.float64) ** 2).sum(axis=1)) for c in cuts]
    whole = qs.astype(kind)
    seed = min(n, SEED)
    for q in range(len(qs)):
        mine = ids != q_ids[q]
        first = np.flatnonzero(mine[:seed])
        best.add(q, (whole[q] @ columns[:, first]).astype(np.int64), ids[first])
        left = np.flatnonzero(mine[seed:]) + seed
        part = np.zeros(len(left), kind)
        low = best.floor(q)
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = part + whole[q, a:b] @ (columns[a:b, left] if i else columns[a:b, seed:][:, mine[seed:]])
            grow = rest_q[i + 1][q] * rest_x[i + 1][left]
            keep = part + grow + 1e-9 * (np.abs(part) + grow) + 0.5 >= low
            if not keep.all():
                left, part = left[keep], part[keep]
            if not len(left):
                break
        if len(left):
            best.add(q, part.astype(np.int64), ids[left])


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query selects, the k other rows of the highest integer inner product."""
    spark = prepared(vectors.sparkSession)
    sc = spark.sparkContext
    rows = vectors.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    asked = rows.where("q").select("id", "v")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    where, found = shared_dir(spark) if blocks > 1 else "", None
    for b in range(blocks):
        table = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        shared = sc.broadcast(scaled(table.column("v"), table.column("id").combine_chunks(), scale))

        def run(batches, shared=shared):
            queries = shared.value
            best = {size: _Best(len(q[0]), k) for size, q in queries.items()}
            for batch in batches:
                for size, (ids, x) in scaled(batch.column(1), batch.column(0), scale).items():
                    if size in queries:
                        search(best[size], queries[size][1], queries[size][0], x, ids)
            for size, kept in best.items():
                n = [len(s) for s in kept.score]
                if sum(n):
                    yield pa.record_batch([pa.array(np.repeat(queries[size][0], n)), pa.array(np.concatenate(kept.id)), pa.array(np.concatenate(kept.score))], names=["query_id", "vec_id", "score"])

        part = rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        if blocks > 1:
            part = written(part, f"{where}/{b}")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(docs_of(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
