"""Connected components of an edge table, without gathering them anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_dir, written

ROWS = 1 << 15


class UnionFind:
    """Disjoint sets over integers; each set's root is its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.parent.setdefault(min(a, b), min(a, b))


def _contract(batches):
    """Replaces the edges of each batch by a forest of (node, root)."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
        rows = [(x, r) for x in sets.parent if (r := sets.find(x)) != x]
        hi, lo = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 2
        yield pa.record_batch([pa.array(hi), pa.array(lo)], names=["hi", "lo"])


def components(edges: DataFrame, where: str | None = None) -> DataFrame:
    """(node, component): for each node of the edges (a, b), other than the smallest of its component, that smallest node.

    Union-find contracts the edges of each batch; then rounds of "link all smaller
    neighbours to the smallest" and pointer jumping, each a few shuffles of the edge
    table, until every node points to a root. Tables are written as one file for each
    ROWS edges of the round before, as they only shrink. A node with any number of neighbours
    is met by partial aggregation and by joins that adaptive execution can split.
    The result reads a table in the folder where, which the caller may delete later.
    """
    spark = edges.sparkSession
    here = where or shared_dir(spark)
    old = f"{here}/0"
    e = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_contract, "hi long, lo long").distinct(), old)
    files = max(1, -(-e.count() // ROWS))
    step = 0
    while True:
        step += 1
        p = e.groupBy("hi").agg(F.min("lo").alias("p"))
        up = p.select(F.col("hi").alias("p"), F.col("p").alias("pp"))
        jump = p.join(up, "p", "left").select("hi", F.coalesce("pp", "p").alias("lo"), F.col("pp").isNotNull().alias("moved"))
        more = e.join(p, "hi").where("lo <> p").select(F.greatest("lo", "p").alias("hi"), F.least("lo", "p").alias("lo"), F.lit(True).alias("moved"))
        now = f"{here}/{step}"
        e2 = written(jump.unionByName(more).groupBy("hi", "lo").agg(F.max("moved").alias("moved")).coalesce(files), now)
        count, open_ = e2.agg(F.count(F.lit(1)), F.max("moved")).first()
        files = max(1, -(-count // ROWS))
        e = e2.select("hi", "lo")
        remove(spark, old)
        old = now
        if not open_:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
