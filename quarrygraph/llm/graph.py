"""Connected components of an edge table; nothing is gathered in one place.

Each task first contracts the edges of its own partition to stars around their smallest ids, which keeps at most one edge
for each id and task. When all edges fit one task's bound that is the result; otherwise rounds of large and small stars over the
contracted edges, contracted again after each, join what the tasks found until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.llm.common import materialize, release

#: Edges that one task contracts: 16 MB of ids.
TASK_EDGES = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for every end of the edges."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return names, names[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v, size = [], [], 0

    def out() -> pa.RecordBatch:
        i, r = stars(np.concatenate(u), np.concatenate(v))
        return pa.record_batch([pa.array(i), pa.array(r)], names=["u", "v"])

    for b in batches:
        if b.num_rows:
            u.append(b.column(0).to_numpy())
            v.append(b.column(1).to_numpy())
            size += b.num_rows
        if size > TASK_EDGES:  # stars of what came so far stand for it
            done = out()
            u, v = [done.column(0).to_numpy()], [done.column(1).to_numpy()]
            size = len(u[0])
            if size > TASK_EDGES // 2:
                yield done
                u, v, size = [], [], 0
    if size:
        yield out()


def contracted(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").mapInArrow(_contract, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of ``edges`` (u, v); root is the component's smallest id. Self loops name lone ids."""
    spark = edges.sparkSession
    cur = materialize(contracted(edges))
    was = _state(cur)
    while True:
        parts = max(1, -(-was[0] // (TASK_EDGES // 2)))
        if parts == 1:
            return contracted(cur.coalesce(1)).selectExpr("u as id", "v as root")
        # In each star a hub sends its smallest neighbour to the others; the smallest is a map-side combined aggregate joined back.
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m"))
        large = materialize(both.where("v >= u").join(least, "u").selectExpr("v as u", "m as v"))
        least2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least2, "u").selectExpr("v as u", "m as v").union(least2.selectExpr("u", "m as v"))
        nxt = materialize(contracted(small).distinct())
        release(spark, cur, least, large, least2)
        cur, now = nxt, _state(nxt)
        if now == was:
            return cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        was = now
