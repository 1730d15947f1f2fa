"""Contiguous batches of a project's documents, balanced by cost."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame

from quarrygraph.ship import ship

#: Batches aimed at for each worker, and the fewest documents of a batch.
PER_WORKER, LEAST_DOCUMENTS = 2, 32


def boundaries(costs: Sequence[int], workers: int, per_worker: int = PER_WORKER, least: int = LEAST_DOCUMENTS) -> list[int]:
    """Ends of the batches: each takes documents until its share of the remaining cost, rounded up, is reached and leaves one for each later batch."""
    if min(workers, per_worker, least) <= 0:
        raise ValueError("workers, batches and documents must be positive")
    n = len(costs)
    if not n:
        return []
    batches = 1 if workers == 1 else max(1, min(n // least, workers * per_worker))
    ends, at, left = [], 0, sum(costs)
    for later in range(batches - 1, 0, -1):
        share, taken, start = -(-left // (later + 1)), 0, at
        while at < n - later and (at == start or taken < share):
            taken += costs[at]
            at += 1
        ends.append(at)
        left -= taken
    return [*ends, n]


def batch_plan(documents: DataFrame, workers: int, per_worker: int = PER_WORKER, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(project, batch, documents, cost): a greedy walk in key order within each project, whose list of (key, cost) is one group."""

    ship(documents.sparkSession)

    def plan(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("key", kind="stable")
        if x["key"].duplicated().any():
            raise ValueError(f"duplicate document in {key[0]}")
        ends = boundaries(x["cost"].tolist(), workers, per_worker, least)
        rows = [(key[0], i, e - s, int(x["cost"].iloc[s:e].sum())) for i, (s, e) in enumerate(zip([0, *ends], ends, strict=False))]
        return pd.DataFrame(rows, columns=["project", "batch", "documents", "cost"])

    return documents.select("project", "key", "cost").groupBy("project").applyInPandas(plan, "project string, batch int, documents long, cost long")
