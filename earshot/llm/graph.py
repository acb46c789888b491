"""Connected components of a table of edges, without collecting them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared


#: Edges that a task unites at once; the number of tasks follows the number of edges.
EDGES_A_TASK = 200_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) and the smallest node of the component of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        x, y = label[i], label[j]
        open_ = x != y
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges of a task, one from each node to the smallest node that they join it to."""
    hold = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if hold:
        node, least = least_labels(*(np.concatenate(x) for x in zip(*hold, strict=True)))
        far = node != least
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(least[far])], names=["a", "b"])


def connected_components(edges: DataFrame, rounds: int = 60, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """node and the smallest node of its component, for edges (a, b) of long; nodes without edges have no row.

    Each task first unites the edges that it holds, about `edges_a_task` of them, which settles a table of so few edges.
    Larger ones alternate two steps until nothing changes: each node links its larger neighbours to its smallest one, then
    its smaller neighbours and itself. The number of edges never grows, and each step is a grouped minimum and
    a join, so hubs are reduced before they are shuffled.
    """
    spark = edges.sparkSession
    now = shared(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark)
    tasks = -(-now.count() // edges_a_task)
    if not tasks:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = shared(now.coalesce(tasks).mapInArrow(_forest, "a long, b long"), spark)
    mark = None
    for _ in range(rounds if tasks > 1 else 0):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = shared(small, spark)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
