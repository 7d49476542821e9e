"""Connected components by alternating large-star and small-star steps, in DataFrame operations; few edges are joined in one pass.

Each Spark job, each scan and each broadcast join takes some megabytes of the driver for a moment, however few the rows.
So a step reads the edges as seldom as it can, and at most TASK_EDGES edges, which a step would handle in one task
anyway, take no steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_saved, save

#: Edges a task of a step handles; so many at most are joined in one task without steps.
TASK_EDGES = 250_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges, and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # The larger root of each edge moves to a smaller one, then every node to the end of its chain.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _joined(edges: DataFrame) -> DataFrame:
    """node, component of edges that one task can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(batch.column(c).to_numpy() for c in ("a", "b")) for batch in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in smallest(*map(np.concatenate, zip(*held, strict=True)))], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a long, b long).

    Each step joins the edges with the smallest neighbour of each node; hubs are only ever aggregated or
    on the large side of a join, so they split. Takes about log2 of the longest path rounds. Edges with a
    null end, loops and repeated edges change nothing.
    """
    tidy = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    look = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    now = save(tidy(edges))
    mark = look(now)
    while mark["n"] > TASK_EDGES:
        few = lambda df: df.coalesce(1 + mark["n"] // TASK_EDGES)  # noqa: B023, E731
        both = now.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        # Large star: the larger neighbours of a node go to its smallest neighbour or itself.
        large = save(few(tidy(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = save(few(tidy(small.unionByName(down.select("a", F.col("m").alias("b"))))))
        drop_saved(now, large)
        now, seen = after, look(after)
        if seen == mark:
            break
        mark = seen
    else:
        out = save(_joined(now))
        drop_saved(now)
        return out
    few = lambda df: df.coalesce(1 + mark["n"] // TASK_EDGES)
    roots = now.select("b").distinct()
    return save(few(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))))
