"""Connected components of a graph of long ids, by alternating large and small stars.

Edges stay distributed. First each task replaces its own edges by stars of the same components, so that chains and
cliques of one task take no round; then each round is two aggregations and two joins, written to the shared folder,
until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Each node u joins its larger (or its smaller) neighbours, and itself, to the least of all."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    moved = joined.filter("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to the least node of each component, of some edges of one task at a time."""
    held, size = [], 0

    def stars() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([np.concatenate(x) for x in zip(*held, strict=True)]), return_inverse=True)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        label = np.arange(len(nodes))
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        other = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["a", "b"])

    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        size += batch.num_rows
        if size > 500_000:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long) -> node, label: the least id of its component; only nodes that have an edge."""
    now = stored(edges.filter("a <> b").select("a", "b").mapInArrow(_local_stars, "a long, b long").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == mark or not state["n"]:
            break
        mark = state
        now = stored(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
