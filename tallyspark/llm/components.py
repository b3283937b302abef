"""Connected components by alternating large-star and small-star rounds, finished in one task once few edges are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialize

#: Edges (16 bytes each) up to which one task finishes; more take rounds of joins until so few are left or none changes.
SMALL = 1 << 20


def _with_least(edges: DataFrame) -> DataFrame:
    """a, b, m: the smallest of a and all its b. The minimum is combined before the shuffle."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges in order, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        if (low == high).all():
            return nodes, nodes[up]
        np.minimum.at(up, high, low)
        while (up[up] != up).any():
            up = up[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if parts:
            nodes, labels = labels_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], ["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is its smallest node.

    Each round makes every node point to a smaller one it can reach in a step or two and is
    written to the shared folder; the rounds end when at most SMALL edges are left, or none changes.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = materialize(edges, "edges"), None
    while True:
        # the state is compared by row count and sum of hashes, two numbers
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] <= SMALL:
            return materialize(_in_one_task(edges), "components")
        if state == last:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select("b", "b").distinct())
        last = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = materialize(large, "large_star")
        small = _with_least(down)
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "small_star")
