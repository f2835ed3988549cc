"""Connected components by union-find: forests within partitions, then star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every non-root node; the root is the smallest node of its tree."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(flat[:n].tolist(), flat[n:].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        else:
            parent[x] = y
    for x in range(len(parent)):
        parent[x] = parent[parent[x]]  # parents are smaller, hence already at their root
    root = np.array(parent, np.int64)
    child = np.flatnonzero(root != np.arange(len(root)))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest for every Arrow batch, which is bounded; what it leaves is for the rounds."""
    for batch in batches:
        if batch.num_rows:
            u, v = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (u, v): each node that is not the smallest of its component, and that smallest node.

    Alternates large-star and small-star steps on DataFrames until the edges no longer change; no list of neighbours
    is ever gathered, so a node of any degree costs one partial aggregation.
    """
    e = common.map_arrow(edges.where("a <> b").select("a", "b"), _contract, "u long, v long").distinct()
    before = None
    e = common.materialise(e)
    while True:
        n, x = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if (n, x) == before or n == 0:
            return e
        before = (n, x)
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        old, e = e, common.materialise(small)
        common.release(old)
