"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirgate.llm.store import materialize

#: Edges (16 bytes each) that one task walks at most.
ONE_TASK = 1 << 20


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the edges: each root is hung on its smallest neighbour's root, then paths are shortened, until all agree."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((shorter := root[root]) != root).any():
            root = shorter
    return node, node[root]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(np.asarray(batch.column("a")), np.asarray(batch.column("b"))) for batch in batches]
    if got:
        node, root = smallest_reached(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Up to ``one_task`` edges are walked by one task. Beyond that the large-star and small-star steps of Kiveris et al.
    (2014) alternate until nothing changes, for as many rounds as that takes (about the logarithm of the longest path);
    each round is written to the shared folder. A node's smallest neighbour is then a partially aggregated minimum, so a
    hub is not gathered in one task. Loops and repeated edges add nothing; an edge with a null end is left out; no edges
    give no rows.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
    pairs = materialize(edges.distinct(), "edges")
    if pairs.count() <= one_task:
        return pairs.select(F.col("v").alias("a"), F.col("u").alias("b")).coalesce(1).mapInArrow(_walk, "node long, root long")
    before = None
    while (now := tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())) != before:
        before = now
        if not now[0]:
            break
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        # large star: every larger neighbour of x is hung on x's smallest
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: every smaller neighbour of u is hung on u's smallest, and u itself
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        pairs = materialize(small, "edges")
    tops = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops.select("node", F.col("node").alias("root")))


def merge_components(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of the components ``roots`` joined by more edges: only the contracted edges are walked."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    joined = edges.join(a, "a", "left").join(b, "b", "left")
    tops = materialize(components(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "tops")
    moved = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(tops.join(moved.select("node"), "node", "left_anti").select("node", "root"))
