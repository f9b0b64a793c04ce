"""Connected components of an edge table: forests inside partitions, stars across them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

#: Edges that a task contracts at once.
CHUNK = 2_000_000


def contracted(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a component to its smallest node, for the components of these edges alone."""
    nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = at[: len(hi)], at[len(hi) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)  # what a node learns its root learns too
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _local_forests(batches):
    waiting, size = [], 0

    def flush():
        table = pa.Table.from_batches(waiting)
        hi, lo = contracted(table.column(0).to_numpy(), table.column(1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])

    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield flush()
            waiting, size = [], 0
    if size:
        yield flush()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)``, component = smallest node reachable.

    Nodes are longs; self-loops and repeated edges are ignored, nodes without an
    edge to another node are absent from the result. Every round first turns the
    edges of each partition into a forest, CHUNK edges at a time, and then hangs
    all across partitions by two joins with one minimum per node (aggregated
    before the shuffle); so the rounds grow with the partitions that a component
    spans, not with its length. The driver only sees one row, the count and a
    checksum. The number of edges never grows.
    """
    current = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(), label)
    seen = _state(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        forest = current.mapInArrow(_local_forests, "hi long, lo long")
        trees = materialise(forest.distinct(), label)
        both = trees.select(F.col("hi").alias("node"), F.col("lo").alias("nbr")).unionByName(trees.select(F.col("lo").alias("node"), F.col("hi").alias("nbr")))
        least = both.groupBy("node").agg(F.min("nbr").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.where("nbr > node").join(least, "node").select(F.col("nbr").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        before, current = current, materialise(hung.unionByName(root.select("hi", F.col("m").alias("lo"))).distinct(), label)
        forget(before, trees)
        now = _state(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
