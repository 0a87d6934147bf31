"""Connected components: tasks contract edges to forests, then large-star and small-star rounds close them.

A task contracts about EDGES_PER_TASK edges at a time. Where all edges are that few, one pass closes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.session import forget, stored

SALTS = 8
EDGES_PER_TASK = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of edges a-b that are not the least themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for end in (label[x], label[y], x, y):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def _contracted(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges (u, v), u > v, with the same components: a forest for each of so many tasks."""
    tasks = -(-edges.count() // EDGES_PER_TASK)

    def run(batches):
        u, v = [], []
        for b in batches:
            u.append(b.column(0).to_numpy())
            v.append(b.column(1).to_numpy())
        if u:
            x, y = forest(np.concatenate(u), np.concatenate(v))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])

    return stored(edges.repartition(max(1, tasks)).mapInArrow(run, "u long, v long"), "forest"), tasks


def _least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m: the least of u and its neighbours. The join is salted: a node may have very many neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "s"]).drop("s")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): every node (a whole number) that has an edge, with the smallest node it can reach.

    Each round is written to the shared folder, which cuts lineage. Null ends and self-loops are ignored.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    first = stored(now, "edges")
    now, tasks = _contracted(first)
    forget(first)
    before = None
    for _ in range(most_rounds if tasks > 1 else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        pairs = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        last, now = now, stored(pairs.filter("u <> v").distinct(), "edges")
        forget(last)
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    children = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return children.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
