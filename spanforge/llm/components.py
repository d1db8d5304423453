"""Connected components of an edge list, by alternating large and small stars.

Each worker first contracts the edges it holds to stars of their local minima. Then every round turns each node's larger
neighbours towards its smallest one (large star) and its smaller neighbours too (small star), until all edges point from a
node to the smallest node of its component. Edges are written to the shared folder after each round; the driver sees only
their number and a checksum.

Defined cases: no edges: empty result. Loops and repeated edges change nothing. Null ends: the edge is ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm import common

MOST_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the smallest node that they are connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(nodes))], "int64")
    keep = roots != np.arange(len(nodes))
    return nodes[keep], nodes[roots[keep]]


def _contract(batches):
    for pdf in batches:
        a, b = forest(pdf["a"].to_numpy("int64"), pdf["b"].to_numpy("int64"))
        yield pd.DataFrame({"a": a, "b": b})


def _star(both: DataFrame, larger: bool) -> DataFrame:
    """both: (a, b) seen from a. Neighbours beyond (or up to) a are turned towards the smallest of all."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    turned = both.join(least, "a")
    out = turned.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else turned.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not larger:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, work: common.Scratch | None = None) -> DataFrame:
    """edges (a long, b long) -> (node, component): the smallest node reachable, for every node that has an edge. work: where the edges go."""
    work = work or common.Scratch(edges.sparkSession, "components")
    e = work.stored(edges.where("a is not null and b is not null and a <> b").mapInPandas(_contract, "a long, b long").distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, True)
        e = work.stored(_star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "edges")
    else:
        raise RuntimeError(f"components are not stable after {MOST_ROUNDS} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
