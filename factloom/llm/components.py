"""Connected components of a graph of long ids, without collecting it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored

#: Edges (of 16 bytes) that one task solves; more are contracted first.
SMALL = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and the least node that each can reach."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (columns a and b).

    Contraction: every node goes to its least neighbour or stays; edges are
    rewritten to where their ends went.  At least half of the nodes that have
    edges go in a round, so rounds grow with the logarithm; when ``SMALL`` edges
    are left, one task does the rest.
    """

    def solve(batches):
        ends = [np.empty((2, 0), np.int64), *(np.array([x["a"], x["b"]], np.int64) for x in batches)]
        nodes, least = least_reachable(*np.concatenate(ends, axis=1))
        yield {"node": nodes, "component": least}

    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    moved = lambda df, name, moves: df.join(moves, df[name] == moves["old"], "left").withColumn(name, F.coalesce("new", name)).drop("old", "new")
    while edges.count() > SMALL:
        if labels is None:
            labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = stored(both.groupBy("a").agg(F.min("b").alias("least")).where("least < a").select(F.col("a").alias("old"), F.col("least").alias("new")), "moves")
        labels = stored(moved(labels, "component", moves), "labels")
        edges = stored(moved(moved(edges, "a", moves), "b", moves).where("a <> b").distinct(), "edges")
    rest = stored(mapped(edges.coalesce(1), solve, "node long, component long"), "components")
    return rest if labels is None else stored(moved(labels, "component", rest.toDF("old", "new")), "labels")
