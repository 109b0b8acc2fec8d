"""Connected components of links. Links never reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_cut

#: So many links are solved in one task (16 bytes each); more are solved by label propagation.
LOCAL_LINKS = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of links a - b: hooking of labels and pointer jumping until nothing changes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    return nodes, nodes[label]


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        node, component = least_labels(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for at in range(0, len(node), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 65536]), pa.array(component[at : at + 65536])], ["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b), whole numbers: component is the smallest node reachable. No links, no rows.

    Few links are solved in one task. Of many, each partition's are first reduced to a forest; then every round takes the least label of a
    node and its neighbours and the label's label, until a round changes nothing.
    """
    links = cut(links.select("a", "b"), "links")
    if links.count() <= LOCAL_LINKS:
        found = cut(links.coalesce(1).mapInArrow(solve, "node long, component long"), "components")
        drop_cut(links)
        return found
    forest = links.mapInArrow(solve, "node long, component long").where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    edges = cut(forest.unionByName(forest.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    drop_cut(links)
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("l"))
        of = labels.select(F.col("node").alias("l"), F.col("component").alias("up"))
        jumped = cut(better.join(of, "l", "left").select("node", "old", F.least("l", F.coalesce("up", "l")).alias("component")), "labels")
        drop_cut(labels)
        labels = jumped
        if not labels.where(F.col("old") != F.col("component")).limit(1).count():
            drop_cut(edges)
            found = cut(labels.select("node", "component"), "components")
            drop_cut(labels)
            return found
