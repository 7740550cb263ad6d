"""Components of links that fit into one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Links that one task may join: 16 MB.
FINISH = 1 << 20


def least_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links a - b and the least node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # each root hooks onto the least root that a link leads to; then all point to where chains end
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def finish(edges: DataFrame) -> DataFrame:
    """(node, root) of the links (hi, lo), whole numbers, in one task: count them before."""

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            nodes, root = least_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])

    return edges.select("hi", "lo").coalesce(1).mapInArrow(run, "node long, root long")
