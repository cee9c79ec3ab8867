"""Connected components over an edge table: by alternating large-star and small-star steps, or in one task where links are few."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import checkpoint

#: Links up to which one task (some 100 MB) joins them all; a step over few links in many partitions is all overhead.
ONE_TASK = 1_000_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long), root being the smallest node it reaches.

    Links that are few are joined in one task. Otherwise both steps group by a node and need only its smallest neighbour, which partial aggregation reduces before the
    shuffle; a node with very many neighbours is a skewed side of a plain join. Each round is a checkpoint; only a
    count and a hash sum reach the driver. The steps settle after a number of rounds that grows with the logarithm of the
    nodes. Nulls and loops are ignored; no edges give no rows.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, seen = checkpoint(pairs), None
    while True:
        now = _signature(pairs)
        if 0 < now[0] <= ONE_TASK:
            return checkpoint(pairs.coalesce(1).mapInArrow(_joined, "node long, root long"))
        if now == seen or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        seen = now
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least).distinct()
        pairs = checkpoint(small)


def _joined(batches):
    """All links (u, v) at once -> (node, root)."""
    held = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in batches if len(b)]
    if held:
        links = np.concatenate(held, axis=1)
        nodes, at = np.unique(links, return_inverse=True)
        u, v = at.reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots(len(nodes), u, v)])], ["node", "root"])


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links u-v, in memory."""
    label = np.arange(n)
    while len(u):
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while not np.array_equal(label, jump := label[label]):
            label = jump
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label
