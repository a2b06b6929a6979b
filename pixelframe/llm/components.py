"""Connected components of links by alternating large stars and small stars.

Up to GATHERED links, counted beforehand, one executor's task does it at once; more go in rounds. Each half round is one aggregation (the least neighbour, summed up partly before the shuffle) and one join on the node,
whose skewed partitions AQE splits; the rounds grow with the logarithm of a component's diameter. Links are written to
the shared folder after each round, which cuts the lineage; only their count and a checksum come to the driver.

Defined results: links with a null end, of a node with itself, and repeated ones count as none or once; an empty table of
links gives an empty table; columns other than u and v are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.llm.common import released, written

#: Links that one task takes, 16 bytes each.
GATHERED = 1 << 18


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of their component)."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for ends in (a, b, root[a], root[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        node, root = roots_of(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")))
        apart = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[apart], pa.int64()), pa.array(root[apart], pa.int64())], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link and is not its component's smallest; links: u, v (long)."""
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    if edges.count() <= GATHERED:
        return written(edges.coalesce(1).mapInArrow(released(_at_once), "node long, root long"), "roots")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        edges = written(_small_star(written(_large_star(edges), "large-star")), "small-star")
