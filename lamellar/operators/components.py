"""Connected components of an edge table: within pieces of it first, then between them by alternating large and small stars.

A piece is what a task has at hand, so edges that lie together cost one shuffle of their nodes, whatever the length of
their paths. Stars join only the pieces' roots of nodes that lie in several pieces: every round is two shuffles of the
edges left, and the number of rounds grows with the logarithm of what is left. A node's neighbours are never gathered:
only their minimum is, which tasks take before they shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.sources.storage import drop, materialise

#: Edges of a piece, at most, and rows of what a task returns at once.
PIECE, ROWS = 1_000_000, 100_000


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with edges u-v, the least node of each one's component."""
    root = np.arange(n)
    while len(u):
        ru, rv = root[u], root[v]
        low = np.minimum(ru, rv)
        if (ru == rv).all():
            break
        np.minimum.at(root, ru, low)
        np.minimum.at(root, rv, low)
        while (nxt := root[root]).tobytes() != root.tobytes():
            root = nxt
    return root


def _in_pieces(edges: DataFrame, most: int) -> DataFrame:
    """node, root: of every node of a piece of the edges (u, v) the least one that the piece joins it to."""

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        ends = np.concatenate([rows["u"].to_numpy(), rows["v"].to_numpy()])
        node, place = np.unique(ends, return_inverse=True)
        root = node[local_roots(len(node), *np.split(place, 2))]
        for i in range(0, len(node), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + ROWS]), pa.array(root[i : i + ROWS])], names=["node", "root"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many = [], 0
        for batch in batches:
            if parts and many + batch.num_rows > most:
                yield from joined(parts)
                parts, many = [], 0
            parts.append(batch)
            many += batch.num_rows
        if many:
            yield from joined(parts)

    return edges.mapInArrow(task, "node long, root long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    across = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(now: DataFrame, label: str) -> DataFrame:
    """node, root of kept edges (u, v) without loops."""
    state = _state(now)
    while state[0]:
        was, now = now, materialise(_small_star(_large_star(now)).filter("u <> v").distinct(), label)
        drop(was)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", label: str = "components", piece: int = PIECE) -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node of its component.

    Edges have no direction and may repeat; edges with a null end are no edges; a node with an edge
    to itself alone is its own root. An empty table gives an empty result.
    """
    rows = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u is not null and v is not null")
    parts = materialise(_in_pieces(rows, piece), label)
    least = materialise(parts.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")), label)
    split = materialise(least.filter("least <> most").select("node", "least"), label)
    if split.isEmpty():
        drop(parts)
        return least.select("node", F.col("least").alias("root"))
    across = parts.join(split, "node").filter("root <> least").select(F.col("root").alias("u"), F.col("least").alias("v"))
    across = materialise(across.distinct(), label)
    drop(parts)
    found = _stars(across, label).select(F.col("node").alias("least"), "root")
    return least.select("node", "least").join(found, "least", "left").select("node", F.coalesce("root", "least").alias("root"))
