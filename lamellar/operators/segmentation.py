"""Segments of a volume: components of its affinities or of equal labels, and graph components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.functions.ranking import numbered_within, with_rank
from lamellar.functions.scalar import above
from lamellar.operators.affinity import neighbour
from lamellar.operators.components import connected_components, local_roots
from lamellar.sources.storage import materialise

AXES = ("x", "y", "z")
#: Side of a block that one task labels: 64 cubed voxels at most, with those of three faces beside it.
BLOCK = 64


def hard(pred: DataFrame, threshold: float) -> DataFrame:
    """Boolean a0, a1, a2 from predicted affinities."""
    return pred.withColumns({f"a{k}": above(F.col(f"a{k}"), F.lit(threshold)) for k in range(3)})


def _label_block(frame: pd.DataFrame) -> pd.DataFrame:
    """One block's voxels, and copies of those before it with an affinity into it."""
    frame = frame.sort_values("vid").reset_index(drop=True)
    vid = frame.vid.to_numpy()
    vertex = frame[["a0", "a1", "a2"]].to_numpy().any(axis=1)
    us, vs = [], []
    for k, step in enumerate((frame.step_x, frame.step_y, frame.step_z)):
        goes = np.flatnonzero((frame[f"a{k}"] & frame[f"in{k}"]).to_numpy())
        to = np.searchsorted(vid, vid[goes] + step.to_numpy()[goes])
        here = to < len(vid)
        here[here] = vid[to[here]] == (vid[goes] + step.to_numpy()[goes])[here]
        us.append(goes[here])
        vs.append(to[here])
    u, v = np.concatenate(us), np.concatenate(vs)
    own = frame.own.to_numpy()
    # A copy matters by its affinities into this block alone, which lead to voxels of its own.
    real = own[v]
    u, v = u[real], v[real]
    vertex[v] = True
    root = local_roots(len(vid), u, v)
    keep = vertex & (own | np.isin(np.arange(len(vid)), u))
    return pd.DataFrame({"vid": vid[keep], "root": vid[root[keep]], "own": own[keep]})


def _roots_of_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(vid, root) of all vertices; ``rows``: x, y, z, a0..a2, in0..in2, step_*, vid."""
    home = {f"b{a}": F.floor(F.col(a) / block) for a in AXES}
    own = rows.withColumns(home).withColumn("own", F.lit(True))
    copies = None
    for k, axis in enumerate(AXES):
        last = rows.filter(F.col(f"a{k}") & F.col(f"in{k}") & (F.col(axis) % block == block - 1))
        moved = last.withColumns(home).withColumn(f"b{axis}", F.col(f"b{axis}") + 1).withColumn("own", F.lit(False))
        copies = moved if copies is None else copies.unionByName(moved)
    parts = own.unionByName(copies).groupBy("bx", "by", "bz").applyInPandas(_label_block, "vid long, root long, own boolean")
    parts = materialise(parts, "blocks")
    home_of = parts.filter("own").select("vid", "root")
    # As many rows as voxels on the blocks' faces.
    across = parts.filter("not own").select("vid", F.col("root").alias("other")).join(home_of, "vid")
    joined = connected_components(across.select("root", "other").distinct(), "root", "other")
    final = home_of.join(joined, home_of.root == joined.node, "left")
    return final.select("vid", F.coalesce(joined.root, home_of.root).alias("root"))


def _raster(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    _, ny, nz = shape
    vid = (F.col("x") * ny + F.col("y")) * nz + F.col("z")
    inside = {f"in{k}": F.col(a) + 1 < n for k, (a, n) in enumerate(zip(AXES, shape, strict=True))}
    return df.withColumns({"vid": vid, "step_x": F.lit(ny * nz), "step_y": F.lit(nz), "step_z": F.lit(1)} | inside)


def shape_of(df: DataFrame) -> tuple[int, int, int]:
    r = df.agg(*((F.max(a) + 1).alias(a) for a in AXES)).first()
    return tuple(int(r[a] or 0) for a in AXES)


def affinity_components(aff: DataFrame, shape: tuple[int, int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """x, y, z, seg for every voxel: components of boolean affinities a0..a2, numbered from 1.

    A voxel with any true affinity is in a segment, and so is the target of one within the volume; an
    affinity that leads out of it still makes a segment of one voxel. Others are 0. Segments are
    numbered by the raster index of their first voxel. Blocks are labelled by one task each and
    joined through their faces, so nothing of the volume's size is gathered.
    """
    shape = shape or shape_of(aff)
    rows = _raster(aff.select(*AXES, "a0", "a1", "a2"), shape).withColumns({c: F.col(c).cast("long") for c in ("step_x", "step_y", "step_z", "vid")})
    roots = materialise(_roots_of_blocks(rows, block), "voxel-roots")
    number = with_rank(roots.select("root").distinct(), "root", "seg")
    named = roots.join(number, "root").select("vid", "seg")
    return rows.select(*AXES, "vid").join(named, "vid", "left").select(*AXES, F.coalesce("seg", F.lit(0)).alias("seg"))


def label_components(seg: DataFrame, shape: tuple[int, int, int] | None = None, block: int = BLOCK) -> DataFrame:
    """x, y, z, seg: components of equal labels over the six neighbours; 0 and -1 stay as they are."""
    shape = shape or shape_of(seg)
    same = {f"a{k}": F.coalesce((neighbour("seg", a, 1) == F.col("seg")) & (F.col("seg") > 0), F.lit(False)) for k, a in enumerate(AXES)}
    rows = materialise(seg.select(*AXES, "seg").withColumns(same), "label-edges")
    graph = _raster(rows.drop("seg"), shape).withColumns({c: F.col(c).cast("long") for c in ("step_x", "step_y", "step_z", "vid")})
    roots = _roots_of_blocks(graph, block)
    here = _raster(rows, shape).select(*AXES, F.col("seg").alias("was"), F.col("vid").cast("long").alias("vid"))
    named = here.join(roots, "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    named = materialise(named, "label-roots")
    number = with_rank(named.filter("was > 0").select("root").distinct(), "root", "seg")
    return named.join(number, "root", "left").select(*AXES, F.when(F.col("was") > 0, F.col("seg")).otherwise(F.col("was")).alias("seg"))


def graph_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root; lone nodes are their own."""
    found = connected_components(edges.select("u", "v"))
    return nodes.select("node").distinct().join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root, and ``local``, its number from 0 within its component, which may be of any size; lone nodes are their own."""
    return numbered_within(graph_roots(nodes, edges), "root", "node", "local").select("node", "root", "local")


def component_of_skeleton(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """skel, root: of a skeleton in several components, the last one."""
    return nodes.select("node", "skel").join(components, "node").groupBy("skel").agg(F.max("root").alias("root"))


def label_lookup(nodes: DataFrame, seg: DataFrame, check: bool = True, most_broadcast: int = 1_000_000) -> DataFrame:
    """Nodes (x, y, z and others) with the label under them; a node outside the volume is an error.

    Up to ``most_broadcast`` places (24 bytes each) are broadcast, so that the volume isn't shuffled for a few
    nodes; beyond, both are joined by shuffle. The volume is never broadcast.
    """
    places = materialise(nodes.select(*AXES).distinct(), "places")
    voxels = seg.select(*AXES, F.col("seg").alias("pred"))
    if places.count() <= most_broadcast:
        voxels = voxels.join(F.broadcast(places), list(AXES), "left_semi")
    found = nodes.join(voxels, list(AXES), "left")
    if not check:
        return found
    bad: Column = F.raise_error(F.lit("a node lies outside the volume")).cast("long")
    return found.withColumn("pred", F.coalesce("pred", bad))
