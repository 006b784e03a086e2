"""Segments at many thresholds from one forest of merges.

An affinity's level says how many of the sorted thresholds it is above. Within a block, affinities are taken from
the highest level down, each once: a voxel that stops being the first of its component gets a parent and the
level at which that happened. That forest is cut by climbing as long as levels are high enough, so one pass
over the affinities serves every threshold, and a block holds five bytes a voxel, whatever the number of thresholds.

Blocks meet at their faces alone: at each level the faces' own roots are joined, all levels in one graph.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.operators import blocks
from lamellar.operators.blocks import KEYS, Blocks
from lamellar.operators.components import connected_components
from lamellar.operators.segmentation import local_roots
from lamellar.sources.storage import materialise

#: Groups of a block's nodes.
PARTS = 64
#: Levels fit a byte.
MOST_THRESHOLDS = 127
_STORED = {"parent": "<i4", "merged": "i1", "vertex": "i1", "l0": "i1", "l1": "i1", "l2": "i1"}


@dataclass(frozen=True)
class Forest:
    """``blocks``: parent, merged (the level at which a voxel joined it, 0: never), vertex (its highest level) and the affinities' levels.

    ``joined``: level, node, root: of roots on faces, by their numbers in the volume's raster, the least one of
    their component at a level. ``thresholds`` are in order; level k is above the first k of them.
    """

    blocks: Blocks
    joined: DataFrame
    thresholds: tuple[float, ...]

    def level(self, threshold: float) -> int:
        return int(np.searchsorted(np.array(self.thresholds), threshold)) + 1


def _climbed(parent: np.ndarray, merged: np.ndarray, place: np.ndarray, level: int) -> np.ndarray:
    """The roots of places at a level. Parents merge at lower levels, so there are as many steps as levels at most."""
    while (up := merged[place] >= level).any():
        place = np.where(up, parent[place], place)
    return place


def _grown(levels: list[np.ndarray], there: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """parent and merged of a block's places from levels of affinities along the axes."""
    n = there.size
    place = np.arange(n, dtype=np.int64).reshape(there.shape)
    us, vs, ls = [], [], []
    for axis, level in enumerate(levels):
        low, high = (tuple(slice(*cut) if k == axis else slice(None) for k in range(3)) for cut in ((0, -1), (1, None)))
        goes = (level[low] > 0) & there[low] & there[high]
        us.append(place[low][goes])
        vs.append(place[high][goes])
        ls.append(level[low][goes])
    u, v, level = np.concatenate(us), np.concatenate(vs), np.concatenate(ls)
    parent, merged, now = np.arange(n, dtype=np.int32), np.zeros(n, np.int8), np.arange(n)
    for m in range(many, 0, -1):
        at = level == m
        if at.any():
            root = local_roots(n, now[u[at]], now[v[at]])
            moved = np.flatnonzero((root != np.arange(n)) & (now == np.arange(n)))
            parent[moved], merged[moved] = root[moved], m
            now = root[now]
    return parent, merged


def _levels(b: Blocks, thresholds: Sequence[float]) -> Blocks:
    """l0..l2: how many thresholds each of a0..a2 is above, compared as 32-bit floats; NaN is above none."""
    cuts = np.array(thresholds, np.float32)
    level = lambda a: np.where(np.isnan(a), 0, np.searchsorted(cuts, a.astype("f4"), side="left")).astype("i1")
    one = lambda block, arrays, there, row: ({f"l{k}": np.where(there, level(arrays[f"a{k}"]), 0) for k in range(3)}, there)
    return blocks.kept(blocks._mapped(b, b.rows, {f"l{k}": "i1" for k in range(3)}, one), "levels")


def _forests(b: Blocks, many: int) -> Blocks:
    """The forest of every block. A voxel that an affinity of the block before leads to is a vertex at that level too."""

    def one(block, arrays, there, row):
        full, _ = blocks._padded(b, block, arrays, there, row, ["l0", "l1", "l2"], 1, 0)
        vertex = np.zeros(there.shape, np.int8)
        for axis in range(3):
            reached = full[f"l{axis}"][tuple(slice(0, n) if k == axis else slice(1, n + 1) for k, n in enumerate(there.shape))]
            vertex = np.maximum(vertex, np.maximum(arrays[f"l{axis}"], reached))
        parent, merged = _grown([arrays[f"l{k}"] for k in range(3)], there, many)
        return arrays | {"parent": parent, "merged": merged, "vertex": np.where(there, vertex, 0)}, there

    near = blocks.with_halo(b, ["l0", "l1", "l2"], 1, 0, corners=False)
    return blocks.kept(blocks._mapped(b, near, _STORED, one), "forest")


def _faces(b: Blocks, many: int) -> DataFrame:
    """bx, by, bz of the block behind, axis, levels of the affinities into it, and the face's roots at every level."""
    ends = [(n - 1) // b.side for n in b.shape]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrays, there, _ in blocks._blocks_of(batches, b):
            place = np.arange(there.size).reshape(there.shape)
            for axis in range(3):
                if block[axis] == ends[axis]:
                    continue
                last = tuple(slice(-1, None) if k == axis else slice(None) for k in range(3))
                level, at = arrays[f"l{axis}"][last].reshape(-1), place[last].reshape(-1)
                roots = np.stack([_climbed(arrays["parent"].reshape(-1), arrays["merged"].reshape(-1), at, m) for m in range(1, many + 1)])
                behind = tuple(o + (k == axis) for k, o in enumerate(block))
                keys = {k: pa.array([o], pa.int64()) for k, o in zip(KEYS, behind, strict=True)}
                cells = {"axis": pa.array([axis], pa.int32()), "levels": pa.array([level.tobytes()], pa.binary()), "roots": pa.array([roots.astype("<i4").tobytes()], pa.binary())}
                yield pa.RecordBatch.from_pydict(keys | cells)

    return b.rows.mapInArrow(task, "bx long, by long, bz long, axis int, levels binary, roots binary")


def _met(b: Blocks, many: int) -> DataFrame:
    """level, u, v: distinct roots that affinities between blocks join, at each level."""
    near = _faces(b, many).groupBy(*KEYS).agg(F.collect_list(F.struct("axis", "levels", "roots")).alias("faces"))  # three at most
    rows = b.rows.join(near, list(KEYS))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrays, there, row in blocks._blocks_of(batches, b):
            place = np.arange(there.size).reshape(there.shape)
            for face in row.column("faces")[0].as_py():
                axis = face["axis"]
                before = tuple(o - (k == axis) for k, o in enumerate(block))
                first = tuple(slice(0, 1) if k == axis else slice(None) for k in range(3))
                at, real = place[first].reshape(-1), there[first].reshape(-1)
                level = np.frombuffer(face["levels"], "i1")
                theirs = np.frombuffer(face["roots"], "<i4").reshape(many, -1)
                for m in range(1, many + 1):
                    goes = (level >= m) & real
                    ours = _climbed(arrays["parent"].reshape(-1), arrays["merged"].reshape(-1), at[goes], m)
                    pairs = np.unique(np.stack([blocks._in_raster(b, before, theirs[m - 1][goes]), blocks._in_raster(b, block, ours)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(pairs.shape[1], m, np.int32)), pa.array(pairs[0]), pa.array(pairs[1])], names=["level", "u", "v"])

    return rows.mapInArrow(task, "level int, u long, v long")


def merge_forest(b: Blocks, thresholds: Sequence[float]) -> Forest:
    """The forest of kept blocks with predicted affinities a0..a2, for any order of thresholds.

    A voxel that an affinity above the threshold leaves or reaches is in a segment, others are not; missing
    voxels are in none. All levels' faces are one graph, whose nodes are numbered by level and root.
    """
    cuts = tuple(sorted(set(thresholds)))
    many = len(cuts)
    if many > MOST_THRESHOLDS:
        raise ValueError(f"more than {MOST_THRESHOLDS} thresholds")
    grown = _forests(_levels(b, cuts), many)
    # Raster numbers times levels: a volume of 2^56 voxels fits.
    keyed = lambda c: (F.col(c) * (many + 1) + F.col("level")).alias(c)
    found = connected_components(_met(grown, many).select(keyed("u"), keyed("v")), label="faces")
    whole = lambda c: F.expr(f"{c} div {many + 1}").alias(c)
    joined = found.select(F.expr(f"cast(node % {many + 1} as int)").alias("level"), whole("node"), whole("root"))
    return Forest(grown, materialise(joined, "forest-faces"), cuts)


def _local(forest: Forest, nodes: DataFrame, columns: str, found_of) -> DataFrame:
    """Rows of ``nodes`` beside what ``found_of`` says of their places: arrays by ``columns``, and which node each row is of.

    A node outside the volume or on a missing voxel is an error. Nodes are grouped by block, and blocks stay where they are.
    """
    b = forest.blocks
    at = [F.floor(F.col(a) / b.side).alias(k) for a, k in zip("xyz", KEYS, strict=True)]
    packed = nodes.select(*at, F.struct(*(F.col(c) for c in nodes.columns)).alias("node"))
    # In parts, so that a block with a great many nodes isn't one group.
    parted = packed.withColumn("__part", F.pmod(F.xxhash64("node"), F.lit(PARTS))).repartition(blocks.tasks_of(b), *KEYS, "__part")
    groups = parted.groupBy(*KEYS, "__part").agg(F.collect_list("node").alias("nodes"))
    rows = groups.join(b.rows, list(KEYS), "left")
    fields = dict(packed.select("node.*").dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.column("parent").null_count:
                raise ValueError("a node lies outside the volume")
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                block, arrays, there, _ = next(blocks._blocks_of([row], b))
                found = row.column("nodes")[0].values
                place = [found.field(a).to_numpy() - o * b.side for a, o in zip("xyz", block, strict=True)]
                if any((p >= n).any() for p, n in zip(place, there.shape, strict=True)) or not there[tuple(place)].all():
                    raise ValueError("a node lies outside the volume")
                of, values = found_of(block, {c: a.reshape(-1) for c, a in arrays.items()}, np.ravel_multi_index(place, there.shape))
                of = pa.array(of)
                yield pa.RecordBatch.from_pydict({c: found.field(c).take(of) for c in fields} | {c: pa.array(v) for c, v in values.items()})

    return rows.mapInArrow(task, ", ".join(f"`{c}` {t}" for c, t in fields.items()) + f", {columns}")


def _roots_at(b: Blocks, block: tuple, arrays: dict, place: np.ndarray, level: int) -> np.ndarray:
    """Raster numbers of places' roots within the block at a level, -1 where there is no segment."""
    root = blocks._in_raster(b, block, _climbed(arrays["parent"], arrays["merged"], place, level))
    return np.where(arrays["vertex"][place] >= level, root, -1)


def labels(forest: Forest, nodes: DataFrame, name: str = "seg") -> DataFrame:
    """Rows of ``nodes`` (x, y, z and others) at every level, with the segment there: its first voxel's raster number and 1, 0 for none."""
    b, many = forest.blocks, len(forest.thresholds)

    def found_of(block, arrays, place):
        roots = [_roots_at(b, block, arrays, place, m) for m in range(1, many + 1)]
        return np.tile(np.arange(len(place)), many), {"__level": np.repeat(np.arange(1, many + 1, dtype=np.int32), len(place)), "__root": np.concatenate(roots)}

    local = _local(forest, nodes, "__level int, __root long", found_of)
    joined = forest.joined.select(F.col("level").alias("__level"), F.col("node").alias("__root"), F.col("root").alias("__least"))
    found = local.join(joined, ["__level", "__root"], "left")
    return found.select(*nodes.columns, F.col("__level").alias("level"), (F.coalesce("__least", "__root") + 1).alias(name))


def runs(forest: Forest, nodes: DataFrame, keys: list[str], name: str = "seg") -> DataFrame:
    """Rows of ``nodes`` for each run of levels, from ``top`` down to ``low``, in which their segment stays the same.

    ``keys`` tell nodes apart. A node has one row and one for each merge that renames its segment; levels are told
    one by one only for segments that touch a face where blocks meet.
    """
    b, many = forest.blocks, len(forest.thresholds)

    def found_of(block, arrays, place):
        now, since = np.full(len(place), -2), np.full(len(place), many + 1)
        of, tops, lows, roots = [], [], [], []
        for m in range(many, -1, -1):
            root = _roots_at(b, block, arrays, place, m) if m else np.full(len(place), -3)
            ended = np.flatnonzero((root != now) & (now != -2))
            of.append(ended)
            tops.append(since[ended])
            lows.append(np.full(len(ended), m + 1))
            roots.append(now[ended])
            since = np.where(root != now, m, since)
            now = root
        cells = {"top": np.concatenate(tops).astype(np.int32), "low": np.concatenate(lows).astype(np.int32), "__root": np.concatenate(roots)}
        return np.concatenate(of), cells

    local = _local(forest, nodes, "top int, low int, __root long", found_of)
    faces = forest.joined.select(F.col("node").alias("__root")).distinct().withColumn("__met", F.lit(True))
    local = materialise(local.join(faces, "__root", "left"), "runs")
    plain = local.filter("__met is null").select(*nodes.columns, "top", "low", F.col("__root").alias("__seg"))
    single = local.filter("__met").withColumn("__level", F.explode(F.sequence("low", "top")))
    joined = forest.joined.select(F.col("level").alias("__level"), F.col("node").alias("__root"), F.col("root").alias("__least"))
    single = single.join(joined, ["__level", "__root"], "left")
    single = single.select(*nodes.columns, F.col("__level").alias("top"), F.col("__level").alias("low"), F.coalesce("__least", "__root").alias("__seg"))
    down = W.partitionBy(*keys).orderBy(F.desc("top"))
    rows = plain.unionByName(single).repartition(blocks.tasks_of(b), *keys).withColumn("__new", F.coalesce(F.lag("__seg").over(down) != F.col("__seg"), F.lit(True)).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(down))
    ends = [F.max("top").alias("top"), F.min("low").alias("low"), (F.first("__seg") + 1).alias(name)]
    rest = [F.first(c).alias(c) for c in nodes.columns if c not in keys]
    return rows.groupBy(*keys, "__run").agg(*rest, *ends).select(*nodes.columns, "top", "low", name)


def cut(forest: Forest, threshold: float) -> Blocks:
    """``seg`` of the volume at one of the thresholds: the raster number of a segment's first voxel and 1, 0 for none."""
    b, m = forest.blocks, forest.level(threshold)
    _, ny, nz = b.shape
    here = forest.joined.filter((F.col("level") == m) & (F.col("node") != F.col("root")))
    x, y, z = F.expr(f"node div {ny * nz}"), F.expr(f"(node div {nz}) % {ny}"), F.expr(f"node % {nz}")
    at = [F.floor(c / b.side).alias(k) for c, k in zip((x, y, z), KEYS, strict=True)]
    near = here.groupBy(*at).agg(F.collect_list("node").alias("nodes"), F.collect_list("root").alias("roots"))  # roots on a block's faces

    def one(block, arrays, there, row):
        flat = np.arange(there.size)
        root = blocks._in_raster(b, block, _climbed(arrays["parent"].reshape(-1), arrays["merged"].reshape(-1), flat, m))
        if row.column("nodes")[0].is_valid:
            nodes, roots = (row.column(c)[0].values.to_numpy() for c in ("nodes", "roots"))
            order = np.argsort(nodes)
            nodes, roots = nodes[order], roots[order]
            place = np.minimum(np.searchsorted(nodes, root), len(nodes) - 1)
            root = np.where(nodes[place] == root, roots[place], root)
        return {"seg": np.where(arrays["vertex"].reshape(-1) >= m, root + 1, 0).reshape(there.shape)}, there

    return blocks._mapped(b, b.rows.join(near, list(KEYS), "left"), {"seg": "<i8"}, one)
