"""Volumes as blocks: a row for each cube of voxels with packed arrays, and an exchange of the halos alone.

A table of blocks is kept in buckets by block, so that a join with what neighbours send leaves the blocks where
they are: only slices beside a block's faces are shuffled. Everything within a block is array work of one task,
whose memory is that of a block and its halo.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamellar.functions.ranking import with_rank
from lamellar.operators.components import connected_components
from lamellar.operators.segmentation import local_roots
from lamellar.sources.storage import bucketed, materialise

AXES = ("x", "y", "z")
KEYS = ("bx", "by", "bz")
SIDE = 64
#: Groups of the patches that meet one block.
PARTS = 16
#: Blocks of a bucket, at most: a task reads a bucket block by block.
PER_BUCKET = 64
#: Voxels of a task, on average at most, where rows of voxels are dealt.
PER_TASK = 1 << 16
#: Spark's types of arrays' items, by kind and size; it has no unsigned ones, so they become wider. 64 unsigned bits must fit a long.
_SPARK = {"?": "boolean", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "f4": "float", "f8": "double"}
_WIDER = {"u1": "i2", "u2": "i4", "u4": "i8", "u8": "i8"}

Origin = tuple[int, int, int]
Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Blocks:
    """``rows``: bx, by, bz, a binary for each name of ``types`` (numpy's, in C order), and ``there``.

    ``there`` has a bit for each voxel that exists, or is null if all do. Blocks at the far faces of
    ``shape`` are smaller than ``side``. A block without voxels need not be there.
    """

    rows: DataFrame | None
    shape: tuple[int, int, int]
    types: dict[str, str]
    side: int = SIDE

    def __reduce__(self):
        """Tasks get all but the rows."""
        return Blocks, (None, self.shape, self.types, self.side)

    def extent(self, block: Origin) -> tuple[int, int, int]:
        return tuple(min(self.side, n - b * self.side) for n, b in zip(self.shape, block, strict=True))

    @property
    def schema(self) -> str:
        return "bx long, by long, bz long, " + ", ".join(f"`{c}` binary" for c in self.types) + ", there binary"


def _packed(mask: np.ndarray) -> bytes | None:
    return None if mask.all() else np.packbits(mask.reshape(-1)).tobytes()


def _unpacked(raw: bytes | None, extent: tuple[int, int, int]) -> np.ndarray:
    n = math.prod(extent)
    return np.ones(extent, bool) if raw is None else np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool).reshape(extent)


def _row(block: Origin, arrays: Arrays, there: np.ndarray, types: dict[str, str]) -> pa.RecordBatch:
    cells = {c: pa.array([np.ascontiguousarray(arrays[c], t).tobytes()], pa.binary()) for c, t in types.items()}
    return pa.RecordBatch.from_pydict({k: pa.array([b], pa.int64()) for k, b in zip(KEYS, block, strict=True)} | cells | {"there": pa.array([_packed(there)], pa.binary())})


def _blocks_of(batches: Iterator[pa.RecordBatch], b: Blocks) -> Iterator[tuple[Origin, Arrays, np.ndarray, pa.RecordBatch]]:
    """Block by block: its number, arrays, which voxels exist, and its row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            block = tuple(row.column(k)[0].as_py() for k in KEYS)
            extent = b.extent(block)
            arrays = {c: np.frombuffer(row.column(c)[0].as_py(), t).reshape(extent) for c, t in b.types.items()}
            yield block, arrays, _unpacked(row.column("there")[0].as_py(), extent), row


def _mapped(b: Blocks, rows: DataFrame, types: dict[str, str], one: Callable) -> Blocks:
    """``one`` takes what ``_blocks_of`` gives and returns arrays of ``types`` and which voxels exist."""
    out = replace(b, types=types)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrays, there, row in _blocks_of(batches, b):
            made, kept = one(block, arrays, there, row)
            if kept.any():
                yield _row(block, made, kept, types)

    return replace(out, rows=rows.mapInArrow(task, out.schema))


def tasks_of(b: Blocks) -> int:
    """Tasks among which rows of voxels or nodes are dealt: as many as the volume needs, so that none grows with it."""
    return max(b.rows.sparkSession.sparkContext.defaultParallelism, -(-math.prod(b.shape) // PER_TASK))


def from_voxels(voxels: DataFrame, types: dict[str, str], shape: tuple[int, int, int], side: int = SIDE) -> Blocks:
    """Packs a table of voxels (x, y, z and the columns of ``types``), one shuffle. Of repeated voxels one stays.

    Voxels lie within ``shape``; missing ones are marked as such, and null values count as 0 of their type.
    """
    b = Blocks(voxels, shape, types, side)

    def pack(group: pa.Table) -> pa.Table:
        at = [group[a].to_numpy() for a in AXES]
        block = tuple(int(a[0] // side) for a in at)
        extent = b.extent(block)
        place = np.ravel_multi_index([a - o * side for a, o in zip(at, block, strict=True)], extent)
        there = np.zeros(extent, bool)
        there.reshape(-1)[place] = True
        arrays = {}
        for c, t in types.items():
            arrays[c] = np.zeros(extent, t)
            arrays[c].reshape(-1)[place] = group[c].fill_null(False if t == "?" else 0).to_numpy().astype(t)
        return pa.Table.from_batches([_row(block, arrays, there, types)])

    rows = voxels.select(*(F.col(a).cast("long").alias(a) for a in AXES), *types)
    rows = rows.withColumns({k: F.floor(F.col(a) / side) for a, k in zip(AXES, KEYS, strict=True)})
    keyed = rows.repartition(tasks_of(b), *KEYS).groupBy(*KEYS)
    return replace(b, rows=keyed.applyInArrow(pack, b.schema))


def to_voxels(b: Blocks) -> DataFrame:
    """x, y, z and the columns of every voxel that exists."""
    items = {c: np.dtype(t).str.lstrip("<|").replace("b1", "?") for c, t in b.types.items()}
    wider = {c: _WIDER.get(t, t) for c, t in items.items()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrays, there, _ in _blocks_of(batches, b):
            at = np.nonzero(there)
            cells = [pa.array(a + o * b.side, pa.int64()) for a, o in zip(at, block, strict=True)]
            values = [pa.array(arrays[c][at].astype(wider[c])) for c in b.types]
            yield pa.RecordBatch.from_arrays([*cells, *values], names=[*AXES, *b.types])

    return b.rows.mapInArrow(task, "x long, y long, z long, " + ", ".join(f"`{c}` {_SPARK[t]}" for c, t in wider.items()))


def kept(b: Blocks, label: str = "blocks") -> Blocks:
    """Writes the blocks in buckets to the shared folder, where each stays with its halo's place."""
    many = math.prod(-(-n // b.side) for n in b.shape)
    parallel = b.rows.sparkSession.sparkContext.defaultParallelism
    return replace(b, rows=bucketed(b.rows, list(KEYS), max(min(many, parallel), -(-many // PER_BUCKET), 1), label))


def crop(b: Blocks, origin: Origin, size: int, extra: int = 0) -> Blocks:
    """The voxels of a cube, clamped at the far faces, at the places they had: blocks beyond it aren't read."""
    end = [o + size + extra for o in origin]
    rows = b.rows
    for k, lo, hi in zip(KEYS, origin, end, strict=True):
        rows = rows.filter((F.col(k) >= lo // b.side) & (F.col(k) <= (hi - 1) // b.side))

    def one(block, arrays, there, row):
        inside = np.ones(there.shape, bool)
        for axis, (o, lo, hi) in enumerate(zip(block, origin, end, strict=True)):
            at = np.arange(there.shape[axis]) + o * b.side
            inside &= ((at >= lo) & (at < hi)).reshape([-1 if a == axis else 1 for a in range(3)])
        return arrays, there & inside

    return _mapped(b, rows, b.types, one)


def threshold(b: Blocks, at: float, channels: tuple[str, ...] = ("a0", "a1", "a2")) -> Blocks:
    """Whether each channel is above ``at``, compared as 32-bit floats; NaN is above nothing. Other columns go."""
    types = dict.fromkeys(channels, "?")
    return _mapped(b, b.rows, types, lambda block, arrays, there, row: ({c: arrays[c].astype("f4") > np.float32(at) for c in channels}, there))


def _sent(b: Blocks, columns: list[str], before: int, after: int, corners: bool) -> DataFrame:
    """bx, by, bz of the block that needs it, the side d0, d1, d2 that it comes from, columns and ``there`` of slices."""
    schema = "bx long, by long, bz long, d0 int, d1 int, d2 int, " + ", ".join(f"`{c}` binary" for c in columns) + ", there binary"
    last = [(n - 1) // b.side for n in b.shape]
    sides = [d for d in itertools.product((-1, 0, 1), repeat=3) if any(d) and (corners or sum(map(abs, d)) == 1)]
    sides = [d for d in sides if all((x < 0) * before + (x > 0) * after for x in d if x)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrays, there, _ in _blocks_of(batches, b):
            for d in sides:  # where this block lies, as the other one sees it
                other = tuple(o - x for o, x in zip(block, d, strict=True))
                if any(o < 0 or o > n for o, n in zip(other, last, strict=True)):
                    continue
                part = tuple(slice(0, after) if x > 0 else slice(max(0, n - before), n) if x < 0 else slice(None) for x, n in zip(d, there.shape, strict=True))
                cells = {c: pa.array([arrays[c][part].tobytes()], pa.binary()) for c in columns}
                keys = {k: pa.array([o], pa.int64()) for k, o in zip(KEYS, other, strict=True)} | {f"d{i}": pa.array([x], pa.int32()) for i, x in enumerate(d)}
                yield pa.RecordBatch.from_pydict(keys | cells | {"there": pa.array([_packed(there[part])], pa.binary())})

    return b.rows.mapInArrow(task, schema)


def with_halo(b: Blocks, columns: list[str], before: int, after: int, corners: bool) -> DataFrame:
    """The rows of ``b``, as ``kept`` wrote them, with ``halo``: what up to 26 neighbours sent. Blocks aren't shuffled.

    A halo is no wider than a block's side.
    """
    if max(before, after) > b.side:
        raise ValueError("a halo is wider than a block")
    sent = _sent(b, columns, before, after, corners)
    parts = F.collect_list(F.struct("d0", "d1", "d2", *columns, "there")).alias("halo")
    near = sent.groupBy(*KEYS).agg(parts)
    return b.rows.join(near, list(KEYS), "left")


def _padded(b: Blocks, block: Origin, arrays: Arrays, there: np.ndarray, row: pa.RecordBatch, columns: list[str], before: int, after: int) -> tuple[Arrays, np.ndarray]:
    """Arrays with the halo around them, 0 where there is nothing, and which voxels exist."""
    inner = tuple(slice(before, before + n) for n in there.shape)
    size = tuple(n + before + after for n in there.shape)
    out, exist = {c: np.zeros(size, b.types[c]) for c in columns}, np.zeros(size, bool)
    for c in columns:
        out[c][inner] = np.where(there, arrays[c], np.zeros(1, b.types[c]))
    exist[inner] = there
    for part in row.column("halo")[0].as_py() or []:
        d = (part["d0"], part["d1"], part["d2"])
        extent = b.extent(tuple(o + x for o, x in zip(block, d, strict=True)))
        shape = tuple(min(n, after) if x > 0 else min(n, before) if x < 0 else n for x, n in zip(d, extent, strict=True))
        place = tuple(slice(before + n, before + n + m) if x > 0 else slice(before - m, before) if x < 0 else slice(before, before + n) for x, n, m in zip(d, there.shape, shape, strict=True))
        real = _unpacked(part["there"], shape)
        exist[place] = real
        for c in columns:
            out[c][place] = np.where(real, np.frombuffer(part[c], b.types[c]).reshape(shape), np.zeros(1, b.types[c]))
    return out, exist


def affinities(b: Blocks, long_range: int = 10, labelled_only: bool = False) -> Blocks:
    """aff0..aff5 and mask0..mask5 of kept blocks with ``seg``, as the operator on voxels gives them. Three faces are sent."""
    steps = [(axis, step) for step in (1, long_range) for axis in range(3)]
    after = max(1, long_range)
    types = {f"{c}{k}": "?" for c in ("aff", "mask") for k in range(6)}

    def one(block, arrays, there, row):
        full, exist = _padded(b, block, arrays, there, row, ["seg"], 0, after)
        seg, made = arrays["seg"], {}
        for k, (axis, step) in enumerate(steps):
            at = tuple(slice(step, step + n) if a == axis else slice(0, n) for a, n in enumerate(there.shape))
            other, both = full["seg"][at], there & exist[at]
            made[f"aff{k}"] = both & (seg == other) & (seg != 0)
            made[f"mask{k}"] = both & (seg != -1) & (other != -1) if labelled_only else both
        return made, there

    return _mapped(b, with_halo(b, ["seg"], 0, after, corners=False), types, one)


def blurred(b: Blocks, column: str, sigma: float = 2.0, truncate: float = 4.0) -> Blocks:
    """Gaussian blur of kept blocks, edges reflected, as the operator on voxels gives it; missing voxels add nothing.

    The kernel reaches no further than a block's side or the volume's size.
    """
    radius = int(truncate * sigma + 0.5)
    if radius > min(b.shape):
        raise ValueError("the kernel reaches beyond the volume")
    weights = [math.exp(-0.5 * d * d / (sigma * sigma)) for d in range(-radius, radius + 1)]
    weights = [w / sum(weights) for w in weights]

    def one(block, arrays, there, row):
        full, exist = _padded(b, block, arrays, there, row, [column], radius, radius)
        part = full[column].astype("f8")
        for axis, n in enumerate(b.shape):
            lo = block[axis] * b.side - radius
            wanted = np.arange(lo, lo + part.shape[axis])
            wanted = np.where(wanted < 0, -1 - wanted, np.where(wanted >= n, 2 * n - 1 - wanted, wanted)) - lo
            inside = np.clip(wanted, 0, part.shape[axis] - 1)  # what the kernel doesn't reach may be anything
            part = np.take(part, inside, axis)
            m = there.shape[axis]
            part = sum(w * np.take(part, range(i, i + m), axis) for i, w in enumerate(weights))
            exist = np.take(exist, range(radius, radius + m), axis)
            part = np.where(exist, part, 0.0)
        return {column: part}, there

    return _mapped(b, with_halo(b, [column], radius, radius, corners=True), {column: "f8"}, one)


def _roots(b: Blocks, labels: str | None = None) -> Blocks:
    """Kept blocks with ``root``: of each vertex the place in the block of its component's first voxel, -1 elsewhere.

    ``b`` has boolean a0..a2. The end of an affinity from the block before is a vertex here, and so is a voxel
    with a label above 0, if ``labels`` names a column of them.
    """
    types = {"root": "<i4", "a0": "?", "a1": "?", "a2": "?"} | ({labels: b.types[labels]} if labels else {})

    def one(block, arrays, there, row):
        full, _ = _padded(b, block, arrays, there, row, ["a0", "a1", "a2"], 1, 0)
        place = np.arange(there.size).reshape(there.shape)
        vertex = there & (arrays[labels] > 0) if labels else np.zeros(there.shape, bool)
        us, vs = [], []
        for axis in range(3):
            cut = lambda lo, hi: tuple(slice(lo, hi) if k == axis else slice(None) for k in range(3))  # noqa: B023, E731
            goes = (arrays[f"a{axis}"] & there)[cut(0, -1)] & there[cut(1, None)]
            us.append(place[cut(0, -1)][goes])
            vs.append(place[cut(1, None)][goes])
            reached = full[f"a{axis}"][tuple(slice(0, n) if k == axis else slice(1, n + 1) for k, n in enumerate(there.shape))]
            vertex |= there & (arrays[f"a{axis}"] | reached)
        root = local_roots(there.size, np.concatenate(us), np.concatenate(vs)).reshape(there.shape)
        return arrays | {"root": np.where(vertex, root, -1)}, there

    return kept(_mapped(b, with_halo(b, ["a0", "a1", "a2"], 1, 0, corners=False), types, one), "block-roots")


def _in_raster(b: Blocks, block: Origin, place: np.ndarray) -> np.ndarray:
    """Numbers in the volume's raster of places in a block."""
    x, y, z = (a.astype(np.int64) + o * b.side for a, o in zip(np.unravel_index(place, b.extent(block)), block, strict=True))
    return (x * b.shape[1] + y) * b.shape[2] + z


def _across(b: Blocks) -> DataFrame:
    """u, v: roots that an affinity from one block into the next joins, by their numbers in the volume's raster."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrays, there, row in _blocks_of(batches, b):
            for part in row.column("halo")[0].as_py() or []:
                axis = (part["d0"], part["d1"], part["d2"]).index(-1)
                before = tuple(o - (k == axis) for k, o in enumerate(block))
                face = tuple(1 if k == axis else n for k, n in enumerate(there.shape))
                goes = np.frombuffer(part[f"a{axis}"], "?").reshape(face) & _unpacked(part["there"], face)
                ours = arrays["root"][tuple(slice(0, 1) if k == axis else slice(None) for k in range(3))]
                met = goes & (ours >= 0)
                theirs = np.frombuffer(part["root"], "<i4").reshape(face)[met]
                pairs = np.unique(np.stack([_in_raster(b, before, theirs), _in_raster(b, block, ours[met])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return with_halo(b, ["root", "a0", "a1", "a2"], 1, 0, corners=False).mapInArrow(task, "u long, v long")


def _numbered(rooted: Blocks, labels: str | None = None) -> Blocks:
    """``seg`` from ``_roots``: segments by the first voxel in the raster, from 1; elsewhere the label, or 0.

    What is sent is a row for each segment of a block, not for each voxel.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrays, _, _ in _blocks_of(batches, rooted):
            place = np.unique(arrays["root"])
            place = place[place >= 0]
            keys = [pa.array(np.full(len(place), o)) for o in block]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(place.astype("i4")), pa.array(_in_raster(rooted, block, place))], names=[*KEYS, "place", "own"])

    own = materialise(rooted.rows.mapInArrow(listed, "bx long, by long, bz long, place int, own long"), "block-segments")
    joined = connected_components(_across(rooted), "u", "v")
    final = own.join(joined, F.col("own") == F.col("node"), "left").select(*KEYS, "place", F.coalesce("root", "own").alias("root"))
    final = materialise(final, "block-segments")
    number = with_rank(final.select("root").distinct(), "root", "seg")
    back = final.join(number, "root").groupBy(*KEYS).agg(F.collect_list("place").alias("places"), F.collect_list("seg").alias("segs"))

    def one(block, arrays, there, row):
        seg = np.zeros(there.size, np.int64)
        if row.column("places")[0].is_valid:
            seg[row.column("places")[0].values.to_numpy()] = row.column("segs")[0].values.to_numpy()
        other = arrays[labels] if labels else 0
        return {"seg": np.where(arrays["root"] >= 0, seg[arrays["root"]], other)}, there

    return _mapped(rooted, rooted.rows.join(back, list(KEYS), "left"), {"seg": "<i8"}, one)


def affinity_components(b: Blocks) -> Blocks:
    """``seg`` of kept blocks with boolean a0..a2: components, numbered as the operator on voxels does; others are 0."""
    return _numbered(_roots(b))


def label_components(b: Blocks) -> Blocks:
    """``seg`` of kept blocks with ``seg``: components of equal labels over the six neighbours; 0 and -1 stay as they are."""
    types = {"a0": "?", "a1": "?", "a2": "?", "seg": b.types["seg"]}

    def one(block, arrays, there, row):
        full, exist = _padded(b, block, arrays, there, row, ["seg"], 0, 1)
        seg, made = arrays["seg"], {}
        for axis in range(3):
            at = tuple(slice(1, 1 + n) if a == axis else slice(0, n) for a, n in enumerate(there.shape))
            made[f"a{axis}"] = there & exist[at] & (seg == full["seg"][at]) & (seg > 0)
        return made | {"seg": seg}, there

    edges = kept(_mapped(b, with_halo(b, ["seg"], 0, 1, corners=False), types, one), "block-edges")
    return _numbered(_roots(edges, "seg"), "seg")


def patches(b: Blocks, origins: DataFrame, size: int) -> tuple[DataFrame, dict[str, str]]:
    """px, py, pz, an array of ``size`` cubed for each column and ``there``, for every distinct origin; and the arrays' types.

    Patches are joined to the kept blocks whose range they meet, and a block is read once for all of its patches, so
    what is sent is the patches' own voxels. Places outside the volume, and missing voxels, don't exist.
    """
    places = ("px", "py", "pz")
    wanted = origins.select(*(F.col(p).cast("long").alias(p) for p in places)).distinct()
    for k, p in zip(KEYS, places, strict=True):
        wanted = wanted.withColumn(k, F.explode(F.sequence(F.floor(F.col(p) / b.side), F.floor((F.col(p) + size - 1) / b.side))))
    near = wanted.groupBy(*KEYS, F.pmod(F.xxhash64(*places), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct(*places)).alias("met"))
    schema = "px long, py long, pz long, lo array<int>, hi array<int>, " + ", ".join(f"`{c}` binary" for c in b.types) + ", there binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, arrays, there, row in _blocks_of(batches, b):
            for patch in row.column("met")[0].as_py():
                origin = [patch[p] for p in places]
                lo = [max(0, p - o * b.side) for p, o in zip(origin, block, strict=True)]
                hi = [min(n, p + size - o * b.side) for p, o, n in zip(origin, block, there.shape, strict=True)]
                if any(x >= y for x, y in zip(lo, hi, strict=True)):
                    continue
                part = tuple(map(slice, lo, hi))
                ends = [[x + o * b.side - p for x, o, p in zip(e, block, origin, strict=True)] for e in (lo, hi)]
                cells = {c: pa.array([arrays[c][part].tobytes()], pa.binary()) for c in b.types} | {"there": pa.array([_packed(there[part])], pa.binary())}
                head = {p: pa.array([v], pa.int64()) for p, v in patch.items()} | {k: pa.array([e], pa.list_(pa.int32())) for k, e in zip(("lo", "hi"), ends, strict=True)}
                yield pa.RecordBatch.from_pydict(head | cells)

    def join(group: pa.Table) -> pa.Table:
        exist, out = np.zeros((size,) * 3, bool), {c: np.zeros((size,) * 3, t) for c, t in b.types.items()}
        for piece in group.to_pylist():
            at, shape = tuple(map(slice, piece["lo"], piece["hi"])), tuple(y - x for x, y in zip(piece["lo"], piece["hi"], strict=True))
            exist[at] = _unpacked(piece["there"], shape)
            for c, t in b.types.items():
                out[c][at] = np.where(exist[at], np.frombuffer(piece[c], t).reshape(shape), np.zeros(1, t))
        head = {p: group[p].combine_chunks()[:1] for p in places}
        cells = {c: pa.array([a.tobytes()], pa.binary()) for c, a in out.items()} | {"there": pa.array([_packed(exist)], pa.binary())}
        return pa.table(head | cells)

    pieces = b.rows.join(near, list(KEYS)).mapInArrow(cut, schema)
    made = "px long, py long, pz long, " + ", ".join(f"`{c}` binary" for c in b.types) + ", there binary"
    return pieces.groupBy(*places).applyInArrow(join, made), b.types


def patch_voxels(patch: DataFrame, types: dict[str, str], size: int) -> DataFrame:
    """px, py, pz, i, j, k and the columns of every voxel that exists in ``patches``."""
    items = {c: np.dtype(t).str.lstrip("<|").replace("b1", "?") for c, t in types.items()}
    wider = {c: _WIDER.get(t, t) for c, t in items.items()}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                at = np.nonzero(_unpacked(row.column("there")[0].as_py(), (size,) * 3))
                head = [pa.array(np.full(len(at[0]), row.column(p)[0].as_py())) for p in ("px", "py", "pz")]
                values = [pa.array(np.frombuffer(row.column(c)[0].as_py(), t).reshape((size,) * 3)[at].astype(wider[c])) for c, t in types.items()]
                yield pa.RecordBatch.from_arrays([*head, *map(pa.array, at), *values], names=["px", "py", "pz", "i", "j", "k", *types])

    fixed = ", ".join(f"{c} long" for c in ("px", "py", "pz", "i", "j", "k"))
    return patch.mapInArrow(task, f"{fixed}, " + ", ".join(f"`{c}` {_SPARK[t]}" for c, t in wider.items()))
