"""Boxes, patches and chunks of a volume, and the blending of overlapping patches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def box(df: DataFrame, origin: tuple[int, int, int], size: int, extra: int = 0) -> DataFrame:
    """The voxels of a cube, clamped at the far edge; ``extra`` adds a margin beyond ``size``.

    Plain ranges of stored columns, so they reach the scan.
    """
    for axis, lo in zip(AXES, origin, strict=True):
        df = df.filter((F.col(axis) >= lo) & (F.col(axis) < lo + size + extra))
    return df


def middle_slice(df: DataFrame) -> DataFrame:
    """The slice half-way along the first axis, given voxels from 0."""
    half = df.agg(F.floor((F.max("x") + 1) / 2).alias("half"))  # one row
    return df.join(F.broadcast(half), F.col("x") == F.col("half")).drop("half")


def centre_pad(seg: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """A smaller segmentation in the middle of a grid of ``shape``, with -1 around it."""
    size = seg.agg(*((F.max(a) + 1).alias(f"n{a}") for a in AXES))
    moved = seg.join(F.broadcast(size)).select(*((F.col(a) + F.floor((F.lit(n) - F.col(f"n{a}")) / 2)).cast("long").alias(a) for a, n in zip(AXES, shape, strict=True)), "seg")
    grid = seg.sparkSession.range(shape[0] * shape[1] * shape[2])
    cell = grid.selectExpr(f"id div {shape[1] * shape[2]} as x", f"(id div {shape[2]}) % {shape[1]} as y", f"id % {shape[2]} as z")
    return cell.join(moved, list(AXES), "left").withColumn("seg", F.coalesce("seg", F.lit(-1).cast("long")))


def slice_images(volume: DataFrame, channels: dict[str, list[Column]], step: int) -> DataFrame:
    """tag, step, i, j, c, value: pixels of the middle slice along x, for each tag one value a channel."""
    cells = [F.struct(F.lit(tag).alias("tag"), F.lit(c).alias("c"), v.cast("double").alias("value")) for tag, values in channels.items() for c, v in enumerate(values)]
    rows = middle_slice(volume).select(F.col("y").alias("i"), F.col("z").alias("j"), F.explode(F.array(*cells)).alias("p"))
    return rows.select("p.tag", F.lit(step).cast("long").alias("step"), "i", "j", "p.c", "p.value")


def offsets(big: int, small: int) -> Column:
    """Patch starts along an axis: multiples of ``small``, and the last place where one fits."""
    if big < small:
        raise ValueError("a patch is larger than the volume")
    every = F.sequence(F.lit(0), F.lit(big - small), F.lit(small))
    return F.array_distinct(F.array_append(every, F.lit(big - small)))


def patches(spark: SparkSession, shape: tuple[int, int, int], small: int, overlap: bool) -> DataFrame:
    """px, py, pz of all patches; with overlap also the base shifted by half a patch along any axes, if they fit."""
    if min(shape) < small:
        raise ValueError("a patch is larger than the volume")
    # Numbered, so that tasks make them by ranges: as many starts along an axis as ``offsets`` lists.
    nx, ny, nz = (-(-(n - small) // small) + 1 for n in shape)
    index = (f"id div {ny * nz}", f"(id div {nz}) % {ny}", f"id % {nz}")
    base = spark.range(nx * ny * nz).selectExpr(*(f"least(({i}) * {small}, {n - small}) as p{a}" for a, i, n in zip(AXES, index, shape, strict=True)))
    if not overlap:
        return base
    shifts = F.array(*(F.struct(*(F.lit(small // 2 * (s >> k & 1)).alias(f"d{a}") for k, a in enumerate(AXES))) for s in range(8)))
    moved = base.withColumn("d", F.explode(shifts))
    moved = moved.select(*((F.col(f"p{a}") + F.col(f"d.d{a}")).alias(f"p{a}") for a in AXES), (F.col("d.dx") + F.col("d.dy") + F.col("d.dz")).alias("d"))
    fits = (F.col("d") == 0) | ((F.col("px") + small <= shape[0]) & (F.col("py") + small <= shape[1]) & (F.col("pz") + small <= shape[2]))
    return moved.filter(fits).drop("d").distinct()


def chunks(patch: DataFrame, chunk: int, small: int) -> DataFrame:
    """Patches by the chunk of their origin, with the chunk's bounding box."""
    keyed = patch.withColumns({f"c{a}": F.floor(F.col(f"p{a}") / chunk) for a in AXES})
    edges = [f(f"p{a}") for a in AXES for f in (lambda c: F.min(c).alias(f"lo_{c[1]}"), lambda c: (F.max(c) + small).alias(f"hi_{c[1]}"))]
    return keyed.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("px", "py", "pz"))).alias("patches"), *edges)


#: Side of a block of ``by_block``, and the most voxels of a task's blocks, on average.
BLOCK, VOXELS = 64, 64**3


def by_block(patch: DataFrame, shape: tuple[int, int, int], small: int, side: int = BLOCK) -> DataFrame:
    """Each patch with ``block``, the number of a block of ``side`` cubed voxels that it meets, once for each of them.

    Rows are dealt by block, to as many tasks as the volume needs, so what patches hold within a block comes to its place
    without being sent: only patches are, and those at blocks' faces more than once.
    """
    many = [-(-n // side) for n in shape]
    for axis in AXES:
        met = F.sequence(F.floor(F.col(f"p{axis}") / side), F.floor((F.col(f"p{axis}") + small - 1) / side))
        patch = patch.withColumn(f"__{axis}", F.explode(met))
    number = ((F.col("__x") * many[1] + F.col("__y")) * many[2] + F.col("__z")).cast("long")
    tasks = max(patch.sparkSession.sparkContext.defaultParallelism, -(-math.prod(shape) // VOXELS))
    return patch.withColumn("block", number).drop(*(f"__{a}" for a in AXES)).repartition(tasks, "block")


def weight(i: Column, j: Column, k: Column, small: int) -> Column:
    """Distance to the patch's border, one at the surface, in the chessboard metric."""
    return F.least(*(F.least(c + 1, F.lit(small) - c) for c in (i, j, k))).cast("float")


def blend(
    predictions: DataFrame, small: int, overlap: bool, channels: tuple[str, ...] = ("p0", "p1", "p2"), shape: tuple[int, int, int] | None = None, side: int = BLOCK
) -> DataFrame:
    """x, y, z and the weighted mean of every channel over the patches that cover a voxel.

    ``predictions``: px, py, pz, i, j, k and channels. One aggregate with partial sums, in place of
    a shared accumulator. Sums are in double precision. With ``shape``, predictions are those of patches from
    ``by_block``: a voxel counts in its own block alone, and sums stay in the task that has the block.
    """
    w = weight(F.col("i"), F.col("j"), F.col("k"), small).cast("double") if overlap else F.lit(1.0)
    at = [(F.col(f"p{a}") + F.col(i)).alias(a) for a, i in zip(AXES, "ijk", strict=True)]
    keys = ["block", *AXES] if shape else list(AXES)
    rows = predictions.select(*keys[: -len(AXES)], *at, w.alias("w"), *channels)
    if shape:
        x, y, z = (F.floor(F.col(a) / side) for a in AXES)
        rows = rows.filter(F.col("block") == (x * -(-shape[1] // side) + y) * -(-shape[2] // side) + z)
    sums = [F.try_divide(F.sum(F.col("w") * F.col(c).cast("double")), F.sum("w")).alias(c) for c in channels]
    return rows.groupBy(*keys).agg(*sums).select(*AXES, *channels)


def blurred(img: DataFrame, column: str, sigma: float = 2.0, truncate: float = 4.0) -> DataFrame:
    """Gaussian blur along all three axes, edges reflected (d c b a | a b c d), one axis at a time.

    The kernel has 2 * int(truncate * sigma + 0.5) + 1 places, fewer than an axis has. A voxel's
    neighbours are a range frame, so no row is sent more than once for each axis; one near an edge
    counts again for each of its images within the kernel.
    """
    radius = int(truncate * sigma + 0.5)
    total = sum(math.exp(-0.5 * d * d / (sigma * sigma)) for d in range(-radius, radius + 1))
    weight = lambda d: F.when(F.abs(d) <= radius, F.exp(-0.5 * d * d / (sigma * sigma)) / total).otherwise(0.0)
    df = img.select(*AXES, F.col(column).cast("double").alias(column))
    sizes = img.agg(*((F.max(a) + 1).alias(f"n{a}") for a in AXES))
    df = df.join(F.broadcast(sizes))  # one row
    for axis in AXES:
        others = [a for a in AXES if a != axis]
        around = W.partitionBy(*others).orderBy(axis).rangeBetween(-radius, radius)
        met = F.collect_list(F.struct(F.col(axis).alias("at"), F.col(column).alias("v"))).over(around)
        here, n = F.col(axis), F.col(f"n{axis}")
        read = lambda r: r.v * (weight(r.at - here) + weight(-1 - r.at - here) + weight(2 * n - 1 - r.at - here))  # noqa: B023, E731
        df = df.withColumn("__met", met).withColumn(column, F.aggregate("__met", F.lit(0.0), lambda s, r: s + read(r))).drop("__met")
    return df.select(*AXES, column)
