"""Affinities of a labelled volume: whether a voxel and a neighbour have the same label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.functions.scalar import tri_state

AXES = ("x", "y", "z")
#: Side of a block of voxels that one task holds, or the longest offset if that is more.
BLOCK = 64


def neighbour(column: str, axis: str, offset: int, keys: tuple[str, ...] = ()) -> Column:
    """The value at a fixed offset along an axis, null outside the volume or where voxels are missing.

    A range frame of one value: right on sparse grids too, and one sort for all offsets of an axis.
    """
    across = W.partitionBy(*keys, *(a for a in AXES if a != axis)).orderBy(axis)
    return F.max(column).over(across.rangeBetween(offset, offset))


def affinities(seg: DataFrame, long_range: int = 10, keys: tuple[str, ...] = (), labelled_only: bool = False) -> DataFrame:
    """Adds affinity ``aff0..aff5`` and mask ``mask0..mask5``: offset 1, then ``long_range``, on each axis.

    ``seg``: x, y, z, seg, with 0 for background and -1 for unlabelled. Labels are compared as they
    are, so two unlabelled neighbours agree until masked; background has no affinity. The mask is
    true for pairs within the volume, and with ``labelled_only`` for pairs of labelled voxels.

    One shuffle: blocks go to a task with copies of the voxels that their last ones meet, and the three
    axes' windows lie within a block.
    """
    steps = [(axis, step) for step in (1, long_range) for axis in AXES]
    side, blocks = max(BLOCK, long_range), [f"__b{a}" for a in AXES]
    home = [F.floor(F.col(a) / side) for a in AXES]
    place = lambda own, axis: F.struct(F.lit(own).alias("__own"), *((h - 1 if k == axis else h).alias(b) for k, (h, b) in enumerate(zip(home, blocks, strict=True))))
    beside = [F.when(F.pmod(F.col(a), F.lit(side)) < max(1, long_range), place(False, k)) for k, a in enumerate(AXES)]
    to = F.explode(F.array_compact(F.array(place(True, None), *beside))).alias("__to")
    rows = seg.select(*seg.columns, to).select(*seg.columns, "__to.*")
    out = rows.repartition(*keys, *blocks)
    out = out.withColumns({f"__n{k}": neighbour("seg", axis, step, (*keys, *blocks)) for k, (axis, step) in enumerate(steps)})
    out = out.filter("__own").drop("__own", *blocks)
    there = lambda k: F.col(f"__n{k}").isNotNull()
    labelled = lambda k: there(k) & (F.col("seg") != -1) & (F.col(f"__n{k}") != -1) if labelled_only else there(k)
    same = lambda k: F.coalesce((F.col("seg") == F.col(f"__n{k}")) & (F.col("seg") != 0), F.lit(False))
    columns = {f"aff{k}": same(k) for k in range(6)} | {f"mask{k}": F.coalesce(labelled(k), F.lit(False)) for k in range(6)}
    return out.withColumns(columns).drop(*(f"__n{k}" for k in range(6)))


def encoded(affs: DataFrame) -> DataFrame:
    """Affinities as 1, 0 or -1 where masked."""
    return affs.withColumns({f"aff{k}": tri_state(F.col(f"aff{k}"), F.col(f"mask{k}")) for k in range(6)})


def labelled_fraction(affs: DataFrame) -> DataFrame:
    return affs.agg((sum((F.avg(F.col(f"mask{k}").cast("int")) for k in range(6)), F.lit(0.0)) / 6).alias("labelled_fraction"))
