"""Random augmentation of patches: draws of each sample are columns, and geometry remaps coordinates.

A patch is a cube of side ``n``: rows (sample, x, y, z, raw, seg). A draw is a hash of the seed, the
sample and what it is for, so a repeated task draws the same and no state is kept. Draws of a
sample are one row, joined once; those of slices and voxels are computed where they are used.
"""

from __future__ import annotations

import dataclasses
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.functions.draws import uniform
from lamellar.operators.sampling import SHIFTED

AXES = ("x", "y", "z")
ORDERS = tuple(itertools.permutations(range(3)))
#: Planes that are turned, one after another.
PLANES = (("z", "y"), ("z", "x"), ("y", "x"))


@dataclasses.dataclass(frozen=True)
class Settings:
    """Probabilities and sizes; 0 turns a step off. Steps with a gate are taken for half of the samples."""

    drop_slice: float = 0.0
    shift_slice: float = 0.0
    shift_magnitude: int = 10
    multiply: float = 0.0
    add: float = 0.0
    noise: float = 0.0
    affine: float = 0.0
    affine_scale: float = 0.0
    affine_shear: float = 0.0


def _below(u: Column, n: int) -> Column:
    return F.floor(u * n).cast("int")


def draws(samples: DataFrame, settings: Settings, seed: int = 0) -> DataFrame:
    """One row per distinct sample: order, turn0..2, flip_x.., and for each gated step whether it is taken and with what."""
    u = lambda what: uniform(seed, what, "sample")
    half = lambda what, on: (u(what) < 0.5) if on else F.lit(False)
    spread = lambda what, size: (2 * u(what) - 1) * size
    s = settings
    columns = {"order": _below(u("order"), 6)} | {f"turn{k}": _below(u(f"turn{k}"), 4) for k in range(3)} | {f"flip_{a}": u(f"flip_{a}") < 0.5 for a in AXES}
    columns |= {"drops": half("drops", s.drop_slice > 0), "drop_axis": _below(u("drop_axis"), 3)}
    columns |= {"shifts": half("shifts", s.shift_slice > 0), "shift_axis": _below(u("shift_axis"), 3)}
    columns |= {"changes": half("changes", s.multiply > 0 or s.add > 0), "factor": 1 + spread("factor", s.multiply), "addend": spread("addend", s.add)}
    columns |= {"noisy": half("noisy", s.noise > 0), "noise_scale": u("noise_scale") * s.noise}
    columns |= {"warps": u("warps") < s.affine}
    columns |= {f"angle_{a}": spread(f"angle_{a}", math.pi) for a in AXES} | {f"scale_{a}": 1 + spread(f"scale_{a}", s.affine_scale) for a in AXES}
    columns |= {f"shear{k}": spread(f"shear{k}", s.affine_shear) for k in range(6)}
    out = samples.select("sample").distinct().withColumns(columns)
    return out.withColumns({f"m{i}{j}": e for i, row in enumerate(_matrix()) for j, e in enumerate(row)}) if s.affine > 0 else out


def _turned(at: Column, a: str, b: str, times: Column, n: int) -> Column:
    p, q, last = at[a], at[b], F.lit(n - 1)
    to = {
        a: F.when(times == 1, last - q).when(times == 2, last - p).when(times == 3, q).otherwise(p),
        b: F.when(times == 1, p).when(times == 2, last - q).when(times == 3, last - p).otherwise(q),
    }
    return F.struct(*(to.get(k, at[k]).alias(k) for k in AXES))


def oriented(df: DataFrame, n: int) -> DataFrame:
    """Axes in the drawn order, turned in each plane, and flipped: every voxel goes to one place."""

    def picked(k: int) -> Column:
        at = F.col(AXES[ORDERS[0][k]])
        for i, order in enumerate(ORDERS[1:], 1):
            at = F.when(F.col("order") == i, F.col(AXES[order[k]])).otherwise(at)
        return at

    # A list of one place, so that each step is evaluated once and not written out into the next.
    at = F.array(F.struct(*(picked(k).cast("long").alias(a) for k, a in enumerate(AXES))))
    for k, (a, b) in enumerate(PLANES):
        at = F.transform(at, lambda v: _turned(v, a, b, F.col(f"turn{k}"), n))  # noqa: B023
    flip = lambda v, a: F.when(F.col(f"flip_{a}"), n - 1 - v[a]).otherwise(v[a]).alias(a)
    at = F.transform(at, lambda v: F.struct(*(flip(v, a) for a in AXES)))[0]
    return df.withColumn("__at", at).withColumns({a: F.col(f"__at.{a}") for a in AXES}).drop("__at")


def _slice(axis: str) -> Column:
    """The place along the drawn axis."""
    return F.when(F.col(axis) == 0, F.col("x")).when(F.col(axis) == 1, F.col("y")).otherwise(F.col("z"))


def slices_dropped(df: DataFrame, probability: float, seed: int = 0) -> DataFrame:
    gone = F.col("drops") & (uniform(seed, "drop", "sample", "at") < probability)
    out = df.withColumn("at", _slice("drop_axis").cast("long"))
    return out.withColumn("raw", F.when(gone, F.lit(0.0)).otherwise(F.col("raw"))).drop("at")


def slices_shifted(df: DataFrame, probability: float, magnitude: int, n: int, seed: int = 0) -> DataFrame:
    """Only ``raw`` moves, so it is joined back to the labels by its new place."""
    values = df.filter("shifts").withColumn("at", _slice("shift_axis").cast("long"))
    hit = uniform(seed, "shift", "sample", "at") < probability
    by = lambda other: F.floor(uniform(seed, f"by_{other}", "sample", "at") * (2 * magnitude + 1)) - magnitude
    moved = {}
    for other in AXES:
        along = [k for k, axis in enumerate(AXES) if other in SHIFTED[axis]]
        moved[other] = F.when(hit & F.col("shift_axis").isin(along), F.pmod(F.col(other) + by(other), F.lit(n))).otherwise(F.col(other)).cast("long")
    values = values.select("sample", *(moved[a].alias(a) for a in AXES), F.col("raw").alias("moved"))
    out = df.withColumns({a: F.col(a).cast("long") for a in AXES}).join(values, ["sample", *AXES], "left")
    return out.withColumn("raw", F.when(F.col("shifts"), F.col("moved")).otherwise(F.col("raw"))).drop("moved")


def intensity_changed(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", F.when(F.col("changes"), F.col("raw") * F.col("factor") + F.col("addend")).otherwise(F.col("raw")))


def noise_added(df: DataFrame, seed: int = 0) -> DataFrame:
    """Normal noise of the sample's own scale, from two even draws of each voxel."""
    a, b = (uniform(seed, w, "sample", *AXES) for w in ("noise_a", "noise_b"))
    normal = F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)
    return df.withColumn("raw", F.when(F.col("noisy"), F.col("raw") + normal * F.col("noise_scale")).otherwise(F.col("raw")))


def _product(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def _matrix() -> list[list[Column]]:
    """Turns about x, y and z, then shears, then scales, as expressions of the draws."""
    one, zero = F.lit(1.0), F.lit(0.0)
    c = {a: F.cos(f"angle_{a}") for a in AXES}
    s = {a: F.sin(f"angle_{a}") for a in AXES}
    x = [[one, zero, zero], [zero, c["x"], -s["x"]], [zero, s["x"], c["x"]]]
    y = [[c["y"], zero, s["y"]], [zero, one, zero], [-s["y"], zero, c["y"]]]
    z = [[c["z"], -s["z"], zero], [s["z"], c["z"], zero], [zero, zero, one]]
    h = [F.col(f"shear{k}") for k in range(6)]
    shear = [[one, h[0], h[1]], [h[2], one, h[3]], [h[4], h[5], one]]
    turned = _product(_product(_product(x, y), z), shear)
    return [[turned[i][j] * F.col(f"scale_{a}") for j, a in enumerate(AXES)] for i in range(3)]


def warped(df: DataFrame, n: int) -> DataFrame:
    """Samples drawn for it, resampled about the centre: ``raw`` between eight voxels, ``seg`` the nearest; mirrored at the edges' centres."""
    stay, some = df.filter("not warps"), df.filter("warps")
    middle, period = (n - 1) / 2, max(1, 2 * (n - 1))
    for k in range(3):
        place = sum((F.col(f"m{k}{j}") * (F.col(a) - middle) for j, a in enumerate(AXES)), F.lit(middle))
        some = some.withColumn(f"s{k}", place)

    def mirrored(at: Column) -> Column:
        m = F.pmod(at.cast("long"), F.lit(period))
        return F.least(m, period - m)

    corners = []
    for corner in range(9):  # the last is the nearest voxel, for labels
        weight, fields = F.lit(1.0), []
        for k, a in enumerate(AXES):
            s = F.col(f"s{k}")
            part = s - F.floor(s)
            at = F.floor(s + 0.5) if corner == 8 else F.floor(s) + (corner >> k & 1)
            weight = weight * (F.lit(1.0) if corner == 8 else part if corner >> k & 1 else 1 - part)
            fields.append(mirrored(at).alias(f"q{a}"))
        corners.append(F.struct(*fields, weight.alias("w"), F.lit(corner == 8).alias("label")))
    keys = ["sample", *AXES]
    reads = some.select(*keys, F.explode(F.array(*corners)).alias("c")).select(*keys, "c.*")
    source = some.select("sample", *(F.col(a).cast("long").alias(f"q{a}") for a in AXES), F.col("raw").alias("v"), F.col("seg").alias("g"))
    read = reads.join(source, ["sample", "qx", "qy", "qz"])
    value = F.sum(F.when(~F.col("label"), F.col("w") * F.col("v"))).alias("raw")
    done = read.groupBy(*keys).agg(value, F.max(F.when(F.col("label"), F.col("g"))).alias("seg"))
    return stay.select(*keys, "raw", "seg").unionByName(done)


def augmented(patches: DataFrame, n: int, settings: Settings, seed: int = 0) -> DataFrame:
    """sample, x, y, z, raw, seg after all steps, in their order; the same seed gives the same result.

    An empty table gives an empty result; a null value stays null unless its slice is dropped.
    """
    rows = patches.select("sample", *AXES, "raw", "seg")
    rows = rows.join(draws(rows, settings, seed), "sample")
    rows = oriented(rows, n)
    if settings.drop_slice > 0:
        rows = slices_dropped(rows, settings.drop_slice, seed)
    if settings.shift_slice > 0:
        rows = slices_shifted(rows, settings.shift_slice, settings.shift_magnitude, n, seed)
    if settings.multiply > 0 or settings.add > 0:
        rows = intensity_changed(rows)
    if settings.noise > 0:
        rows = noise_added(rows, seed)
    if settings.affine > 0:
        rows = warped(rows, n)
    return rows.select("sample", *AXES, "raw", "seg")
