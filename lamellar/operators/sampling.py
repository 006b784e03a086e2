"""Random patches and augmentation: draws are seeded columns, geometry is a remap of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamellar.functions.draws import chosen, normal, shuffled, uniform

AXES = ("x", "y", "z")


def position_range(offset: int, size: int, divisor: int, shape: int) -> tuple[int, int]:
    """First and last origin of a patch; quotients are rounded down, also below zero."""
    return offset + max(-size // divisor, -offset), shape - size - offset + min(offset, size // divisor)


def sample_positions(ids: DataFrame, shape: tuple[int, int, int], size: int, offset: int, divisor: int = 5, seed: int = 0) -> DataFrame:
    """Adds px, py, pz, drawn evenly from the range of each axis for the row's own values; equal rows draw the same."""
    out = ids
    for axis, n in zip(AXES, shape, strict=True):
        lo, hi = position_range(offset, size, divisor, n)
        if hi < lo:
            raise ValueError("the volume is too small for a patch")
        out = out.withColumn(f"p{axis}", (F.floor(uniform(seed, f"p{axis}", *ids.columns) * (hi - lo + 1)) + lo).cast("long"))
    return out


def weighted_choice(ids: DataFrame, weights: list[float], seed: int = 0) -> DataFrame:
    """Adds source: a number below ``len(weights)``, drawn by weight for the row's own values."""
    slot, within = (uniform(seed, what, *ids.columns) for what in ("slot", "within"))
    return ids.withColumn("source", chosen(weights, slot, within))


def epochs(samples: DataFrame, many: int, count: int, workers: int, seed: int = 0) -> DataFrame:
    """epoch, sample, position, worker and nth: each of ``many`` samples once in every epoch, in an order of its own.

    ``samples`` has ``sample``, from 0. Positions are a keyed permutation, so nothing is sorted or counted, and a worker
    takes every ``workers``-th of them; nth is the position among its own.
    """
    key = F.col("epoch") * 1_000_003 % 2_147_483_647 + seed % 1_000_000
    rows = samples.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    rows = rows.withColumn("position", shuffled(F.col("sample"), many, key % 2_147_483_647))
    return rows.withColumns({"worker": F.col("position") % workers, "nth": F.call_function("div", F.col("position"), F.lit(workers).cast("long"))})


def flipped(df: DataFrame, axis: str, n: int) -> DataFrame:
    return df.withColumn(axis, F.lit(n - 1) - F.col(axis))


def rotated(df: DataFrame, a: str, b: str, times: int, shape: dict[str, int]) -> DataFrame:
    """Quarter turns from axis ``a`` towards ``b``; odd ones swap the axes' sizes."""
    p, q, na, nb = F.col(a), F.col(b), shape[a], shape[b]
    to: dict[int, tuple[Column, Column]] = {
        0: (p, q),
        1: (F.lit(nb - 1) - q, p),
        2: (F.lit(na - 1) - p, F.lit(nb - 1) - q),
        3: (q, F.lit(na - 1) - p),
    }
    new_a, new_b = to[times % 4]
    return df.withColumns({a: new_a, b: new_b})


def permuted(df: DataFrame, order: tuple[str, str, str]) -> DataFrame:
    """The axes in another order: the first axis of the result is ``order[0]``."""
    return df.withColumns({axis: F.col(old) for axis, old in zip(AXES, order, strict=True)})


def drop_slices(df: DataFrame, axis: str, slices: DataFrame, value: str) -> DataFrame:
    """``value`` is 0 in the slices (a column named as the axis, at most one row per slice)."""
    gone = slices.select(axis).distinct().withColumn("__gone", F.lit(True))
    out = df.join(gone, axis, "left")
    return out.withColumn(value, F.when(F.col("__gone"), F.lit(0.0)).otherwise(F.col(value))).drop("__gone")


def random_slices(df: DataFrame, axis: str, probability: float, seed: int = 0) -> DataFrame:
    return df.select(axis).distinct().filter(uniform(seed, "slice", axis) < probability)


#: Along which axes the slices of an axis shift. One axis of each of the last two is the channel in the
#: source's view of a slice, where a shift changes nothing with one channel; kept so on purpose.
SHIFTED = {"x": ("z", "y"), "y": ("z",), "z": ("x",)}


def shift_slices(df: DataFrame, axis: str, shifts: DataFrame, shape: dict[str, int]) -> DataFrame:
    """Rolls slices: ``shifts`` has the axis and ``shift_<other>`` for each axis of SHIFTED."""
    out = df.join(shifts, axis, "left")
    for other in SHIFTED[axis]:
        moved = F.col(other) + F.coalesce(f"shift_{other}", F.lit(0))
        out = out.withColumn(other, F.pmod(moved, F.lit(shape[other]))).drop(f"shift_{other}")
    return out


def random_shifts(df: DataFrame, axis: str, probability: float, magnitude: int, seed: int = 0) -> DataFrame:
    one = df.select(axis).distinct().filter(uniform(seed, "slice", axis) < probability)
    draw = lambda o: F.floor(uniform(seed, f"shift {o}", axis) * (2 * magnitude + 1)) - magnitude
    return one.withColumns({f"shift_{o}": draw(o) for o in SHIFTED[axis]})


def intensity(df: DataFrame, value: str, factor: float | Column, add: float | Column) -> DataFrame:
    f, a = (c if isinstance(c, Column) else F.lit(c) for c in (factor, add))
    return df.withColumn(value, F.col(value) * f + a)


def random_intensity(df: DataFrame, keys: list[str], value: str, mul: float, add: float, seed: int = 0) -> DataFrame:
    """One factor and one addend per sample."""
    one = df.select(*keys).distinct()
    one = one.withColumns({"__f": 1 - mul + 2 * mul * uniform(seed, "factor", *keys), "__a": -add + 2 * add * uniform(seed, "addend", *keys)})
    return intensity(df.join(one, keys), value, F.col("__f"), F.col("__a")).drop("__f", "__a")


def noise(df: DataFrame, value: str, scale: float, seed: int = 0) -> DataFrame:
    """Adds normal noise, drawn for each place."""
    return df.withColumn(value, F.col(value) + scale * normal(seed, "noise", *(c for c in df.columns if c != value)))


def affine(df: DataFrame, value: str, matrix: list[list[float]], shape: tuple[int, int, int], nearest: bool = False) -> DataFrame:
    """Resamples a volume: the voxel at ``o`` reads the source at ``matrix[:, :3] @ o + matrix[:, 3]``.

    Linear between eight voxels, or the nearest one; places outside are mirrored at the edge voxels'
    centres. A join on voxel coordinates, no driver memory.
    """
    out = df.select(*AXES)
    for k, _ in enumerate(AXES):
        place = sum((F.col(a) * float(matrix[k][j]) for j, a in enumerate(AXES)), F.lit(float(matrix[k][3])))
        out = out.withColumn(f"__s{k}", place)
    corners = range(1) if nearest else range(8)
    listed = []
    for c in corners:
        fields, weight = [], F.lit(1.0)
        for k, (a, n) in enumerate(zip(AXES, shape, strict=True)):
            s, period = F.col(f"__s{k}"), max(1, 2 * (n - 1))
            if nearest:
                at = F.floor(s + 0.5)
            else:
                at = F.floor(s) + (c >> k & 1)
                part = s - F.floor(s)
                weight = weight * (part if c >> k & 1 else 1 - part)
            m = F.pmod(at, F.lit(period))
            fields.append(F.least(m, period - m).cast("long").alias(f"q{a}"))
        listed.append(F.struct(*fields, weight.alias("w")))
    rows = out.withColumn("c", F.explode(F.array(*listed))).filter("c.w <> 0")
    source = df.select(*(F.col(a).cast("long").alias(f"q{a}") for a in AXES), F.col(value).alias("__v"))
    rows = rows.select(*AXES, "c.*").join(source, [f"q{a}" for a in AXES])
    if nearest:
        return rows.select(*AXES, F.col("__v").alias(value))
    return rows.groupBy(*AXES).agg(F.sum(F.col("w") * F.col("__v")).alias(value))
