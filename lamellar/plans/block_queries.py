"""Queries on blocks of the voxel fixture, and on arrays; their statements are those of the queries on voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.functions import draws
from lamellar.operators import blocks, sampling, segmentation
from lamellar.operators import grid as patching
from lamellar.plans import grid_queries as grid
from lamellar.sources.array_source import read_array, write_array
from lamellar.sources.fixtures import VOXELS_SQL, voxels
from lamellar.sources.storage import fresh_dir, read_table

TYPES = {"seg": "<i8", "raw": "<f8", "a0": "<f4", "a1": "<f4", "a2": "<f4"}


def packed(spark: SparkSession, d: str, *columns: str) -> blocks.Blocks:
    """The columns of the whole volume, packed and kept."""
    rows = voxels(spark, d).select("x", "y", "z", *columns)
    return blocks.kept(blocks.from_voxels(rows, {c: TYPES[c] for c in columns}, segmentation.shape_of(rows)))


def _affs(spark, d):
    return blocks.to_voxels(blocks.affinities(packed(spark, d, "seg"), grid.LONG, labelled_only=True))


def block_aff_short(spark: SparkSession, d: str) -> DataFrame:
    return _affs(spark, d).select("x", "y", "z", "aff0", "aff1", "aff2")


def block_aff_long(spark: SparkSession, d: str) -> DataFrame:
    return _affs(spark, d).select("x", "y", "z", "aff3", "aff4", "aff5")


def block_loss_mask(spark: SparkSession, d: str) -> DataFrame:
    return _affs(spark, d).select("x", "y", "z", *(f"mask{k}" for k in range(6)))


def block_crop(spark: SparkSession, d: str) -> DataFrame:
    return blocks.to_voxels(blocks.crop(packed(spark, d, "seg"), *grid.BOX))


def block_hard_affinity(spark: SparkSession, d: str) -> DataFrame:
    return blocks.to_voxels(blocks.threshold(packed(spark, d, "a0", "a1", "a2"), grid.THRESHOLD))


def block_blur(spark: SparkSession, d: str) -> DataFrame:
    return blocks.to_voxels(blocks.blurred(packed(spark, d, "raw"), "raw")).select("x", "y", "z", F.round("raw", 6).alias("val"))


def block_components_affinity(spark: SparkSession, d: str) -> DataFrame:
    hard = blocks.kept(blocks.threshold(packed(spark, d, "a0", "a1", "a2"), grid.THRESHOLD))
    return blocks.to_voxels(blocks.affinity_components(hard))


def block_components_label6(spark: SparkSession, d: str) -> DataFrame:
    return blocks.to_voxels(blocks.label_components(packed(spark, d, "seg")))


def _array(spark, d):
    """The path of the whole volume's labels, written as an array of compressed chunks."""
    path = f"{fresh_dir(spark, 'array')}/seg"
    write_array(packed(spark, d, "seg"), path, "seg", compressor={"id": "zstd", "level": 1})
    return path


def array_volume(spark: SparkSession, d: str) -> DataFrame:
    return read_array(spark, _array(spark, d), "seg")


def array_box(spark: SparkSession, d: str) -> DataFrame:
    origin, size = grid.BOX
    return read_array(spark, _array(spark, d), "seg", {a: (o, o + size) for a, o in zip("xyz", origin, strict=True)})


def _patches(spark, d, *columns):
    """The voxels of all overlapping patches of the whole volume."""
    b = packed(spark, d, *columns)
    found, types = blocks.patches(b, patching.patches(spark, b.shape, grid.PATCH, True), grid.PATCH)
    return blocks.patch_voxels(found, types, grid.PATCH)


def block_patches(spark: SparkSession, d: str) -> DataFrame:
    return _patches(spark, d, "seg")


def block_blend(spark: SparkSession, d: str) -> DataFrame:
    """Predicted affinities as each patch reads them, off by a step of the patch's own, blended by distance to its border."""
    rows = _patches(spark, d, "a0", "a1", "a2")
    step = (F.col("px") + F.col("py") + F.col("pz")) % 7 / 10.0
    rows = rows.select("px", "py", "pz", "i", "j", "k", *((F.col(f"a{c}").cast("double") + step).alias(f"p{c}") for c in range(3)))
    return patching.blend(rows, grid.PATCH, True).select("x", "y", "z", *(F.round(f"p{c}", 6).alias(f"p{c}") for c in range(3)))


EPOCHS, WORKERS, SEED = 3, 4, 11


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a sample, and comes once in each epoch."""
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("sample"))
    many = rows.agg(F.max("sample") + 1).first()[0] or 0
    return sampling.epochs(rows, many, EPOCHS, WORKERS, SEED)


def _epoch_sql() -> str:
    """The same rounds, and numbers outside the range again until none is."""

    def once(source: str) -> str:
        rows = f"select *, x // side as l, x % side as r from {source}"
        for factor in draws.FACTORS:
            v = f"((r * {factor} + key) % {draws.PRIME})"
            rows = f"select * exclude (l, r), r as l, (l + ({v} * {v} + {v} * {factor} + 1) % {draws.PRIME}) % side as r from ({rows})"
        return f"select sample, epoch, key, many, side, l * side + r as x from ({rows})"

    start = "select o_orderkey as sample, epoch, (epoch * 1000003 % 2147483647 + {seed}) % 2147483647 as key, many, side, o_orderkey as x from orders, (select unnest(range({n})) as epoch), size"
    start = start.format(seed=SEED % 1_000_000, n=EPOCHS)
    return (
        "with recursive size as (select max(o_orderkey) + 1 as many, cast(floor(sqrt(max(o_orderkey))) as bigint) + 1 as side from orders), "
        f"walk as ({once(f'({start})')} union all {once('(select * from walk where x >= many)')}), last as (select * from walk where x < many) "
        f"select sample, epoch, x as position, x % {WORKERS} as worker, x // {WORKERS} as nth from last"
    )


def _patch_sql(columns: str) -> str:
    sizes = tuple(f"(select max({a}) + 1 from vox)" for a in "xyz")
    inside = " and ".join(f"{a} >= p{a} and {a} < p{a} + {grid.PATCH}" for a in "xyz")
    return f"with {VOXELS_SQL}, {grid._grid_sql(True, sizes)}, pv as (select px, py, pz, x - px as i, y - py as j, z - pz as k, {columns} from patch join vox on {inside})"


def _blend_sql() -> str:
    edge = lambda c: f"least({c} + 1, {grid.PATCH} - {c})"
    w = f"least({edge('i')}, {edge('j')}, {edge('k')})::double"
    values = ", ".join(f"round(sum({w} * (a{c}::double + (px + py + pz) % 7 / 10.0::double)) / sum({w}), 6) as p{c}" for c in range(3))
    return f"{_patch_sql('a0, a1, a2')} select px + i as x, py + j as y, pz + k as z, {values} from pv group by all"


#: The query on voxels that each one equals.
SAME_AS = {
    "block_aff_short": "aff_short",
    "block_aff_long": "aff_long",
    "block_loss_mask": "aff_loss_mask",
    "block_crop": "crop",
    "block_hard_affinity": "hard_affinity",
    "block_blur": "gaussian_blur",
    "block_components_affinity": "components_affinity",
    "block_components_label6": "components_label6",
}
QUERIES = {n: globals()[n] for n in [*SAME_AS, "array_volume", "array_box", "block_patches", "block_blend", "epoch_order"]}
SQL = {n: grid.SQL[same] for n, same in SAME_AS.items()} | {"array_volume": f"with {VOXELS_SQL} select x, y, z, seg from vox", "array_box": grid.SQL["crop"]}
SQL |= {"block_patches": f"{_patch_sql('seg')} select px, py, pz, i, j, k, seg from pv", "block_blend": _blend_sql(), "epoch_order": _epoch_sql()}
