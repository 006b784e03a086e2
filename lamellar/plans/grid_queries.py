"""Queries on the voxel fixture, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.functions import scalar
from lamellar.operators import affinity, augment, grid, sampling, segmentation, stats
from lamellar.sources.fixtures import VOXELS_SQL, voxels

LONG = 3
SHAPE, PATCH, CHUNK = (23, 10, 14), 6, 8
THRESHOLD = 0.8022
BOX = ((2, 1, 3), 5)


def _long(df: DataFrame, names: list[str], value: str, keys: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """One row per channel."""
    cells = F.array(*(F.struct(F.lit(k).cast("int").alias("ch"), F.col(n).alias(value)) for k, n in enumerate(names)))
    return df.select(*keys, F.explode(cells).alias("e")).select(*keys, "e.ch", f"e.{value}")


def _affs(spark, d, labelled_only=True):
    return affinity.affinities(voxels(spark, d).select("x", "y", "z", "seg"), LONG, labelled_only=labelled_only)


def aff_short(spark: SparkSession, d: str) -> DataFrame:
    return _affs(spark, d).select("x", "y", "z", "aff0", "aff1", "aff2")


def aff_long(spark: SparkSession, d: str) -> DataFrame:
    return _affs(spark, d).select("x", "y", "z", "aff3", "aff4", "aff5")


def aff_tristate(spark: SparkSession, d: str) -> DataFrame:
    affs = affinity.encoded(_affs(spark, d))
    return affs.select("x", "y", "z", *(F.col(f"aff{k}").cast("int").alias(f"aff{k}") for k in range(6)))


def aff_loss_mask(spark: SparkSession, d: str) -> DataFrame:
    return _affs(spark, d).select("x", "y", "z", *(f"mask{k}" for k in range(6)))


def aff_labeled_fraction(spark: SparkSession, d: str) -> DataFrame:
    return affinity.labelled_fraction(_affs(spark, d)).select(F.round("labelled_fraction", 9).alias("labelled_fraction"))


def seg_center_pad(spark: SparkSession, d: str) -> DataFrame:
    inner = grid.box(voxels(spark, d).select("x", "y", "z", "seg"), (0, 0, 0), 6)
    return grid.centre_pad(inner, (10, 12, 8))


def box_slice(spark: SparkSession, d: str) -> DataFrame:
    return grid.box(voxels(spark, d).select("x", "y", "z", "seg"), *BOX, LONG)


def crop(spark: SparkSession, d: str) -> DataFrame:
    return grid.box(box_slice(spark, d), *BOX)


def middle_slice(spark: SparkSession, d: str) -> DataFrame:
    return grid.middle_slice(voxels(spark, d).select("x", "y", "z", "seg"))


def seg_colours(spark: SparkSession, d: str) -> DataFrame:
    rgb = [F.round(scalar.colour(F.col("seg"), k), 9).alias(c) for k, c in enumerate("rgb")]
    return voxels(spark, d).select("x", "y", "z", *rgb)


def image_log(spark: SparkSession, d: str) -> DataFrame:
    """The middle slice's image, affinities and coloured segments, as pixels."""
    tags = {"val_img": [scalar.normalised(F.col("raw"), 255)], "val_aff": [F.col(f"a{k}") for k in range(3)], "val_seg": [scalar.colour(F.col("seg"), k) for k in range(3)]}
    return grid.slice_images(voxels(spark, d), tags, 7).withColumn("value", F.round("value", 6))


def img_normalize(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).select("x", "y", "z", F.round(scalar.normalised(F.col("raw"), 255), 9).alias("val"))


def axis_move(spark: SparkSession, d: str) -> DataFrame:
    """A trailing channel axis becomes a column of the long form."""
    return voxels(spark, d).select(F.lit(0).alias("c"), "x", "y", "z", "raw")


def scaled_sigmoid(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("raw") / 16 - 8
    return voxels(spark, d).select("x", "y", "z", F.round(scalar.scaled_sigmoid(x), 9).alias("val"))


def hard_affinity(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.hard(voxels(spark, d), THRESHOLD).select("x", "y", "z", "a0", "a1", "a2")


def channel_slice(spark: SparkSession, d: str) -> DataFrame:
    rows = _long(voxels(spark, d), ["a0", "a1", "a2"], "val").filter("ch < 2")
    return rows.select("x", "y", "z", "ch", F.round(F.col("val").cast("double"), 6).alias("val"))


def masked_bce(spark: SparkSession, d: str) -> DataFrame:
    affs = affinity.encoded(affinity.affinities(voxels(spark, d), LONG, labelled_only=True))
    logit = (F.col("a0").cast("double") - 0.5) * 4
    rows = affs.select(F.col("aff0").alias("target"), scalar.bce_with_logits(logit, F.col("aff0")).alias("loss"))
    return stats.masked_bce(rows, "loss", "target").select(F.round("loss", 7).alias("loss"), "n")


def patch_offsets(spark: SparkSession, d: str) -> DataFrame:
    sizes = [(10, 4), (12, 4), (4, 4), (23, 6)]
    rows = None
    for big, small in sizes:
        one = spark.range(1).select(F.lit(big).cast("long").alias("big"), F.lit(small).cast("long").alias("small"), F.explode(grid.offsets(big, small)).alias("start")).withColumn("start", F.col("start").cast("long"))
        rows = one if rows is None else rows.union(one)
    return rows


def _patches(spark, overlap):
    return grid.patches(spark, SHAPE, PATCH, overlap).select(*(F.col(c).cast("long").alias(c) for c in ("px", "py", "pz")))


def patch_grid(spark: SparkSession, d: str) -> DataFrame:
    return _patches(spark, False)


def patch_overlap_grid(spark: SparkSession, d: str) -> DataFrame:
    return _patches(spark, True)


def patch_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = grid.chunks(_patches(spark, True), CHUNK, PATCH)
    return rows.select("cx", "cy", "cz", "n", F.array_join(F.transform("patches", lambda p: F.concat_ws("-", p.px, p.py, p.pz)), ",").alias("patches"))


def chunk_bbox(spark: SparkSession, d: str) -> DataFrame:
    return grid.chunks(_patches(spark, True), CHUNK, PATCH).select("cx", "cy", "cz", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z")


def patch_weight(spark: SparkSession, d: str) -> DataFrame:
    cell = spark.range(PATCH**3).selectExpr(f"id div {PATCH * PATCH} as i", f"(id div {PATCH}) % {PATCH} as j", f"id % {PATCH} as k")
    return cell.select("i", "j", "k", grid.weight(F.col("i"), F.col("j"), F.col("k"), PATCH).cast("long").alias("w"))


def _predictions(spark, shape, overlap):
    """Each patch predicts its voxels, off by an amount of its own; patches are dealt by block."""
    patch = grid.patches(spark, shape, PATCH, overlap).select(*(F.col(c).cast("long").alias(c) for c in ("px", "py", "pz")))
    patch = grid.by_block(patch, shape, PATCH)
    cell = F.explode(F.sequence(F.lit(0), F.lit(PATCH**3 - 1))).alias("at")
    rows = patch.select("block", "px", "py", "pz", cell)
    rows = rows.selectExpr("block", "px", "py", "pz", f"at div {PATCH * PATCH} as i", f"(at div {PATCH}) % {PATCH} as j", f"at % {PATCH} as k")
    value = lambda c: (((F.col("px") + F.col("i")) * 31 + (F.col("py") + F.col("j")) * 17 + (F.col("pz") + F.col("k")) * 7 + F.col("px") * c + F.col("py")) % 101) / 101.0
    return rows.select("block", "px", "py", "pz", "i", "j", "k", *(value(c).alias(f"p{c}") for c in range(3)))


def _blended(spark, d, overlap):
    shape = segmentation.shape_of(voxels(spark, d).select("x", "y", "z"))
    rows = grid.blend(_predictions(spark, shape, overlap), PATCH, overlap, shape=shape)
    return rows.select(*(F.col(a).cast("long").alias(a) for a in "xyz"), *(F.round(f"p{k}", 7).alias(f"p{k}") for k in range(3)))


def blend_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d, True)


def blend_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _blended(spark, d, False)


def components_affinity(spark: SparkSession, d: str) -> DataFrame:
    aff = segmentation.hard(voxels(spark, d), THRESHOLD)
    return segmentation.affinity_components(aff)


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = components_affinity(spark, d).filter("seg > 0").groupBy("seg").agg(F.count("*").alias("n"))
    return rows


def components_label6(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.label_components(voxels(spark, d).select("x", "y", "z", "seg"))


def node_label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every voxel is a node; the labels are those of the components."""
    nodes = voxels(spark, d).select("x", "y", "z", (F.col("x") * 100 + F.col("y") * 10 + F.col("z")).alias("node"))
    return segmentation.label_lookup(nodes, components_affinity(spark, d)).select("node", "pred")


def voxel_to_nm(spark: SparkSession, d: str) -> DataFrame:
    setting = F.when(F.col("seg") % 2 == 0, "liconn").otherwise("default")
    return voxels(spark, d).select("x", "y", "z", *(scalar.to_nanometres(a, F.col(a), setting).alias(f"n{a}") for a in "xyz"))


def clip_rescale(spark: SparkSession, d: str) -> DataFrame:
    return voxels(spark, d).select("x", "y", "z", scalar.clip_rescale(F.col("raw")).alias("val"))


def gaussian_blur(spark: SparkSession, d: str) -> DataFrame:
    return grid.blurred(voxels(spark, d).select("x", "y", "z", "raw"), "raw").select(*(F.col(a).cast("long").alias(a) for a in "xyz"), F.round("raw", 6).alias("val"))


def concat_union(spark: SparkSession, d: str) -> DataFrame:
    v = voxels(spark, d)
    a, b = v.filter("x < 5").select("x", "y", "z", "seg"), v.filter("x >= 3").select("seg", "z", "y", "x")
    return a.unionByName(b)


def aug_flip_rot(spark: SparkSession, d: str) -> DataFrame:
    """Axes z, x, y; a quarter turn from x to y; a half turn from y to z; flipped along z."""
    v = voxels(spark, d).select("x", "y", "z", "seg")
    nx, ny, nz = segmentation.shape_of(v)
    part = sampling.permuted(v, ("z", "x", "y"))
    part = sampling.rotated(part, "x", "y", 1, {"x": nz, "y": nx, "z": ny})
    part = sampling.rotated(part, "y", "z", 2, {"x": nx, "y": nz, "z": ny})
    return sampling.flipped(part, "z", ny)


def aug_drop(spark: SparkSession, d: str) -> DataFrame:
    v = voxels(spark, d).select("x", "y", "z", "raw")
    return sampling.drop_slices(v, "z", spark.range(10).filter("id % 3 = 1").select(F.col("id").alias("z")), "raw")


def aug_shift(spark: SparkSession, d: str) -> DataFrame:
    part = voxels(spark, d).select("x", "y", "z", "raw")
    shape = segmentation.shape_of(part)
    shifts = spark.range(shape[0]).filter("id % 2 = 0").selectExpr("id as x", "id - 7 as shift_z", "3 - id as shift_y")
    return sampling.shift_slices(part, "x", shifts, dict(zip("xyz", shape, strict=True)))


def aug_intensity(spark: SparkSession, d: str) -> DataFrame:
    return sampling.intensity(voxels(spark, d).select("x", "y", "z", "raw"), "raw", 1.5, -3.0)


def aug_noise(spark: SparkSession, d: str) -> DataFrame:
    return sampling.noise(voxels(spark, d).select("x", "y", "z", "raw"), "raw", 0.1, seed=3)


def aug_affine(spark: SparkSession, d: str) -> DataFrame:
    """Moved by half a voxel along x and 1.25 along z."""
    part = voxels(spark, d).select("x", "y", "z", "raw")
    m = [[1, 0, 0, 0.5], [0, 1, 0, 0], [0, 0, 1, 1.25]]
    return sampling.affine(part, "raw", m, segmentation.shape_of(part)).select("x", "y", "z", F.round("raw", 6).alias("raw"))


def aug_random(spark: SparkSession, d: str) -> DataFrame:
    """Every cube of five voxels a side is a sample; all steps are on."""
    cube = "(x div 5) * 10000 + (y div 5) * 100 + z div 5 as sample"
    rows = voxels(spark, d).selectExpr(cube, "x % 5 as x", "y % 5 as y", "z % 5 as z", "raw", "seg")
    on = augment.Settings(0.1, 0.1, 2, 0.1, 0.1, 0.1, 0.5, 0.1, 0.1)
    return augment.augmented(rows, 5, on, seed=3)


def sample_positions(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_positions(spark.range(1000), (150, 100, 90), 32, 8, seed=5)


def weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    return sampling.weighted_choice(spark.range(1000), [0.2, 0.5, 0.3], seed=5)


NAMES = (
    "aff_short aff_long aff_tristate aff_loss_mask aff_labeled_fraction seg_center_pad box_slice crop middle_slice seg_colours image_log img_normalize axis_move "
    "scaled_sigmoid hard_affinity channel_slice masked_bce patch_offsets patch_grid patch_overlap_grid patch_chunks chunk_bbox patch_weight "
    "blend_overlap blend_no_overlap components_affinity component_sizes components_label6 node_label_lookup voxel_to_nm clip_rescale "
    "gaussian_blur concat_union aug_flip_rot aug_drop aug_shift aug_intensity aug_noise aug_affine aug_random sample_positions weighted_choice"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

# DuckDB.
_STEPS = [("x", 1), ("y", 1), ("z", 1), ("x", LONG), ("y", LONG), ("z", LONG)]


def _neighbour_sql() -> str:
    joins, columns = [], []
    for k, (axis, step) in enumerate(_STEPS):
        on = " and ".join(f"n{k}.{a} = v.{a}" + (f" + {step}" if a == axis else "") for a in "xyz")
        joins.append(f"left join vox n{k} on {on}")
        columns += [
            f"coalesce(v.seg = n{k}.seg and v.seg <> 0, false) as aff{k}",
            f"coalesce(v.seg <> -1 and n{k}.seg <> -1, false) as mask{k}",
        ]
    return f"affs as (select v.x, v.y, v.z, v.a0, {', '.join(columns)} from vox v {' '.join(joins)})"


_AFFS = f"with {VOXELS_SQL}, {_neighbour_sql()}"
_VOX = f"with {VOXELS_SQL}"


def _grid_sql(overlap: bool, shape: tuple = SHAPE) -> str:
    axis = lambda n: f"(select unnest(list_distinct(list_append(range(0, {n} - {PATCH} + 1, {PATCH}), {n} - {PATCH}))) as o)"
    base = f"base as (select a.o as px, b.o as py, c.o as pz from {axis(shape[0])} a, {axis(shape[1])} b, {axis(shape[2])} c)"
    if not overlap:
        return f"{base}, patch as (select * from base)"
    h = PATCH // 2
    return (
        f"{base}, moved as (select px + i * {h} as px, py + j * {h} as py, pz + k * {h} as pz, i + j + k as d from base, "
        f"(select unnest([0, 1]) as i), (select unnest([0, 1]) as j), (select unnest([0, 1]) as k)), "
        f"patch as (select distinct px, py, pz from moved where d = 0 or (px + {PATCH} <= {shape[0]} and py + {PATCH} <= {shape[1]} and pz + {PATCH} <= {shape[2]}))"
    )


def _blend_sql(overlap: bool) -> str:
    sizes = tuple(f"(select max({a}) + 1 from vox)" for a in "xyz")
    edge = lambda c: f"least({c} + 1, {PATCH} - {c})"
    w = f"cast(least({edge('i')}, {edge('j')}, {edge('k')}) as double)" if overlap else "1.0::double"
    cells = ", ".join(f"(select unnest(range(0, {PATCH})) as {c})" for c in "ijk")
    value = lambda c: f"(((px + i) * 31 + (py + j) * 17 + (pz + k) * 7 + px * {c} + py) % 101) / 101.0::double"
    sums = ", ".join(f"round(sum(w * p{c}) / sum(w), 7) as p{c}" for c in range(3))
    return (
        f"{_VOX}, {_grid_sql(overlap, sizes)}, pred as (select px + i as x, py + j as y, pz + k as z, {w} as w, "
        f"{', '.join(f'{value(c)} as p{c}' for c in range(3))} from patch, {cells}) select x, y, z, {sums} from pred group by all"
    )


def _components_sql(edges: str, vertices: str) -> str:
    """Labels spread along edges as long as they are less than the vertex they reach."""
    return (
        f"both_ways as (select u, v from ({edges}) union select v, u from ({edges})), "
        f"spread as (select v, v as label from ({vertices}) union select b.v, s.label from spread s join both_ways b on b.u = s.v where s.label < b.v), "
        f"roots as (select v, min(label) as root from spread group by v)"
    )


RASTER_SQL = "vx as (select *, (x * (select max(y) + 1 from vox) + y) * (select max(z) + 1 from vox) + z as vid from vox)"
STEP_SQL = {"x": "(select (max(y) + 1) * (max(z) + 1) from vox)", "y": "(select max(z) + 1 from vox)", "z": "1"}
_TRUE = {a: f"a{k} > cast({THRESHOLD} as float)" for k, a in enumerate("xyz")}
_EDGES = " union all ".join(f"select vid as u, vid + {STEP_SQL[a]} as v from vx where {_TRUE[a]} and {a} + 1 < (select max({a}) + 1 from vox)" for a in "xyz")
COMPONENTS_SQL = (
    f"with recursive {VOXELS_SQL}, {RASTER_SQL}, e as ({_EDGES}), vert as (select vid as v from vx where {' or '.join(_TRUE.values())} union select v from e), "
    + _components_sql("select u, v from e", "select v from vert")
    + ", num as (select root, dense_rank() over (order by root) as seg from (select distinct root from roots)), "
    "seg6 as (select x, y, z, coalesce(num.seg, 0) as seg from vx left join roots on vid = v left join num on roots.root = num.root)"
)
_SAME = " union all ".join(
    f"select a.vid as u, b.vid as v from vx a join vx b on a.seg = b.seg and a.seg > 0 and "
    + " and ".join(f"b.{c} = a.{c}" + (" + 1" if c == a else "") for c in "xyz")
    for a in "xyz"
)
_LABELS = (
    f"with recursive {VOXELS_SQL}, {RASTER_SQL}, e as ({_SAME}), "
    + _components_sql("select u, v from e", "select vid as v from vx where seg > 0")
    + ", num as (select root, dense_rank() over (order by root) as n from (select distinct root from roots)) "
    "select x, y, z, case when vx.seg > 0 then n else vx.seg end as seg from vx left join roots on vid = v left join num on roots.root = num.root"
)


def _colour_sql(channel: int) -> str:
    prime, factors = scalar._COLOURS
    return f"case when seg = 0 then 0.0::double else ((seg * {factors[channel]} % {prime} + {prime}) % {prime}) / {prime}::double end"


def _in_box(origin: tuple, size: int) -> str:
    return " and ".join(f"{a} >= {o} and {a} < {o + size}" for a, o in zip("xyz", origin))


def _blur_sql() -> str:
    ctes, last = ["i0 as (select x, y, z, raw as v from vox)"], "i0"
    for n, a in enumerate("xyz", 1):
        at, size = f"{a} + d", _size_sql(a)
        others = [c for c in "xyz" if c != a]
        ctes.append(
            f"g{n} as (select {', '.join(others)}, {a} as t, case when {at} < 0 then -1 - ({at}) when {at} >= {size} then 2 * {size} - 1 - ({at}) else {at} end as s, w "
            f"from {last}, kernel), i{n} as (select {', '.join(f'g.{c} as {c}' for c in others)}, g.t as {a}, sum(g.w * i.v) as v "
            f"from g{n} g join {last} i on {' and '.join(f'i.{c} = g.{c}' for c in others)} and i.{a} = g.s group by all)"
        )
        last = f"i{n}"
    kernel = "k0 as (select unnest(range(-8, 9)) as d), kernel as (select d, exp(-0.5 * d * d / 4) / (select sum(exp(-0.5 * d * d / 4)) from k0) as w from k0)"
    return f"{_VOX}, {kernel}, {', '.join(ctes)} select x, y, z, round(v, 6) as val from {last}"


def _size_sql(axis: str) -> str:
    return f"(select max({axis}) + 1 from vox)"


def _mirror_sql(at: str, axis: str) -> str:
    period = f"(2 * {_size_sql(axis)} - 2)"
    return f"least({at} % {period}, {period} - {at} % {period})"


SQL = {
    "aff_short": f"{_AFFS} select x, y, z, aff0, aff1, aff2 from affs",
    "aff_long": f"{_AFFS} select x, y, z, aff3, aff4, aff5 from affs",
    "aff_tristate": f"{_AFFS} select x, y, z, {', '.join(f'case when mask{k} then cast(aff{k} as int) else -1 end as aff{k}' for k in range(6))} from affs",
    "aff_loss_mask": f"{_AFFS} select x, y, z, {', '.join(f'mask{k}' for k in range(6))} from affs",
    "aff_labeled_fraction": f"{_AFFS} select round(({' + '.join(f'avg(cast(mask{k} as int))' for k in range(6))}) / 6, 9) as labelled_fraction from affs",
    "seg_center_pad": f"{_VOX}, small as (select * from vox where {_in_box((0, 0, 0), 6)}), cell as (select * from (select unnest(range(0, 10)) as x), "
    "(select unnest(range(0, 12)) as y), (select unnest(range(0, 8)) as z)) select cell.x, cell.y, cell.z, coalesce(seg, -1) as seg from cell "
    "left join small on small.x = cell.x - (10 - 6) // 2 and small.y = cell.y - (12 - 6) // 2 and small.z = cell.z - (8 - 6) // 2",
    "box_slice": f"{_VOX} select x, y, z, seg from vox where {_in_box(BOX[0], BOX[1] + LONG)}",
    "crop": f"{_VOX} select x, y, z, seg from vox where {_in_box(*BOX)}",
    "middle_slice": f"{_VOX} select x, y, z, seg from vox where x = (select (max(x) + 1) // 2 from vox)",
    "seg_colours": f"{_VOX} select x, y, z, {', '.join(f'round({_colour_sql(k)}, 9) as {c}' for k, c in enumerate('rgb'))} from vox",
    "image_log": f"{_VOX}, m as (select * from vox where x = (select (max(x) + 1) // 2 from vox)), p as (select y, z, 'val_img' as tag, 0 as c, raw / 255 as v from m "
    + " ".join(f"union all select y, z, 'val_aff', {k}, cast(a{k} as double) from m union all select y, z, 'val_seg', {k}, {_colour_sql(k)} from m" for k in range(3))
    + ") select tag, 7 as step, y as i, z as j, c, round(v, 6) as value from p",
    "img_normalize": f"{_VOX} select x, y, z, round(raw / 255, 9) as val from vox",
    "axis_move": f"{_VOX} select 0 as c, x, y, z, raw from vox",
    "scaled_sigmoid": f"{_VOX} select x, y, z, round(1 / (1 + exp(-0.2::double * (raw / 16 - 8))), 9) as val from vox",
    "hard_affinity": f"{_VOX} select x, y, z, {', '.join(f'{t} as a{k}' for k, t in enumerate(_TRUE.values()))} from vox",
    "channel_slice": f"{_VOX} select x, y, z, 0 as ch, round(cast(a0 as double), 6) as val from vox union all select x, y, z, 1, round(cast(a1 as double), 6) from vox",
    "masked_bce": f"{_AFFS}, l as (select (cast(a0 as double) - 0.5) * 4 as x, cast(aff0 as int) as y from affs where mask0) "
    "select round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 7) as loss, count(*) as n from l",
    "patch_offsets": "select big::bigint as big, small::bigint as small, unnest(list_distinct(list_append(range(0, big - small + 1, small), big - small)))::bigint as start "
    "from (values (10, 4), (12, 4), (4, 4), (23, 6)) t(big, small)",
    "patch_grid": f"with {_grid_sql(False)} select * from patch",
    "patch_overlap_grid": f"with {_grid_sql(True)} select * from patch",
    "patch_chunks": f"with {_grid_sql(True)} select px // {CHUNK} as cx, py // {CHUNK} as cy, pz // {CHUNK} as cz, count(*) as n, "
    "string_agg(px || '-' || py || '-' || pz, ',' order by px, py, pz) as patches from patch group by 1, 2, 3",
    "chunk_bbox": f"with {_grid_sql(True)} select px // {CHUNK} as cx, py // {CHUNK} as cy, pz // {CHUNK} as cz, min(px) as lo_x, max(px) + {PATCH} as hi_x, "
    f"min(py) as lo_y, max(py) + {PATCH} as hi_y, min(pz) as lo_z, max(pz) + {PATCH} as hi_z from patch group by 1, 2, 3",
    "patch_weight": f"select i, j, k, least(i + 1, {PATCH} - i, j + 1, {PATCH} - j, k + 1, {PATCH} - k) as w from "
    + ", ".join(f"(select unnest(range(0, {PATCH})) as {c})" for c in "ijk"),
    "blend_overlap": _blend_sql(True),
    "blend_no_overlap": _blend_sql(False),
    "components_affinity": f"{COMPONENTS_SQL} select x, y, z, seg from seg6",
    "component_sizes": f"{COMPONENTS_SQL} select seg, count(*) as n from seg6 where seg > 0 group by seg",
    "components_label6": _LABELS,
    "node_label_lookup": f"{COMPONENTS_SQL} select x * 100 + y * 10 + z as node, seg as pred from seg6",
    "voxel_to_nm": f"{_VOX} select x, y, z, x * 9.0::double as nx, y * 9.0::double as ny, z * case when seg % 2 = 0 then 12.0::double else 20.0::double end as nz from vox",
    "clip_rescale": f"{_VOX} select x, y, z, (least(greatest(raw, 112), 144) - 112) * 8 as val from vox",
    "gaussian_blur": _blur_sql(),
    "concat_union": f"{_VOX} select x, y, z, seg from vox where x < 5 union all select x, y, z, seg from vox where x >= 3",
    # The permutation takes (x, y, z) to (z, x, y); then (x, y) to (last - y, x), and both of y, z are turned round, and z back.
    "aug_flip_rot": f"{_VOX} select {_size_sql('x')} - 1 - x as x, {_size_sql('z')} - 1 - z as y, y as z, seg from vox",
    "aug_drop": f"{_VOX} select x, y, z, case when z % 3 = 1 then 0 else raw end as raw from vox",
    "aug_shift": f"{_VOX}, n as (select {_size_sql('y')} as ny, {_size_sql('z')} as nz) select x, case when x % 2 = 0 then ((y + 3 - x) % ny + ny) % ny else y end as y, "
    "case when x % 2 = 0 then ((z + x - 7) % nz + nz) % nz else z end as z, raw from vox, n",
    "aug_intensity": f"{_VOX} select x, y, z, raw * 1.5::double - 3 as raw from vox",
    "aug_affine": f"{_VOX}, "
    "m as (select x, y, z, x + i as p, z + 1 + k as q, 0.5 * case when k = 1 then 0.25::double else 0.75::double end as w from vox, (select unnest([0, 1]) as i), (select unnest([0, 1]) as k)), "
    f"r as (select x, y, z, {_mirror_sql('p', 'x')} as p, {_mirror_sql('q', 'z')} as q, w from m) "
    "select r.x, r.y, r.z, round(sum(r.w * b.raw), 6) as raw from r join vox b on b.x = r.p and b.y = r.y and b.z = r.q group by all",
}
