"""Volumes as blocks against the operators on voxels, and what they shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamellar.operators import affinity, blocks, grid, segmentation
from lamellar.plans import block_queries
from lamellar.sources.fixtures import voxels
from lamellar.sources.storage import materialise

SF = "/root/testdata/sf0.001"
TYPES = {"seg": "<i8", "raw": "<f8", "a0": "<f4", "a1": "<f4", "a2": "<f4"}


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("x", "y", "z", *sorted(set(df.columns) - {"x", "y", "z"})).collect())


@pytest.fixture(scope="module")
def volume(spark):
    """With holes, and blocks of four voxels a side at most."""
    return materialise(voxels(spark, SF).filter("(x * 7 + y * 3 + z) % 11 <> 0 and (x > 3 or y > 3 or z > 3)").select("x", "y", "z", *TYPES), "volume")


@pytest.fixture(scope="module")
def packed(volume):
    return blocks.kept(blocks.from_voxels(volume, TYPES, segmentation.shape_of(volume), 4))


def test_there_and_back(volume, packed):
    assert rows(blocks.to_voxels(packed)) == rows(volume)
    assert packed.rows.filter("bx = 0 and by = 0 and bz = 0").count() == 0  # no voxel, no block


def test_affinities(volume, packed):
    for labelled in (False, True):
        want = affinity.affinities(volume.select("x", "y", "z", "seg"), 3, labelled_only=labelled).drop("seg")
        assert rows(blocks.to_voxels(blocks.affinities(packed, 3, labelled))) == rows(want)


def test_crop_and_threshold(volume, packed):
    assert rows(blocks.to_voxels(blocks.crop(packed, (2, 1, 3), 5, 3))) == rows(grid.box(volume, (2, 1, 3), 5, 3))
    want = segmentation.hard(volume, 0.8022).select("x", "y", "z", "a0", "a1", "a2")
    assert rows(blocks.to_voxels(blocks.threshold(packed, 0.8022))) == rows(want)


def test_a_crop_reads_the_blocks_it_meets(packed):
    plan = blocks.crop(packed, (0, 0, 0), 4).rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(bx)" in plan and "LessThanOrEqual(bx,0)" in plan


def test_blur(volume, packed):
    want = grid.blurred(volume.select("x", "y", "z", "raw"), "raw", 1.0)
    got = blocks.to_voxels(blocks.blurred(packed, "raw", 1.0))
    assert [r[:3] for r in rows(got)] == [r[:3] for r in rows(want)]
    assert np.allclose([r[3] for r in rows(got)], [r[3] for r in rows(want)])


def test_components(volume, packed):
    shape = segmentation.shape_of(volume)
    got = blocks.affinity_components(blocks.kept(blocks.threshold(packed, 0.8022)))
    assert rows(blocks.to_voxels(got)) == rows(segmentation.affinity_components(segmentation.hard(volume, 0.8022), shape, 4))
    want = segmentation.label_components(volume.select("x", "y", "z", "seg"), shape, 4)
    assert rows(blocks.to_voxels(blocks.label_components(packed))) == rows(want)


def test_faults(packed, spark):
    with pytest.raises(ValueError, match="wider than a block"):
        blocks.with_halo(packed, ["seg"], 5, 0, corners=False)
    with pytest.raises(ValueError, match="beyond the volume"):
        blocks.blurred(packed, "raw", 4.0)
    none = blocks.from_voxels(spark.createDataFrame([], "x long, y long, z long, seg long"), {"seg": "<i8"}, (4, 4, 4), 4)
    assert blocks.to_voxels(blocks.label_components(blocks.kept(none))).count() == 0


def shuffled_bytes(spark, df):
    """Bytes that exchanges write while ``df`` is computed, from the executed plan's own metrics."""
    plan = df._jdf.queryExecution().executedPlan()
    assert plan.execute().count() >= 0
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if kind == "ShuffleExchangeExec":
            found += node.metrics().get("shuffleBytesWritten").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_halos_alone_are_shuffled(spark):
    """A volume of 64 by 128 by 128 voxels in blocks of 64 a side: less than a tenth of the voxels' bytes is sent."""
    n = (64, 128, 128)
    v = spark.range(n[0] * n[1] * n[2]).select(
        F.expr(f"id div {n[1] * n[2]}").alias("x"), F.expr(f"id div {n[2]} % {n[1]}").alias("y"), F.expr(f"id % {n[2]}").alias("z"), F.expr("1 + (id div 64) % 5").alias("seg")
    )
    v = v.withColumn("raw", (F.col("seg") * 37 + F.col("z")) % 256)
    b = blocks.kept(blocks.from_voxels(v, {"seg": "<i8", "raw": "u1"}, n))
    size = 40 * n[0] * n[1] * n[2]  # five longs a voxel
    for made in (blocks.affinities(b, 10), blocks.crop(b, (5, 6, 7), 70), blocks.blurred(b, "raw")):
        sent = shuffled_bytes(spark, made.rows)
        assert (sent > 0) == (made.types.keys() != b.types.keys()) and sent < size / 10
    plan = blocks.affinities(b, 10).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", block_queries.QUERIES)
def test_queries_are_registered(name):
    import __spark_entry__ as entry

    assert name in entry.queries() and name in entry.oracle_sql()


def test_patches(spark, volume, packed):
    """Patches at every place, some of them beyond the volume, against filters of boxes."""
    origins = spark.createDataFrame([(x, y, z) for x in range(-2, 15, 3) for y in range(0, 10, 3) for z in range(-1, 10, 4)] + [(0, 0, 3)] * 2, "px long, py long, pz long")
    found, types = blocks.patches(packed, origins, 6)
    assert found.count() == found.select("px", "py", "pz").distinct().count()
    at = lambda a: (F.col(a) >= F.col(f"p{a}")) & (F.col(a) < F.col(f"p{a}") + 6)
    want = F.broadcast(origins.distinct()).join(volume, at("x") & at("y") & at("z"))
    want = want.select("px", "py", "pz", *((F.col(a) - F.col(f"p{a}")).alias(i) for a, i in zip("xyz", "ijk")), *TYPES)
    got = blocks.patch_voxels(found, types, 6)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_ten_thousand_patches_read_each_block_once(spark, packed):
    origins = spark.range(10_000).select(F.expr("id % 10").alias("px"), F.expr("id div 10 % 10").alias("py"), F.expr("id div 100 % 5").alias("pz"))
    found, _ = blocks.patches(packed, origins, 5)
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.execute().count() >= 0
    read, todo = 0, [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        if kind == "FileSourceScanExec":
            read += node.metrics().get("numOutputRows").get().value()
    assert 0 < read <= packed.rows.count()
