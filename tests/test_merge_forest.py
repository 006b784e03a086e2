"""The forest of merges against a labelling for each threshold."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamellar.operators import blocks, merge_forest, segmentation, threshold_scores
from lamellar.sources.fixtures import voxels
from lamellar.sources.storage import materialise

SF = "/root/testdata/sf0.001"
TYPES = {"a0": "<f4", "a1": "<f4", "a2": "<f4"}
CUTS = [0.9002, 0.1, 0.55, 0.8022, 0.97, 0.55]


@pytest.fixture(scope="module", params=["whole", "holes"])
def volume(spark, request):
    rows = voxels(spark, SF).select("x", "y", "z", *TYPES)
    if request.param == "holes":
        rows = rows.filter("(x * 7 + y * 3 + z) % 11 <> 0").withColumn("a1", F.expr("case when (x + y) % 13 = 0 then cast('NaN' as float) else a1 end"))
    return materialise(rows, "volume")


@pytest.fixture(scope="module")
def forest(volume):
    packed = blocks.kept(blocks.from_voxels(volume, TYPES, segmentation.shape_of(volume), 4))
    return merge_forest.merge_forest(packed, CUTS)


def firsts(spark, df, shape):
    """Each voxel with the raster number of the first voxel of its segment, and 1; 0 for none."""
    rows = df.withColumn("at", (F.col("x") * shape[1] + F.col("y")) * shape[2] + F.col("z"))
    first = rows.filter("seg > 0").groupBy("seg").agg((F.min("at") + 1).alias("first"))
    return sorted(map(tuple, rows.join(first, "seg", "left").select("x", "y", "z", F.coalesce("first", F.lit(0))).collect()))


def test_cuts_are_labellings(spark, volume, forest):
    shape = segmentation.shape_of(volume)
    for at in sorted(set(CUTS)):
        want = segmentation.affinity_components(segmentation.hard(volume, at), shape, 4)
        got = blocks.to_voxels(merge_forest.cut(forest, at))
        assert sorted(map(tuple, got.select("x", "y", "z", "seg").collect())) == firsts(spark, want, shape)


def test_labels_of_nodes(volume, forest):
    nodes = volume.filter("x % 2 = 0").select("x", "y", "z", (F.col("x") * 3).alias("node"))
    found = merge_forest.labels(forest, nodes)
    assert found.columns == ["x", "y", "z", "node", "level", "seg"]
    for at in sorted(set(CUTS)):
        want = blocks.to_voxels(merge_forest.cut(forest, at)).filter("x % 2 = 0").selectExpr("x", "y", "z", "x * 3 as node", "seg")
        assert sorted(map(tuple, found.filter(F.col("level") == forest.level(at)).drop("level").collect())) == sorted(map(tuple, want.collect()))


def test_a_node_outside_is_an_error(spark, forest):
    for at in ((0, 0, 99), (99, 0, 0), (-1, 0, 0)):
        nodes = spark.createDataFrame([at], "x long, y long, z long")
        with pytest.raises(Exception, match="outside the volume"):
            merge_forest.labels(forest, nodes).collect()


def test_few_and_many_thresholds(spark):
    rows = [(x, y, z, 0.1 * x, math.nan, 1.0) for x in range(5) for y in range(2) for z in range(2)]
    v = spark.createDataFrame(rows, "x long, y long, z long, a0 float, a1 float, a2 float")
    packed = blocks.kept(blocks.from_voxels(v, TYPES, (5, 2, 2), 2))
    with pytest.raises(ValueError, match="more than 127"):
        merge_forest.merge_forest(packed, [i / 1000 for i in range(128)])
    f = merge_forest.merge_forest(packed, [0.25])
    got = blocks.to_voxels(merge_forest.cut(f, 0.25)).filter("y = 0").orderBy("x", "z").collect()
    # Pairs along z are one segment each; x goes on from 3 to 4 and beyond the end. Rows of the raster: 4 a slice.
    assert [(r.x, r.seg) for r in got if r.z == 0] == [(0, 1), (1, 5), (2, 9), (3, 13), (4, 13)]


def test_runs_are_labels(volume, forest):
    nodes = volume.select("x", "y", "z", F.expr("x % 3").alias("skel"), F.expr("x * 100 + y * 10 + z").alias("n"))
    runs = merge_forest.runs(forest, nodes, ["skel", "n"])
    single = runs.withColumn("level", F.explode(F.sequence("low", "top"))).select("n", "level", "seg")
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, merge_forest.labels(forest, nodes).select("n", "level", "seg").collect()))
    found = runs.collect()
    assert len(found) < single.count()
    by_node = {}
    for r in sorted(found, key=lambda r: -r.top):
        assert by_node.get(r.n) != r.seg  # a new run is a new segment
        by_node[r.n] = r.seg


def test_tasks_of_a_sweep_grow_with_the_volume(spark, volume, forest, monkeypatch):
    nodes = volume.select("x", "y", "z", F.expr("x % 3").alias("skel"), F.expr("x * 100 + y * 10 + z").alias("n"), *(F.expr(f"{a} * 9D").alias(f"p{a}") for a in "xyz"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(blocks, "PER_TASK", 50, raising=False)
    assert math.prod(forest.blocks.shape) == 1500
    found = merge_forest.runs(forest, nodes, ["skel", "n"])
    assert re.search(r"hashpartitioning\(skel[^)]*, n[^)]*, 30\)", plan(found))
    assert ", 30)" in plan(blocks.from_voxels(volume, TYPES, (15, 10, 10)).rows)


def slow_scores(volume, nodes, at):
    """NERL, VOI and mergers of one threshold from its labelling."""
    shape = segmentation.shape_of(volume)
    seg = segmentation.affinity_components(segmentation.hard(volume, at), shape, 4)
    rows = nodes.join(seg, ["x", "y", "z"]).orderBy("skel", "n").collect()
    pairs, skels, segs = Counter((r.skel, r.seg) for r in rows), Counter(r.skel for r in rows), Counter(r.seg for r in rows)
    touched = Counter(s for _, s in pairs)
    merged = {k for k, s in pairs if touched[s] > 1}
    length, right = Counter(), Counter()
    for a, b in zip(rows, rows[1:]):
        if a.skel == b.skel:
            d = math.dist((a.px, a.py, a.pz), (b.px, b.py, b.pz))
            length[a.skel] += d
            if a.seg == b.seg != 0 and not (touched[a.seg] > 1 and a.skel in merged):
                right[a.skel, a.seg] += d
    h = lambda c: sum(n * math.log2(n) for n in c.values())
    nerl = sum(d * d for d in right.values()) / sum(d * d for d in length.values())
    return nerl, (h(skels) + h(segs) - 2 * h(pairs)) / len(rows), sum(n for s, n in touched.items() if n > 1 and s)


def test_scores_are_sums_of_changes(spark, volume):
    nodes = volume.filter("x % 2 = 0 or y > 4").select("x", "y", "z", F.expr("x div 2 * 4 + y div 4").alias("skel"), F.expr("y * 10 + z").alias("n"), *(F.expr(f"{a} * 9D").alias(f"p{a}") for a in "xyz"))
    nodes = materialise(nodes.dropDuplicates(["skel", "n"]), "nodes")
    cuts = spark.createDataFrame([(i, float(t)) for i, t in enumerate(CUTS)], "ord long, thr double")
    got = {r.ord: (r.nerl, r.voi_sum, r.n_non0_mergers) for r in threshold_scores.scores_at(volume, nodes, cuts).collect()}
    for i, at in enumerate(CUTS):
        assert got[i] == pytest.approx(slow_scores(volume, nodes, at), abs=1e-9)
