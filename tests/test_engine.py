"""Hand-made cases, properties, and independent implementations."""

import itertools
import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamellar.functions import ranking, scalar
from lamellar.operators import affinity, components, grid, information, sampling, segmentation, selection, skeleton, sweep
from lamellar.sources import arrays, sinks
from lamellar.streaming import running_best

XYZ = "x long, y long, z long"


def flood(a):
    """Numbered components of boolean affinities, by a plain search; a: (3, X, Y, Z)."""
    shape = a.shape[1:]
    steps = np.eye(3, dtype=int)
    linked, member = {}, set(map(tuple, np.argwhere(a.any(axis=0))))
    for k in range(3):
        for p in map(tuple, np.argwhere(a[k])):
            q = tuple(np.add(p, steps[k]))
            if q[k] < shape[k]:
                member.add(q)
                linked.setdefault(p, []).append(q)
                linked.setdefault(q, []).append(p)
    out, n = np.zeros(shape, int), 0
    for p in sorted(member):
        if not out[p]:
            n += 1
            out[p], todo = n, [p]
            while todo:
                for q in linked.get(todo.pop(), []):
                    if not out[q]:
                        out[q] = n
                        todo.append(q)
    return out


def voxel_frame(spark, a):
    rows = [(*map(int, p), *(bool(a[(k, *p)]) for k in range(3))) for p in np.ndindex(a.shape[1:])]
    return spark.createDataFrame(rows, f"{XYZ}, a0 boolean, a1 boolean, a2 boolean")


@pytest.mark.parametrize("shape,density,block", [((5, 4, 6), 0.3, 2), ((7, 3, 5), 0.15, 3), ((1, 1, 1), 1.0, 2), ((6, 6, 6), 0.5, 64)])
def test_affinity_components(spark, shape, density, block):
    a = np.random.default_rng(7).random((3, *shape)) < density
    got = segmentation.affinity_components(voxel_frame(spark, a), shape, block).collect()
    want = flood(a)
    assert len(got) == want.size and all(r.seg == want[r.x, r.y, r.z] for r in got)


def test_label_components_across_blocks(spark):
    labels = np.random.default_rng(3).integers(-1, 3, (5, 4, 4))
    a = np.zeros((3, *labels.shape), bool)
    for k in range(3):
        for p in np.ndindex(labels.shape):
            q = tuple(np.add(p, np.eye(3, dtype=int)[k]))
            a[(k, *p)] = q[k] < labels.shape[k] and labels[p] > 0 and labels[q] == labels[p]
    linked = flood(a)
    df = spark.createDataFrame([(*map(int, p), int(labels[p])) for p in np.ndindex(labels.shape)], f"{XYZ}, seg long")
    seen, n = {}, 0
    for p in np.ndindex(labels.shape):  # lone voxels of a label are components of their own
        if labels[p] > 0:
            key = int(linked[p]) or p
            if key not in seen:
                n += 1
                seen[key] = n
    for r in segmentation.label_components(df, labels.shape, 2).collect():
        p = (r.x, r.y, r.z)
        assert r.seg == (seen[int(linked[p]) or p] if labels[p] > 0 else labels[p])


def test_graph_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(70)] + [(500, 500), (None, 3), (3, None)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for u, v in edges:
        if u is not None and v is not None:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {i: find(i) for i in root} and len(got) == len(root)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 1000])
def test_components_of_pieces_are_those_of_the_graph(spark, piece):
    rng = random.Random(piece)
    edges = [(i, i + 1) for i in range(0, 300) if i % 41] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)] + [(700, 700)] * 3
    rng.shuffle(edges)
    ends = sorted({i for e in edges for i in e})
    at = {i: k for k, i in enumerate(ends)}
    want = components.local_roots(len(ends), np.array([at[u] for u, _ in edges]), np.array([at[v] for _, v in edges]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(3), piece=piece).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.node, r.root) for r in got) == [(i, ends[r]) for i, r in zip(ends, want)]


def test_long_paths_that_lie_together_take_no_rounds(spark, monkeypatch):
    writes, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: writes.append(label) or write(df, label))
    paths = spark.range(0, 5000, 1, 1).filter("id % 1000 <> 999").selectExpr("id as u", "id + 1 as v")
    got = components.connected_components(paths).collect()
    assert len(got) == 5000 and all(r.root == r.node // 1000 * 1000 for r in got)
    assert len(writes) <= 3


def test_numbers_within_groups_of_any_size(spark):
    rows = [(g, g * 10_000 + 3 * i) for g, n in ((1, 2), (2, 1), (5, 4000), (6, 1), (8, 700)) for i in range(n)]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges stay apart
    try:
        got = ranking.numbered_within(spark.createDataFrame(rows, "g long, v long").repartition(5), "g", "v", "nth")
        assert sorted((r.g, r.v, r.nth) for r in got.collect()) == sorted((g, v, (v - g * 10_000) // 3) for g, v in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert ranking.numbered_within(spark.createDataFrame([], "g long, v long"), "g", "v", "nth").count() == 0


def test_thresholds_are_compared_as_floats(spark):
    df = spark.createDataFrame([(0.7311,), (0.8022,), (float("nan"),), (0.74,)], "p float")
    assert [r[0] for r in df.select(scalar.above(F.col("p"), F.lit(0.7311))).collect()] == [False, True, False, True]
    assert [r.thr for r in selection.threshold_grid(spark).orderBy("ord").collect()] == [
        0.4502, 0.5, 0.5498, 0.5987, 0.6457, 0.69, 0.7311, 0.7685, 0.8022, 0.832, 0.8581, 0.8808, 0.9002,
    ]


def test_unlabelled_pairs_agree_until_masked(spark):
    df = spark.createDataFrame([(x, 0, 0, s) for x, s in enumerate([-1, -1, 0, 0, 5, 5, 7])], f"{XYZ}, seg long")
    rows = affinity.affinities(df, 2, labelled_only=True).orderBy("x").collect()
    assert [r.aff0 for r in rows] == [True, False, False, False, True, False, False]
    assert [r.mask0 for r in rows] == [False, False, True, True, True, True, False]
    assert [r.aff0 for r in affinity.encoded(affinity.affinities(df, 2, labelled_only=True)).orderBy("x").collect()] == [-1, -1, 0, 0, 1, 0, -1]


NODES, EDGES = "skel long, seg long", "skel long, gu long, gv long, len double"


def plain_scores(nodes, edges, k):
    """Run length and class counts, step by step."""
    count = {}
    for n in nodes:
        count[n] = count.get(n, 0) + 1
    pairs = {p for p, n in count.items() if k is not None and n > k}
    segs = {g for _, g in pairs if sum(h == g for _, h in pairs) > 1}
    skels = {s for s, g in pairs if g in segs}
    kinds, correct, total = [], {}, 0.0
    for s, gu, gv, length in edges:
        total += length
        kind = "omitted" if 0 in (gu, gv) else "split" if gu != gv else "merged" if s in skels and gu in segs else "correct"
        kinds.append((s, kind))
        if kind == "correct":
            correct[s, gu] = correct.get((s, gu), 0.0) + length
    return (sum(c * c for c in correct.values()) / total if total else None), kinds


def test_skeleton_scores(spark):
    rng = random.Random(9)
    for _ in range(3):
        seg = {s: [rng.choice([0, s, s * 2, 50]) for _ in range(40)] for s in range(1, 7)}
        seg[1] += [50] * 101
        seg[2] += [50] * 100
        seg[3] = [7] * 6 + [8] * 5
        seg[4] = [7] * 21 + [8] * 6
        nodes = [(s, g) for s, gs in seg.items() for g in gs]
        edges = [(s, a, b, rng.randrange(5) / 2) for s, gs in seg.items() for a, b in itertools.pairwise(gs)]
        n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
        got = {r.ignored: r.erl for r in skeleton.expected_run_length(n, e).collect()}
        for k in skeleton.TOLERANCES:
            assert abs(got[-1 if k is None else k] - plain_scores(nodes, edges, k)[0]) < 1e-9
        values = [got[k] for k in (0, 5, 20, 100, -1)]
        assert values == sorted(values) and got[100] != got[-1]
        kinds = plain_scores(nodes, edges, 5)[1]
        for r in skeleton.edge_classes(n, e, 5).collect():
            assert all(r[k] == kinds.count((r.skel, k)) for k in ("omitted", "split", "merged", "correct"))


def test_merged_by_two_sets_not_by_pair(spark):
    """Skeleton 1 is merged through segment 9; its few nodes in merging segment 8 don't survive, yet count as merged."""
    nodes = [(1, 9)] * 10 + [(2, 9)] * 10 + [(2, 8)] * 10 + [(3, 8)] * 10 + [(1, 8)] * 2
    r = skeleton.edge_classes(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(1, 8, 8, 1.0)], EDGES), 5).first()
    assert (r.merged, r.correct) == (1, 0)


def test_zero_length_and_perfect(spark):
    n = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2)], NODES)
    assert skeleton.normalised_run_length(n, spark.createDataFrame([(1, 1, 1, 0.0), (2, 2, 2, 3.0)], EDGES), [0]).first().nerl == 1
    assert skeleton.normalised_run_length(n, spark.createDataFrame([(1, 1, 1, 0.0)], EDGES), [0]).first().nerl is None
    assert information.voi(n).first().voi_sum == 0 and information.rand_scores(n).first().rand_split == 1


def test_best_threshold_ties(spark):
    rows = [(0, 0.5, 0.2, 1.0, 3), (1, 0.6, 0.7, 0.8, 0), (2, 0.7, 0.7, 0.9, 0)]
    df = spark.createDataFrame(rows, "ord long, thr double, nerl double, voi_sum double, n_non0_mergers long")
    assert selection.best_threshold(df).first().thr == 0.6
    assert selection.best_threshold(df.withColumn("nerl", F.lit(0.0))).first().thr is None
    none = selection.best_without_mergers(df.filter("ord = 0")).first()
    assert (none.best_voi, none.best_voi_no_merge, none.best_nerl_no_merge) == (1.0, 1e100, -1)


def test_blend_of_a_constant(spark):
    patch = grid.patches(spark, (9, 7, 8), 4, True)
    cells = patch.selectExpr("*", "explode(sequence(0, 63)) as at").selectExpr("px", "py", "pz", "at div 16 as i", "at div 4 % 4 as j", "at % 4 as k", "0.25D as p0")
    rows = grid.blend(cells, 4, True, ("p0",)).collect()
    assert len(rows) == 9 * 7 * 8 and {round(r.p0, 12) for r in rows} == {0.25}
    with pytest.raises(ValueError):
        grid.offsets(3, 4)
    with pytest.raises(ValueError):
        grid.patches(spark, (9, 3, 8), 4, True)


@pytest.mark.parametrize("overlap", [True, False])
def test_patches_of_blocks_blend_as_all_do_and_no_voxel_is_sent(spark, overlap):
    shape = (23, 9, 11)
    patch = grid.patches(spark, shape, 4, overlap)
    base_patch = grid.patches(spark, shape, 4, False)
    assert base_patch.select(F.spark_partition_id().alias("t")).distinct().count() > 1  # no task makes them all
    plain = [grid.offsets(n, 4) for n in shape]
    starts = spark.range(1).select(*(o.alias(a) for o, a in zip(plain, "xyz"))).first()
    base = set(itertools.product(*starts))
    fits = lambda p: all(o + 4 <= n for o, n in zip(p, shape))
    moved = {tuple(o + 2 * m for o, m in zip(p, s)) for p in base for s in itertools.product((0, 1), repeat=3)} if overlap else set()
    assert sorted(map(tuple, patch.select("px", "py", "pz").collect())) == sorted(base | set(filter(fits, moved)))

    def cells(df):
        at = ("at div 16 as i", "at div 4 % 4 as j", "at % 4 as k")
        return df.selectExpr("*", "explode(sequence(0, 63)) as at").selectExpr("*", *at).withColumn("p0", F.expr("(px * 7 + py * 3 + pz + i * j + k) % 11 / 8D"))

    want = grid.blend(cells(patch), 4, overlap, ("p0",))
    got = grid.blend(cells(grid.by_block(patch, shape, 4, 8)), 4, overlap, ("p0",), shape, 8)
    rows = lambda df: sorted((r.x, r.y, r.z, round(r.p0, 9)) for r in df.collect())
    assert rows(got) == rows(want) and got.count() == 23 * 9 * 11
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "hashpartitioning(x" not in plan and "hashpartitioning(block#" in plan and plan.count("hashpartitioning(block#") == 1


def test_rotations_flips_and_draws(spark):
    a = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    df = spark.createDataFrame([(*map(int, p), int(a[p])) for p in np.ndindex(a.shape)], f"{XYZ}, v long")
    shape = dict(zip("xyz", a.shape))
    for times, (i, j) in itertools.product(range(4), [(0, 1), (1, 2), (0, 2)]):
        want = np.rot90(a, times, (i, j))
        rows = sampling.rotated(df, "xyz"[i], "xyz"[j], times, shape).collect()
        assert all(want[r.x, r.y, r.z] == r.v for r in rows)
    want = a.transpose(2, 0, 1)
    assert all(want[r.x, r.y, r.z] == r.v for r in sampling.permuted(df, ("z", "x", "y")).collect())
    assert sampling.position_range(8, 128, 5, 400)[0] == 8 + max(-26, -8)
    lo, hi = sampling.position_range(8, 32, 5, 90)
    seen = sampling.sample_positions(spark.range(3000), (90, 90, 90), 32, 8, seed=1).agg(F.min("px"), F.max("px")).first()
    assert tuple(seen) == (lo, hi)
    picks = dict(map(tuple, sampling.weighted_choice(spark.range(4000), [1, 3], 2).groupBy("source").count().collect()))
    assert 0.7 < picks[1] / 4000 < 0.8
    same = sampling.affine(df, "v", [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], a.shape).collect()
    assert all(a[r.x, r.y, r.z] == r.v for r in same) and len(same) == a.size


def test_commands(spark):
    rows = sweep.commands(spark, {"seed": [1, 2], "auto_resubmit": [True], "augment": [False]}).orderBy("combo").collect()
    assert rows[1].args == "--seed 2 --no-augment --exp_name seed2" and rows[1].is_long and rows[1].save_dir == "seed2"
    assert "LONG_JOB=TRUE" in rows[0].command
    assert sweep.commands(spark, {"augment": [True]}).first().exp_name == "experiment"
    params = {"a": [1, 2, 3], "b": ["x", "y"]}
    got = [(r.a.text, r.b.text) for r in sweep.grid(spark, params).orderBy("combo").collect()]
    assert got == [tuple(map(str, c)) for c in sweep.combinations(params)]


def test_label_outside_the_volume(spark):
    seg = spark.createDataFrame([(0, 0, 0, 4)], f"{XYZ}, seg long")
    nodes = spark.createDataFrame([(0, 0, 0, 1), (5, 0, 0, 2)], f"{XYZ}, node long")
    assert segmentation.label_lookup(nodes.filter("node = 1"), seg).first().pred == 4
    with pytest.raises(Exception, match="outside the volume"):
        segmentation.label_lookup(nodes, seg).collect()


def test_running_best_stream(spark, tmp_path):
    rows = [("r", "val", 1, 0.0), ("r", "val", 2, 0.3), ("r", "val", 3, 0.3), ("r", "test", 1, -1.0)]
    later = [("r", "val", 4, 0.2), ("r", "val", 5, 0.6)]
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    for part in (rows, later):  # the second run starts from the first one's state
        spark.createDataFrame(part, running_best.SCALARS).write.mode("append").parquet(log)
        running_best.run_once(spark.readStream.schema(running_best.SCALARS).parquet(log), out, check)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("r", "val", 2, 0.3), ("r", "val", 5, 0.6)]


def test_array_files(spark, tmp_path):
    a = np.arange(5 * 4 * 3, dtype="<u2").reshape(5, 4, 3)
    root = tmp_path / "v.zarr"
    root.mkdir()
    meta = {"shape": a.shape, "chunks": [2, 3, 3], "dtype": "<u2", "order": "C", "compressor": {"id": "zlib", "level": 1}, "zarr_format": 2, "fill_value": 0}
    (root / ".zarray").write_text(json.dumps(meta))
    for i, j in itertools.product(range(3), range(2)):
        chunk = np.zeros((2, 3, 3), "<u2")
        part = a[2 * i : 2 * i + 2, 3 * j : 3 * j + 3]
        chunk[: part.shape[0], : part.shape[1]] = part
        (root / f"{i}.{j}.0").write_bytes(zlib.compress(chunk.tobytes()))
    np.save(tmp_path / "v.npy", a)
    for df in (arrays.read_zarr(spark, str(root)), arrays.read_npy(spark, str(tmp_path / "v.npy"), "<u2")):
        rows = df.collect()
        assert len(rows) == a.size and all(a[r.x, r.y, r.z] == r.val for r in rows)
    names = spark.createDataFrame([("seed2",), ("my_seed1",), ("b.zarr",), ("a.zarr",)], "name string")
    assert [r.name for r in arrays.seeds(names).collect()] == ["my_seed1", "seed2"]
    assert arrays.first_seed(names, "starts").first().name == "seed2" and arrays.first_seed(names, "zarr").first().name == "a.zarr"


def test_sinks(spark, tmp_path):
    seg = spark.createDataFrame([(0, 0, 600, 1), (1, 0, 0, 2)], f"{XYZ}, seg long")
    path = str(tmp_path / "seg")
    sinks.write_volume(seg, path, overwrite=False)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_volume(seg, path, overwrite=False)
    sinks.write_volume(seg, path, overwrite=True)
    assert spark.read.parquet(path).filter("bz = 1").count() == 1
    sinks.write_best_threshold(spark.createDataFrame([(0.69,)], "thr double"), str(tmp_path / "best"))
    assert spark.read.text(str(tmp_path / "best")).first().value == "0.69"
    log = spark.createDataFrame([("r", "t", 1, 2.0), ("r", "t", 2, None)], "run string, tag string, step long, value double")
    sinks.append_scalars(log, str(tmp_path / "log"))
    sinks.append_scalars(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from lamellar.sources import storage

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_root(Session())


def test_kept_tables_can_be_dropped(spark):
    from lamellar.sources import storage

    kept = storage.materialise(spark.range(3), "dropped")
    storage.drop(kept)
    storage.drop(spark.range(3))
    assert not os.path.exists(kept._kept_at.removeprefix("file://"))
