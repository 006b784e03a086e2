"""Queries take every row of their tables."""

import math
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from lamellar.plans import score_queries
from lamellar.sources.fixtures import voxels

SF = "/root/testdata/sf0.001"


def test_every_event_is_named_and_every_voxel_looked_up(spark):
    events = {r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect()}
    assert {r.event_id for r in entry.queries()["experiment_name"](spark, SF).collect()} == events
    want = {r.x * 100 + r.y * 10 + r.z: r.seg for r in entry.queries()["components_affinity"](spark, SF).collect()}
    got = {r.node: r.pred for r in entry.queries()["node_label_lookup"](spark, SF).collect()}
    assert got == want and len(got) == voxels(spark, SF).count()


def test_whole_volume_is_blurred_turned_shifted_and_moved(spark):
    v = {(r.x, r.y, r.z): r for r in voxels(spark, SF).collect()}
    nx, ny, nz = (max(k[a] for k in v) + 1 for a in range(3))
    assert nx > 10 and len(v) == nx * ny * nz
    run = lambda name, c: {(r.x, r.y, r.z): r[c] for r in entry.queries()[name](spark, SF).collect()}
    # From axes (z, x, y): x' = nx - 1 - x, y' = nz - 1 - z, z' = y.
    assert run("aug_flip_rot", "seg") == {(nx - 1 - x, nz - 1 - z, y): r.seg for (x, y, z), r in v.items()}
    moved = {(x, y if x % 2 else (y + 3 - x) % ny, z if x % 2 else (z + x - 7) % nz): r.raw for (x, y, z), r in v.items()}
    assert run("aug_shift", "raw") == moved
    raw = np.zeros((nx, ny, nz))
    for k, r in v.items():
        raw[k] = r.raw
    kernel = np.array([math.exp(-d * d / 8) for d in range(-8, 9)])
    blurred = raw
    for axis in range(3):
        blurred = np.apply_along_axis(lambda line: np.convolve(np.pad(line, 8, "symmetric"), kernel / kernel.sum(), "valid"), axis, blurred)
    got = run("gaussian_blur", "val")
    assert got.keys() == v.keys() and all(abs(got[k] - blurred[k]) < 2e-6 for k in v)
    mirror = lambda i, n: min(i % (2 * n - 2), 2 * n - 2 - i % (2 * n - 2))
    got = run("aug_affine", "raw")
    assert got.keys() == v.keys()
    for x, y, z in v:
        at = lambda i, k: raw[mirror(x + i, nx), y, mirror(z + 1 + k, nz)]  # noqa: B023, E731
        assert abs(got[x, y, z] - sum(0.5 * (0.25 if k else 0.75) * at(i, k) for i in (0, 1) for k in (0, 1))) < 2e-6


def test_sweep_scores_the_components_of_each_threshold(spark, monkeypatch):
    thresholds = [(0, 0.6457), (1, 0.9002)]
    grid = spark.createDataFrame(thresholds, "ord long, thr double")
    monkeypatch.setattr(score_queries.selection, "threshold_grid", lambda _: grid)
    v = {(r.x, r.y, r.z): r for r in voxels(spark, SF).collect()}
    got = {r.ord: r for r in entry.queries()["threshold_sweep"](spark, SF).collect()}
    assert len(got) == len(thresholds)
    for ord_, thr in thresholds:
        links = {}
        for (x, y, z), r in v.items():
            for a, to in (("a0", (x + 1, y, z)), ("a1", (x, y + 1, z)), ("a2", (x, y, z + 1))):
                if np.float32(r[a]) > np.float32(thr):
                    links.setdefault((x, y, z), set())
                    if to in v:
                        links[x, y, z].add(to)
                        links.setdefault(to, set()).add((x, y, z))
        label = {}
        for start in sorted(links):
            todo = [start] if start not in label else []
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = start
                    todo += links[k]
        nodes = sorted((r.seg, k, label.get(k, 0)) for k, r in v.items() if r.seg > 0)
        pairs = Counter((t, p) for t, _, p in nodes)
        skels = Counter(p for _, p in pairs)
        assert got[ord_].n_non0_mergers == sum(n for p, n in skels.items() if p != 0 and n > 1)
        t, p = Counter(), Counter()
        for (a, b), n in pairs.items():
            t[a] += n
            p[b] += n
        h = lambda c: sum(n * math.log2(n) for n in c.values())
        assert abs(got[ord_].voi_sum - (h(t) + h(p) - 2 * h(pairs)) / len(nodes)) < 2e-6
        merged = {s for s, q in pairs if skels[q] > 1}
        right, whole = Counter(), Counter()
        for (s, i, a), (s2, j, b) in zip(nodes, nodes[1:]):
            if s == s2:
                length = math.dist(*((9 * x, 9 * y, 20 * z) for x, y, z in (i, j)))
                whole[s] += length
                if a == b != 0 and not (skels[a] > 1 and s in merged):
                    right[s, a] += length
        assert abs(got[ord_].nerl - sum(c * c for c in right.values()) / sum(c * c for c in whole.values())) < 2e-6
