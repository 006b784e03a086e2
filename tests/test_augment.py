"""Random augmentation, replayed with arrays from the draws, and the shares of its gates."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamellar.operators import augment, quality

N = 5


def patches(spark, many, n=N):
    rng = np.random.default_rng(3)
    raw, seg = rng.normal(size=(many, n, n, n)), rng.integers(0, 9, size=(many, n, n, n))
    rows = [(s, x, y, z, float(raw[s, x, y, z]), int(seg[s, x, y, z])) for s in range(many) for x, y, z in itertools.product(range(n), repeat=3)]
    return spark.createDataFrame(rows, "sample long, x long, y long, z long, raw double, seg long"), raw, seg


def volumes(df, many, n=N):
    raw, seg = np.full((many, n, n, n), np.nan), np.full((many, n, n, n), -9)
    rows = df.collect()
    assert len(rows) == many * n**3
    for r in rows:
        raw[r.sample, r.x, r.y, r.z], seg[r.sample, r.x, r.y, r.z] = r.raw, r.seg
    return raw, seg


def test_orientation_is_that_of_arrays(spark):
    df, raw, seg = patches(spark, 24)
    drawn = {r.sample: r for r in augment.draws(df, augment.Settings(), 7).collect()}
    got_raw, got_seg = volumes(augment.augmented(df, N, augment.Settings(), 7), 24)
    for s, d in drawn.items():
        for mine, got in ((raw[s], got_raw[s]), (seg[s], got_seg[s])):
            want = mine.transpose(augment.ORDERS[d.order])
            for k, (a, b) in enumerate([(-1, -2), (-1, -3), (-2, -3)]):
                want = np.rot90(want, d[f"turn{k}"], (a, b))
            for k, a in enumerate("xyz"):
                want = np.flip(want, k) if d[f"flip_{a}"] else want
            assert (want == got).all()
    assert {d.order for d in drawn.values()} == set(range(6))


def test_dropped_and_shifted_slices(spark):
    df, _, _ = patches(spark, 24)
    plain, _ = volumes(augment.augmented(df, N, augment.Settings(), 7), 24)
    drop = augment.Settings(drop_slice=0.4)
    drawn = {r.sample: r for r in augment.draws(df, drop, 7).collect()}
    got, _ = volumes(augment.augmented(df, N, drop, 7), 24)
    gone = 0
    for s, d in drawn.items():
        for k in range(N):
            mine, now = plain[s].take(k, d.drop_axis), got[s].take(k, d.drop_axis)
            assert (now == mine).all() or (d.drops and (now == 0).all())
            gone += (now == 0).all()
    assert 0 < gone < 24 * N and 4 < sum(d.drops for d in drawn.values()) < 20
    shift = augment.Settings(shift_slice=0.7, shift_magnitude=2)
    drawn = {r.sample: r for r in augment.draws(df, shift, 7).collect()}
    got, _ = volumes(augment.augmented(df, N, shift, 7), 24)
    moved = 0
    for s, d in drawn.items():
        axis = "xyz"[d.shift_axis]
        for k in range(N):
            mine, now = plain[s].take(k, d.shift_axis), got[s].take(k, d.shift_axis)
            left = [a for a in "xyz" if a != axis]
            rolls = [range(-2, 3) if a in augment.SHIFTED[axis] else [0] for a in left]
            same = [r for r in itertools.product(*rolls) if (np.roll(mine, r, (0, 1)) == now).all()]
            assert same and (d.shifts or (mine == now).all())
            moved += not (mine == now).all()
    assert moved


def test_intensity_noise_and_warp(spark):
    many = 30
    df, _, _ = patches(spark, many)
    plain, labels = volumes(augment.augmented(df, N, augment.Settings(), 7), many)
    change = augment.Settings(multiply=0.3, add=0.2)
    drawn = {r.sample: r for r in augment.draws(df, change, 7).collect()}
    got, _ = volumes(augment.augmented(df, N, change, 7), many)
    for s, d in drawn.items():
        assert np.allclose(got[s], plain[s] * d.factor + d.addend if d.changes else plain[s])
        assert abs(d.factor - 1) <= 0.3 and abs(d.addend) <= 0.2
    noisy = augment.Settings(noise=0.5)
    drawn = {r.sample: r for r in augment.draws(df, noisy, 7).collect()}
    got, _ = volumes(augment.augmented(df, N, noisy, 7), many)
    parts = [(got[s] - plain[s]) / d.noise_scale for s, d in drawn.items() if d.noisy]
    assert all((got[s] == plain[s]).all() for s, d in drawn.items() if not d.noisy)
    assert abs(np.mean(parts)) < 0.1 and 0.9 < np.std(parts) < 1.1 and 4 < len(parts) < many - 4
    warp = augment.Settings(affine=0.5, affine_scale=0.1, affine_shear=0.1)
    drawn = {r.sample: r for r in augment.draws(df, warp, 7).collect()}
    got, seg = volumes(augment.augmented(df, N, warp, 7), many)
    mirror = lambda i: min(i % (2 * N - 2), 2 * N - 2 - i % (2 * N - 2))
    for s, d in drawn.items():
        if not d.warps:
            assert (got[s] == plain[s]).all() and (seg[s] == labels[s]).all()
            continue
        if s > 8:  # a few are enough
            continue
        c, n = ([f(d[f"angle_{a}"]) for a in "xyz"] for f in (math.cos, math.sin))
        m = np.array([[1, 0, 0], [0, c[0], -n[0]], [0, n[0], c[0]]]) @ np.array([[c[1], 0, n[1]], [0, 1, 0], [-n[1], 0, c[1]]]) @ np.array([[c[2], -n[2], 0], [n[2], c[2], 0], [0, 0, 1]])
        h = [d[f"shear{k}"] for k in range(6)]
        m = m @ np.array([[1, h[0], h[1]], [h[2], 1, h[3]], [h[4], h[5], 1]]) @ np.diag([d[f"scale_{a}"] for a in "xyz"])
        for o in itertools.product(range(N), repeat=3):
            at = m @ (np.array(o) - 2) + 2
            low, part = np.floor(at).astype(int), at - np.floor(at)
            want = sum(np.prod([p if b else 1 - p for p, b in zip(part, bits)]) * plain[s][tuple(mirror(i + b) for i, b in zip(low, bits))] for bits in itertools.product((0, 1), repeat=3))
            assert abs(got[s][o] - want) < 1e-9
            assert seg[s][o] == labels[s][tuple(mirror(int(math.floor(v + 0.5))) for v in at)]


def test_draws_repeat_and_empty_tables(spark):
    df, _, _ = patches(spark, 4)
    every = augment.Settings(0.3, 0.3, 2, 0.1, 0.1, 0.1, 0.5, 0.1, 0.1)
    a, b = (sorted(map(tuple, augment.augmented(d, N, every, 1).collect())) for d in (df, df.repartition(5)))
    assert np.allclose(np.array(a), np.array(b))
    assert augment.augmented(df.limit(0), N, every, 1).count() == 0


def test_quality_checks(spark):
    good = spark.createDataFrame([(0.5,), (0.2,)], "mask double")
    assert quality.require(good, [quality.mean_above("mask", 0.1), quality.not_empty()]) is good
    with pytest.raises(ValueError, match="mean of mask"):
        quality.require(good, [quality.mean_above("mask", 0.9)])
    with pytest.raises(ValueError, match="no rows"):
        quality.require(good.limit(0), [quality.not_empty(), quality.within("mask", 0, 1)])
    with pytest.raises(ValueError, match="mask lies outside"):
        quality.require(good.withColumn("mask", F.col("mask") * 9), [quality.within("mask", 0, 1)])
    assert quality.one_of("mode", "val", ("val", "test")) == "val"
    with pytest.raises(ValueError, match="mode"):
        quality.one_of("mode", "all", ("val", "test"))
