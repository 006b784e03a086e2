"""Scores of the segments that affinities make at each of several thresholds, in one plan.

One forest of merges gives the segments of all thresholds, and scores are sums of what changes at its levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamellar.operators import blocks, merge_forest, segmentation
from lamellar.sources.storage import materialise


TYPES = {"a0": "<f4", "a1": "<f4", "a2": "<f4"}


def forest_of(volume: DataFrame, thresholds: list[float]) -> merge_forest.Forest:
    """The forest of a table of voxels with predicted affinities a0..a2."""
    packed = blocks.kept(blocks.from_voxels(volume.select("x", "y", "z", *TYPES), TYPES, segmentation.shape_of(volume)))
    return merge_forest.merge_forest(packed, thresholds)


def _after(df: DataFrame, keys: list[str], *columns: str, tasks: int) -> DataFrame:
    """Changes by level to values: each column's sum from the highest level down, and ``was_`` it before the level."""
    down = W.partitionBy(*keys).orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.repartition(tasks, *keys, "level").groupBy(*keys, "level").agg(*(F.sum(c).alias(f"d_{c}") for c in columns)).repartition(tasks, *keys)
    rows = rows.withColumns({c: F.sum(f"d_{c}").over(down) for c in columns})
    return rows.withColumns({f"was_{c}": F.col(c) - F.col(f"d_{c}") for c in columns})


def _events(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """A run of levels as two changes: the value comes at the top, and goes below the low end."""
    both = F.array(F.struct(F.col("top").alias("level"), value.alias("n")), F.struct((F.col("low") - 1).alias("level"), (-value).alias("n")))
    return df.select(*keys, F.explode(both).alias("e")).select(*keys, "e.level", "e.n").filter("level > 0")


def _n_log_n(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))


def changes(runs: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """level, and how much pairs' and segments' n log n (``hj``, ``hp``), mergers and squares of correct lengths change there; and one row of what never does.

    ``runs``: skel, n, px, py, pz, seg, top and low, as ``merge_forest.runs`` gives them. A pair of skeleton and segment is
    looked at only where nodes join or leave it, so work grows with nodes and merges, not with levels. A
    merging segment's lengths are none of them correct, so a segment's squares count while it has one skeleton. Rows are
    dealt to ``tasks`` tasks, which should grow with nodes.
    """
    node = runs.select("skel", "n", "px", "py", "pz", "seg", "top", "low")
    cells = _after(_events(node, ["seg", "skel"], F.lit(1)), ["seg", "skel"], "n", tasks=tasks)
    kept = materialise(cells.filter("d_n <> 0"), "sweep-cells")
    pairs = kept.select("level", (_n_log_n(F.col("n")) - _n_log_n(F.col("was_n"))).alias("hj"))

    runs_of = node.repartition(tasks, "skel").groupBy("skel", "n", "px", "py", "pz").agg(F.collect_list(F.struct("seg", "top", "low")).alias("runs"))  # as many as levels at most
    along = W.partitionBy("skel").orderBy("n")
    at = lambda c: F.lead(c).over(along)
    length = F.sqrt(sum((F.pow(F.col(c) - at(c), 2) for c in ("px", "py", "pz")), F.lit(0.0)))
    edges = materialise(runs_of.select("skel", "runs", at("runs").alias("next"), length.alias("len")).filter("next is not null"), "sweep-edges")
    meet = lambda a, b: F.struct(a.seg.alias("seg"), F.least(a.top, b.top).alias("top"), F.greatest(a.low, b.low).alias("low"))
    same = F.flatten(F.transform("runs", lambda a: F.transform(F.filter("next", lambda b: (a.seg == b.seg) & (a.seg > 0)), lambda b: meet(a, b))))
    together = edges.select("skel", "len", F.explode(same).alias("e")).select("skel", "len", "e.*").filter("low <= top")
    lengths = _after(_events(together, ["seg", "skel"], F.col("len")), ["seg", "skel"], "n", tasks=tasks)
    squares = lengths.select("seg", "level", (F.col("n") * F.col("n") - F.col("was_n") * F.col("was_n")).alias("squares"))

    skels = kept.select("seg", "level", F.lit(0.0).alias("squares"), ((F.col("n") > 0).cast("long") - (F.col("was_n") > 0).cast("long")).alias("skels"), F.col("d_n").alias("n"))
    both = skels.unionByName(squares.withColumns({"skels": F.lit(0).cast("long"), "n": F.lit(0).cast("long")}))
    segs = _after(both, ["seg"], "squares", "skels", "n", tasks=tasks)
    merging = lambda k: F.when((k > 1) & (F.col("seg") != 0), k).otherwise(F.lit(0))
    right = lambda k, s: F.when(k == 1, s).otherwise(F.lit(0.0))
    of_segs = segs.select(
        "level",
        (_n_log_n(F.col("n")) - _n_log_n(F.col("was_n"))).alias("hp"),
        (merging(F.col("skels")) - merging(F.col("was_skels"))).alias("mergers"),
        (right(F.col("skels"), F.col("squares")) - right(F.col("was_skels"), F.col("was_squares"))).alias("right"),
    )
    sums = of_segs.groupBy("level").agg(F.sum("hp").alias("hp"), F.sum("mergers").alias("mergers"), F.sum("right").alias("right"))
    by_level = sums.join(pairs.groupBy("level").agg(F.sum("hj").alias("hj")), "level", "full")

    sizes = runs_of.groupBy("skel").agg(F.count("*").alias("n"))
    whole = edges.groupBy("skel").agg(F.sum("len").alias("len")).agg(F.sum(F.col("len") * F.col("len")).alias("all"))
    return by_level, sizes.agg(F.sum("n").alias("n"), F.sum(_n_log_n(F.col("n"))).alias("ht")).join(F.broadcast(whole))


def scores_at(volume: DataFrame, nodes: DataFrame, thresholds: DataFrame) -> DataFrame:
    """ord, thr, nerl, voi_sum and n_non0_mergers at every threshold (ord, thr), few enough to list.

    ``nodes``: skel, n (their order along a skeleton), x, y, z and places px, py, pz. Consecutive nodes
    are an edge; a node outside the volume is an error. A segment that touches several skeletons merges them; the
    background counts as one segment there, as it does for a single threshold, but is no segment of an edge.
    """
    listed = thresholds.select("ord", "thr").collect()  # the options of a sweep
    forest = forest_of(volume, [r.thr for r in listed])
    runs = materialise(merge_forest.runs(forest, nodes.select("skel", "n", "x", "y", "z", "px", "py", "pz"), ["skel", "n"]), "sweep-runs")
    by_level, fixed = changes(runs, blocks.tasks_of(forest.blocks))
    levels = [F.struct(F.lit(r.ord).cast("long").alias("ord"), F.lit(float(r.thr)).alias("thr"), F.lit(forest.level(r.thr)).alias("at")) for r in listed]
    # A threshold has the changes of its level and of all above it.
    to = F.explode(F.filter(F.array(*levels), lambda t: t["at"] <= F.col("level"))).alias("t")
    sums = by_level.select(to, "hj", "hp", "mergers", "right").groupBy("t.ord").agg(*(F.sum(c).alias(c) for c in ("hj", "hp", "mergers", "right")))
    rows = thresholds.select("ord", "thr").join(F.broadcast(sums), "ord", "left").join(F.broadcast(fixed))  # a row for each threshold, and one
    nerl = F.try_divide(F.coalesce("right", F.lit(0.0)), F.col("all"))
    voi = F.try_divide(F.col("ht") + F.coalesce("hp", F.lit(0.0)) - 2 * F.coalesce("hj", F.lit(0.0)), F.col("n"))
    return rows.select("ord", "thr", nerl.alias("nerl"), voi.alias("voi_sum"), F.coalesce("mergers", F.lit(0)).alias("n_non0_mergers"))
