"""Scores of a segmentation against skeletons: edge classes, mergers, splits and run length.

Nodes have (skel, seg), edges (skel, gu, gv, len): the skeleton is that of the first end. All
tolerances are evaluated together: counts by pair, then one flag per tolerance on each segment and
each skeleton, joined to the edges once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of mergers that are ignored; None: all are.
TOLERANCES: tuple[int | None, ...] = (0, 5, 20, 100, None)


def pair_counts(nodes: DataFrame) -> DataFrame:
    """skel, seg, n: nodes of a skeleton in a segment."""
    return nodes.groupBy("skel", "seg").agg(F.count("*").alias("n"))


def _survives(k: int | None) -> Column:
    return F.lit(False) if k is None else F.col("n") > k


def merging_segments(pairs: DataFrame, ignored: int | None = 0) -> DataFrame:
    """seg, n_skels: segments that touch two skeletons or more, in pairs of more than ``ignored`` nodes."""
    return pairs.filter(_survives(ignored)).groupBy("seg").agg(F.count("*").alias("n_skels")).filter("n_skels > 1")


def merge_stats(pairs: DataFrame, ignored: int | None = 0) -> DataFrame:
    """seg, skels: the skeletons in each merging segment, in order."""
    left = pairs.filter(_survives(ignored)).join(merging_segments(pairs, ignored).select("seg"), "seg", "left_semi")
    return left.groupBy("seg").agg(F.sort_array(F.collect_list("skel")).alias("skels"))


def n_mergers(pairs: DataFrame) -> DataFrame:
    """Pairs of a merging segment and a skeleton, with and without the background."""
    m = merging_segments(pairs)
    return m.agg(
        F.coalesce(F.sum("n_skels"), F.lit(0)).alias("n_mergers"),
        F.coalesce(F.sum(F.when(F.col("seg") != 0, F.col("n_skels"))), F.lit(0)).alias("n_non0_mergers"),
    )


def _flagged(nodes: DataFrame, edges: DataFrame, tolerances: Sequence[int | None]) -> DataFrame:
    """Edges with m0, m1, ..: whether their skeleton is merged and their segment merges, at each tolerance.

    The two conditions are independent: the skeleton may be merged through another segment.
    """
    pairs = pair_counts(nodes)
    many = range(len(tolerances))
    segs = pairs.groupBy("seg").agg(*((F.count_if(_survives(k)) > 1).alias(f"g{i}") for i, k in enumerate(tolerances)))
    segs = segs.filter(F.greatest(*(F.col(f"g{i}") for i in many), F.lit(False)))
    skels = pairs.join(segs, "seg").groupBy("skel").agg(*(F.bool_or(F.col(f"g{i}") & _survives(k)).alias(f"s{i}") for i, k in enumerate(tolerances)))
    rows = edges.select("skel", "gu", "gv", "len").join(segs.withColumnRenamed("seg", "gu"), "gu", "left").join(skels, "skel", "left")
    return rows.withColumns({f"m{i}": F.coalesce(F.col(f"g{i}") & F.col(f"s{i}"), F.lit(False)) for i in many})


def _omitted() -> Column:
    return (F.col("gu") == 0) | (F.col("gv") == 0)


def edge_classes(nodes: DataFrame, edges: DataFrame, ignored: int | None = 0) -> DataFrame:
    """skel, omitted, split, merged, correct: edges by the first class that fits. Skeletons without edges don't appear."""
    rows = _flagged(nodes, edges, [ignored])
    kind = F.when(_omitted(), "omitted").when(F.col("gu") != F.col("gv"), "split").when(F.col("m0"), "merged").otherwise("correct")
    rows = rows.withColumn("kind", kind)
    return rows.groupBy("skel").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("omitted", "split", "merged", "correct")))


def split_stats(edges: DataFrame) -> DataFrame:
    """skel, splits: both segments of every split edge, in order."""
    rows = edges.filter(~_omitted() & (F.col("gu") != F.col("gv")))
    return rows.groupBy("skel").agg(F.sort_array(F.collect_list(F.struct("gu", "gv"))).alias("splits"))


def n_splits(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_if(~_omitted() & (F.col("gu") != F.col("gv"))).alias("n_splits"))


def skeleton_lengths(edges: DataFrame) -> DataFrame:
    return edges.groupBy("skel").agg(F.sum("len").alias("length"))


def correct_lengths(nodes: DataFrame, edges: DataFrame, tolerances: Sequence[int | None] = TOLERANCES) -> DataFrame:
    """skel, seg, c0, c1, ..: correct length of a skeleton in a segment at each tolerance."""
    rows = _flagged(nodes, edges, tolerances).filter(~_omitted() & (F.col("gu") == F.col("gv")))
    sums = [F.coalesce(F.sum(F.when(~F.col(f"m{i}"), F.col("len"))), F.lit(0.0)).alias(f"c{i}") for i in range(len(tolerances))]
    return rows.groupBy("skel", F.col("gu").alias("seg")).agg(*sums)


def expected_run_length(nodes: DataFrame, edges: DataFrame, tolerances: Sequence[int | None] = TOLERANCES) -> DataFrame:
    """ignored (-1 for all), erl: the squares of correct lengths over the total length.

    That is the mean over skeletons by length of their own run lengths; a skeleton of no length adds
    nothing, and without any length the result is null.
    """
    c = correct_lengths(nodes, edges, tolerances)
    squares = c.agg(*(F.coalesce(F.sum(F.col(f"c{i}") * F.col(f"c{i}")), F.lit(0.0)).alias(f"q{i}") for i in range(len(tolerances))))
    total = edges.agg(F.sum("len").alias("total"))
    listed = F.array(*(F.struct(F.lit(-1 if k is None else k).cast("long").alias("ignored"), F.col(f"q{i}").alias("q")) for i, k in enumerate(tolerances)))
    rows = squares.join(F.broadcast(total)).select("total", F.explode(listed).alias("r"))  # one row each
    return rows.select("r.ignored", F.try_divide("r.q", "total").alias("erl"))


def max_run_length(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """erl of the truth itself: skeletons as segments."""
    truth = nodes.withColumn("seg", F.col("skel"))
    ends = edges.withColumns({"gu": F.col("skel"), "gv": F.col("skel")})  # edges stay within a skeleton
    return expected_run_length(truth, ends, [0]).select(F.col("erl").alias("max_erl"))


def normalised_run_length(nodes: DataFrame, edges: DataFrame, tolerances: Sequence[int | None] = TOLERANCES) -> DataFrame:
    """ignored, erl, max_erl, nerl."""
    rows = expected_run_length(nodes, edges, tolerances).join(F.broadcast(max_run_length(nodes, edges)))
    return rows.withColumn("nerl", F.try_divide("erl", "max_erl"))
