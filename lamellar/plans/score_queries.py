"""Queries on skeletons, thresholds, logs and sweeps, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.functions import scalar
from lamellar.operators import information, segmentation, selection, skeleton, stats, sweep, threshold_scores
from lamellar.plans.grid_queries import COMPONENTS_SQL, RASTER_SQL, STEP_SQL
from lamellar.sources.fixtures import NODES_SQL, VOXELS_SQL, skeleton_edges, skeleton_graph, skeleton_nodes, voxels
from lamellar.sources.storage import materialise, read_table


def _both(spark, d):
    nodes = skeleton_nodes(spark, d)
    return nodes, skeleton_edges(nodes)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def skeleton_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skeleton.skeleton_lengths(_both(spark, d)[1]), 4)


def edge_classes(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.edge_classes(*_both(spark, d))


def edge_classes_tolerant(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.edge_classes(*_both(spark, d), ignored=5)


def split_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = skeleton.split_stats(_both(spark, d)[1])
    return rows.select("skel", F.array_join(F.transform("splits", lambda s: F.concat_ws("-", s.gu, s.gv)), ",").alias("splits"))


def n_splits(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.n_splits(_both(spark, d)[1])


def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.pair_counts(skeleton_nodes(spark, d))


def merging_segments(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.merging_segments(skeleton.pair_counts(skeleton_nodes(spark, d)))


def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = skeleton.merge_stats(skeleton.pair_counts(skeleton_nodes(spark, d)), 5)
    return rows.select("seg", F.array_join("skels", ",").alias("skels"))


def n_mergers(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.n_mergers(skeleton.pair_counts(skeleton_nodes(spark, d)))


def correct_length(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skeleton.correct_lengths(*_both(spark, d), [0]).filter("c0 > 0").withColumnRenamed("c0", "length"), 4)


def erl(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skeleton.expected_run_length(*_both(spark, d), [0]), 4)


def max_erl(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skeleton.max_run_length(*_both(spark, d)), 3)


def nerl(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skeleton.normalised_run_length(*_both(spark, d), [0]).select("nerl"))


def nerl_tolerant(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(skeleton.normalised_run_length(*_both(spark, d)).select("ignored", "nerl"))


def voi(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(information.voi(skeleton_nodes(spark, d)))


def rand_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(information.rand_scores(skeleton_nodes(spark, d)))


def skeleton_components(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.graph_roots(*skeleton_graph(skeleton_nodes(spark, d)))


def component_relabel(spark: SparkSession, d: str) -> DataFrame:
    return segmentation.graph_components(*skeleton_graph(skeleton_nodes(spark, d))).select("node", "local")


def component_lookup(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = skeleton_graph(skeleton_nodes(spark, d))
    return segmentation.component_of_skeleton(nodes, segmentation.graph_roots(nodes, edges))


def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    return selection.threshold_grid(spark)


def _sweep(spark, d):
    """nerl, voi_sum and n_non0_mergers of the segments of predicted affinities at every threshold.

    Labelled voxels are the skeletons' nodes, in raster order along each.
    """
    v = materialise(voxels(spark, d), "sweep-voxels")
    _, ny, nz = segmentation.shape_of(v)
    places = [(n * F.col(a)).cast("double").alias(f"p{a}") for a, n in zip("xyz", (9, 9, 20), strict=True)]
    order = (F.col("x") * ny + F.col("y")) * nz + F.col("z")
    nodes = v.filter("seg > 0").select("x", "y", "z", F.col("seg").alias("skel"), order.alias("n"), *places)
    return threshold_scores.scores_at(v, nodes, selection.threshold_grid(spark))


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_sweep(spark, d))


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(selection.best_threshold(_sweep(spark, d)))


def best_no_merge(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(selection.best_without_mergers(_sweep(spark, d)))


def _log(spark, d):
    rows = read_table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return rows.select((F.col("user_id") % 20).cast("string").alias("run"), F.col("event_type").alias("mode"), F.col("event_id").alias("step"), "value")


def running_best(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(selection.running_best(_log(spark, d)))


def topk_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = _log(spark, d).select("step", F.col("value").alias("val_loss")).filter("val_loss is not null")
    return selection.top_checkpoints(rows)


def validation_batches(spark: SparkSession, d: str) -> DataFrame:
    """A hundred batches of eight, the feature's own limit."""
    return selection.first_batches(read_table(spark, d, "events").select("event_id", "user_id"), "event_id", 8)


def scalar_log(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the log, by tag."""
    rows = _log(spark, d).select("run", F.col("mode").alias("tag"), "step", "value").filter("value is not null")
    return rows


def tensor_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.tensor_stats(read_table(spark, d, "events"), ["event_type"], "value"))


def grad_norm(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(stats.gradient_norm(read_table(spark, d, "embeddings"), "embedding"), 4)


#: A sweep of twelve combinations.
PARAMS = {
    "exp_name": ["run"],
    "save_path": ["/data/out"],
    "learning_rate": ["1e-3", 0.01],
    "n_steps": [1_000_000],
    "scheduler": [True, False],
    "auto_resubmit": [False],
    "seed": [0, 1, 2],
    "distributed": [False],
}


def config_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = sweep.grid(spark, PARAMS)
    return rows.select("combo", *(F.col(f"{k}.text").alias(k) for k in PARAMS))


def cli_args(spark: SparkSession, d: str) -> DataFrame:
    return sweep.commands(spark, PARAMS)


def exp_name_regex(spark: SparkSession, d: str) -> DataFrame:
    return sweep.commands(spark, PARAMS).select("combo", scalar.experiment_in(F.col("args")).alias("exp_name"))


def experiment_name(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events")
    text = {key: F.lit(f"v{i}") for i, (_, key) in enumerate(sweep.NAME_PARTS)} | {"seed": (F.col("user_id") % 7).cast("string")}
    return rows.select("event_id", sweep.experiment_name(F.col("ts"), text.__getitem__).alias("name"))


def format_value(spark: SparkSession, d: str) -> DataFrame:
    rows = [("a", "bool", "True", None), ("b", "bool", "False", None), ("c", "list", None, ["1", "x", "2.5"]), ("d", "none", None, None), ("e", "number", "0.001", None), ("f", "list", None, [])]
    df = spark.createDataFrame(rows, "key string, kind string, text string, parts array<string>")
    return df.select("key", scalar.format_value(F.col("kind"), F.col("text"), F.col("parts")).alias("value"))


_SIZES = [("a", 300, 200, 150, 10, 128, 1.0), ("a", 200, 200, 200, 0, 128, 3.0), ("b", 500, 400, 256, 0, 64, 0.5), ("b", 256, 256, 256, 26, 64, 2.0)]


def _lengths(spark):
    df = spark.createDataFrame(_SIZES, "dataset string, sx long, sy long, sz long, off long, size long, mult double")
    return selection.dataset_length(df)


def dataset_length(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark)


def weighted_concat_len(spark: SparkSession, d: str) -> DataFrame:
    """A weighted choice is as long as its shortest member; a concatenation is the sum."""
    return _lengths(spark).agg(F.min("length").alias("weighted"), F.sum("length").alias("concatenated"))


def segmentation_scores(spark: SparkSession, d: str) -> DataFrame:
    """From predicted affinities to scores: components, labels under nodes, their agreement with the truth."""
    v = voxels(spark, d)
    seg = segmentation.affinity_components(segmentation.hard(v, 0.8022))
    nodes = segmentation.label_lookup(v.select("x", "y", "z", F.col("seg").alias("truth")).filter("truth > 0"), seg)
    return _rounded(information.voi(nodes, "truth", "pred"))


NAMES = (
    "nerl nerl_tolerant erl max_erl correct_length skeleton_lengths edge_classes edge_classes_tolerant split_stats n_splits pair_counts merging_segments merge_stats "
    "n_mergers voi rand_scores skeleton_components component_relabel component_lookup threshold_grid threshold_sweep best_threshold best_no_merge running_best "
    "topk_checkpoints validation_batches scalar_log tensor_stats grad_norm config_grid cli_args exp_name_regex experiment_name format_value dataset_length weighted_concat_len segmentation_scores"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

# DuckDB.
_N = f"with {NODES_SQL}"
_INF = 10**12


def _scored(ks: list[int], truth: bool = False) -> str:
    """Classes of edges at each tolerance in ``ks``; ``truth``: skeletons as segments."""
    if truth:
        source = "nn as (select skel, skel as seg from nodes), ee as (select skel, skel as gu, skel as gv, len from edges)"
    else:
        source = "nn as (select skel, seg from nodes), ee as (select skel, gu, gv, len from edges)"
    return (
        f"{source}, tol as (select unnest({ks})::bigint as k), pc as (select skel, seg, count(*) as n from nn group by all), "
        "surv as (select k, skel, seg from pc, tol where n > k), ms as (select k, seg from surv group by all having count(*) > 1), "
        "mk as (select distinct k, skel from surv join ms using (k, seg)), "
        "cls as (select tol.k, ee.*, case when gu = 0 or gv = 0 then 'omitted' when gu <> gv then 'split' "
        "when exists (select 1 from ms where ms.k = tol.k and ms.seg = gu) and exists (select 1 from mk where mk.k = tol.k and mk.skel = ee.skel) then 'merged' "
        "else 'correct' end as kind from ee, tol)"
    )


def _erl(ks: list[int], truth: bool = False) -> str:
    return (
        f"{_scored(ks, truth)}, c as (select k, skel, gu, sum(case when kind = 'correct' then len else 0 end) as c from cls group by all), "
        "e as (select k, sum(c * c) / (select sum(len) from ee) as erl from c group by k)"
    )


def _nerl(ks: list[int]) -> str:
    total = f"(with {_erl([0], True)} select erl from e)"
    return f"{_N}, {_erl(ks)} select case when k = {_INF} then -1 else k end as ignored, round(erl / {total}, 6) as nerl from e"


#: Components at every threshold: labels take the least label of a neighbour until none changes.
_SWEEP = (
    f"with recursive {VOXELS_SQL}, {RASTER_SQL}, g as (select i + 1 as ord, round(1 / (1 + exp(-0.2::double * i)), 4) as thr from (select unnest(range(-1, 12)) as i)), "
    "hv as (select ord, vid, x, y, z, a0 > cast(thr as float) as a0, a1 > cast(thr as float) as a1, a2 > cast(thr as float) as a2 from vx, g), "
    + f"e as ({' union all '.join(f'select ord, vid as u, vid + {STEP_SQL[a]} as v from hv where a{k} and {a} + 1 < (select max({a}) + 1 from vox)' for k, a in enumerate('xyz'))}), "
    "ways as (select ord, u, v from e union all select ord, v, u from e), "
    "cc(ord, v, label) using key (ord, v) as (select distinct ord, v, v from (select ord, vid as v from hv where a0 or a1 or a2 union all select ord, v from e) "
    "union select w.ord, w.v, min(c.label) from cc c join ways w on w.ord = c.ord and w.u = c.v join recurring.cc r on r.ord = w.ord and r.v = w.v "
    "where c.label < r.label group by w.ord, w.v), "
    "nd as (select g.ord, g.thr, vx.seg as skel, vid as n, 9.0::double * x as px, 9.0::double * y as py, 20.0::double * z as pz, coalesce(cc.label + 1, 0) as seg "
    "from vx cross join g left join cc on cc.ord = g.ord and cc.v = vid where vx.seg > 0), "
    "pr as (select ord, skel, seg, count(*) as n from nd group by all), mg as (select ord, seg, count(*) as k from pr group by all having count(*) > 1), "
    "mk as (select distinct ord, skel from pr join mg using (ord, seg)), "
    "ed0 as (select ord, skel, seg, lead(seg) over w as nxt, sqrt(power(px - lead(px) over w, 2) + power(py - lead(py) over w, 2) + power(pz - lead(pz) over w, 2)) as len "
    "from nd window w as (partition by ord, skel order by n)), ed as (select * from ed0 where nxt is not null), "
    "wh as (select ord, sum(l * l) as wh from (select ord, skel, sum(len) as l from ed group by all) group by ord), "
    "rt as (select ord, sum(l * l) as rt from (select ord, skel, seg, sum(len) as l from ed where seg = nxt and seg <> 0 and not "
    "((ord, seg) in (select ord, seg from mg) and (ord, skel) in (select ord, skel from mk)) group by all) group by ord), "
    "hj as (select ord, sum(n * log2(n)) as hj, sum(n) as nn from pr group by ord), "
    "ht as (select ord, sum(n * log2(n)) as ht from (select ord, skel, sum(n) as n from pr group by all) group by ord), "
    "hp as (select ord, sum(n * log2(n)) as hp from (select ord, seg, sum(n) as n from pr group by all) group by ord), "
    "sw as (select ord, thr, coalesce(rt, 0) / wh as nerl, (ht + hp - 2 * hj) / nn as voi_sum, "
    "coalesce((select sum(k) from mg where mg.ord = g.ord and seg <> 0), 0)::bigint as n_non0_mergers "
    "from g left join wh using (ord) left join rt using (ord) left join hj using (ord) left join ht using (ord) left join hp using (ord))"
)
_LOG = "lg as (select cast(user_id % 20 as varchar) as run, event_type as mode, event_id as step, value from events)"
_GRAPH = f"with recursive {NODES_SQL}, comp as (select skel, node, min(node) over (partition by skel) as root from nodes)"


def _config() -> str:
    parts = [f"(select i as k{n}, v as {key} from (values {', '.join(f'({i}, {str(v)!r})' for i, v in enumerate(values))}) t(i, v))" for n, (key, values) in enumerate(PARAMS.items())]
    sizes = [len(v) for v in PARAMS.values()]
    strides = []
    for i in range(len(sizes)):
        s = 1
        for m in sizes[i + 1 :]:
            s *= m
        strides.append(s)
    combo = " + ".join(f"k{n} * {s}" for n, s in enumerate(strides))
    return f"grid as (select ({combo})::bigint as combo, {', '.join(PARAMS)} from {', '.join(parts)})"


_NAME = "'run-learning_rate' || learning_rate || '-seed' || seed"
_ARGS = (
    "'--save_path ' || save_path || ' --learning_rate ' || learning_rate || ' --n_steps ' || n_steps || "
    "case when scheduler = 'True' then ' --scheduler' else ' --no-scheduler' end || ' --seed ' || seed || ' --no-distributed --exp_name ' || exp"
)
_VOI = (
    "cc as (select t, p, count(*) as n from lab where t <> 0 group by all), tt as (select t, sum(n) as m from cc group by t), pp as (select p, sum(n) as m from cc group by p), "
    "h as (select (select sum(n * log2(n)) from cc) as hj, (select sum(m * log2(m)) from tt) as ht, (select sum(m * log2(m)) from pp) as hp, (select sum(n) from cc) as nn) "
    "select round((ht - hj) / nn, 6) as voi_split, round((hp - hj) / nn, 6) as voi_merge, round((ht - hj) / nn + (hp - hj) / nn, 6) as voi_sum from h"
)


def _classes(k: int) -> str:
    kinds = ", ".join(f"count(*) filter (kind = '{c}') as {c}" for c in ("omitted", "split", "merged", "correct"))
    return f"{_N}, {_scored([k])} select skel, {kinds} from cls group by skel"


SQL = {
    "nerl": f"select nerl from ({_nerl([0])})",
    "nerl_tolerant": _nerl([0, 5, 20, 100, _INF]),
    "erl": f"{_N}, {_erl([0])} select k as ignored, round(erl, 4) as erl from e",
    "max_erl": f"{_N}, {_erl([0], True)} select round(erl, 3) as max_erl from e",
    "correct_length": f"{_N}, {_erl([0])} select skel, gu as seg, round(c, 4) as length from c where c > 0",
    "skeleton_lengths": f"{_N} select skel, round(sum(len), 4) as length from edges group by skel",
    "edge_classes": _classes(0),
    "edge_classes_tolerant": _classes(5),
    "split_stats": f"{_N} select skel, string_agg(gu || '-' || gv, ',' order by gu, gv) as splits from edges where gu <> 0 and gv <> 0 and gu <> gv group by skel",
    "n_splits": f"{_N} select count(*) as n_splits from edges where gu <> 0 and gv <> 0 and gu <> gv",
    "pair_counts": f"{_N} select skel, seg, count(*) as n from nodes group by all",
    "merging_segments": f"{_N}, pc as (select distinct skel, seg from nodes) select seg, count(*) as n_skels from pc group by seg having count(*) > 1",
    "merge_stats": f"{_N}, pc as (select skel, seg from nodes group by all having count(*) > 5) "
    "select seg, string_agg(skel::varchar, ',' order by skel) as skels from pc group by seg having count(*) > 1",
    "n_mergers": f"{_N}, pc as (select distinct skel, seg from nodes), m as (select seg, count(*) as n from pc group by seg having n > 1) "
    "select sum(n)::bigint as n_mergers, coalesce(sum(n) filter (seg <> 0), 0)::bigint as n_non0_mergers from m",
    "voi": f"{_N}, lab as (select skel as t, seg as p from nodes), {_VOI}",
    "rand_scores": f"{_N}, cc as (select skel as t, seg as p, count(*)::double as n from nodes where skel <> 0 group by all), "
    "j as (select sum(n * n) as j from cc), a as (select sum(m * m) as a from (select sum(n) as m from cc group by t)), b as (select sum(m * m) as b from (select sum(n) as m from cc group by p)) "
    "select round(j / a, 6) as rand_split, round(j / b, 6) as rand_merge from j, a, b",
    "skeleton_components": f"{_GRAPH} select node, root from comp",
    "component_relabel": f"{_GRAPH} select node, row_number() over (partition by root order by node) - 1 as local from comp",
    "component_lookup": f"{_GRAPH} select skel, max(root) as root from comp group by skel",
    "threshold_grid": "select i + 1 as ord, round(1 / (1 + exp(-0.2::double * i)), 4) as thr from (select unnest(range(-1, 12)) as i)",
    "threshold_sweep": f"{_SWEEP} select ord, thr, round(nerl, 6) as nerl, round(voi_sum, 6) as voi_sum, n_non0_mergers from sw",
    "best_threshold": f"{_SWEEP} select thr, round(nerl, 6) as nerl from sw where nerl > 0 order by sw.nerl desc, ord limit 1",
    "best_no_merge": f"{_SWEEP} select round(coalesce(min(voi_sum), 1e100), 6) as best_voi, round(coalesce(min(voi_sum) filter (n_non0_mergers = 0), 1e100), 6) as best_voi_no_merge, "
    "round(coalesce(max(nerl) filter (n_non0_mergers = 0), -1), 6) as best_nerl_no_merge from sw",
    "running_best": f"with {_LOG} select run, mode, step, round(value, 6) as value, "
    "round(greatest(max(value) over (partition by run, mode order by step), 0), 6) as best, "
    "value > greatest(coalesce(max(value) over (partition by run, mode order by step rows between unbounded preceding and 1 preceding), 0), 0) as improved from lg",
    "topk_checkpoints": f"with {_LOG} select step, value as val_loss from lg where value is not null order by value, step limit 100",
    "validation_batches": "select event_id, user_id from events order by event_id limit 800",
    "scalar_log": f"with {_LOG} select run, mode as tag, step, value from lg where value is not null",
    "tensor_stats": "select event_type, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from events group by event_type",
    "grad_norm": "select round(sqrt(sum(v * v)), 4) as norm, round(max(abs(v)), 4) as max_abs from (select cast(unnest(embedding) as double) as v from embeddings)",
    "config_grid": f"with {_config()} select * from grid",
    "cli_args": f"with {_config()}, n as (select *, {_NAME} as exp from grid), c as (select combo, save_path || '/' || exp as save_dir, {_ARGS} as args, exp from n) "
    "select combo, false as is_long, save_dir, args, exp as exp_name, 'sbatch --output ' || save_dir || '/slurm.out aff_train.sh ' || args as command from c",
    "exp_name_regex": f"with {_config()} select combo, {_NAME} as exp_name from grid",
    "experiment_name": "select event_id, strftime(ts, '%y-%m-%d_%H-%M-%S-%f') || "
    + " || ".join(
        f"'{text}' || " + ("cast(user_id % 7 as varchar)" if key == "seed" else f"'v{i}'") for i, (text, key) in enumerate(sweep.NAME_PARTS)
    )
    + " as name from events",
    "format_value": "select * from (values ('a', 'true'), ('b', 'false'), ('c', '1 x 2.5'), ('d', ''), ('e', '0.001'), ('f', '')) t(key, value)",
    "dataset_length": "select dataset, min(floor(mult * (sx - 2 * off) * (sy - 2 * off) * (sz - 2 * off) / power(size, 3)))::bigint as length "
    f"from (values {', '.join(str(r) for r in _SIZES)}) t(dataset, sx, sy, sz, off, size, mult) group by dataset",
    "weighted_concat_len": "select min(length) as weighted, sum(length)::bigint as concatenated from (select dataset, "
    "min(floor(mult * (sx - 2 * off) * (sy - 2 * off) * (sz - 2 * off) / power(size, 3)))::bigint as length "
    f"from (values {', '.join(str(r) for r in _SIZES)}) t(dataset, sx, sy, sz, off, size, mult) group by dataset)",
    "segmentation_scores": f"{COMPONENTS_SQL}, lab as (select vox.seg as t, seg6.seg as p from vox join seg6 using (x, y, z) where vox.seg > 0), {_VOI}",
}
