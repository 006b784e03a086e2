"""Sweeps: every combination of options, and the command line of each."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamellar.sources.storage import read_text

#: Options that are given as --option or --no-option.
SWITCHES = ("scheduler", "intensity_aug", "validate_extern", "distributed", "compile", "resume_from_last_checkpoint", "augment")


def grid(spark: SparkSession, params: dict[str, list]) -> DataFrame:
    """combo, from 0 in the order of nested loops, and for each option a struct (text, yes).

    Nested explodes of constants: the product of all options without a cartesian join.
    """
    frame = spark.range(1)
    combo = F.lit(0)
    for i, (key, values) in enumerate(params.items()):
        cells = [F.struct(F.lit(k).alias("k"), F.lit(str(v)).alias("text"), F.lit(bool(v)).alias("yes")) for k, v in enumerate(values)]
        frame = frame.withColumn(f"__{i}", F.explode(F.array(*cells)))
        combo = combo * len(values) + F.col(f"__{i}.k")
    options = (F.struct(F.col(f"__{i}.text").alias("text"), F.col(f"__{i}.yes").alias("yes")).alias(k) for i, k in enumerate(params))
    return frame.select(combo.cast("long").alias("combo"), *options)


def _argument(key: str, varied: bool) -> tuple[Column | None, Column | None]:
    """What an option adds to the arguments, and to the name."""
    text, yes = F.col(f"`{key}`.text"), F.col(f"`{key}`.yes")
    if key in SWITCHES:
        return F.when(yes, F.lit(f"--{key}")).otherwise(F.lit(f"--no-{key}")), None
    if key in ("auto_resubmit", "exp_name"):
        return None, None
    return F.concat(F.lit(f"--{key} "), text), F.concat(F.lit(key), text) if varied else None


def commands(spark: SparkSession, params: dict[str, list]) -> DataFrame:
    """combo, is_long, save_dir, args, exp_name and command; a command is text and is never run."""
    frame = grid(spark, params)
    args, parts = [], []
    if "exp_name" in params:
        parts.append(F.lit(str(params["exp_name"][0])))
    for key, values in params.items():
        a, n = _argument(key, len(values) > 1)
        args += [a] if a is not None else []
        parts += [n] if n is not None else []
    name = F.concat_ws("-", *parts) if parts else F.lit("")
    name = F.when(name == "", F.lit("experiment")).otherwise(name)
    folder = F.col("`save_path`.text") if "save_path" in params else F.lit("")
    inside = F.when((folder == "") | folder.endswith("/"), F.concat(folder, F.col("exp_name"))).otherwise(F.concat_ws("/", folder, F.col("exp_name")))
    is_long = F.col("`auto_resubmit`.yes") if "auto_resubmit" in params else F.lit(False)
    out = frame.withColumn("exp_name", name).select(
        "combo", is_long.alias("is_long"), inside.alias("save_dir"), F.concat_ws(" ", *args, F.concat(F.lit("--exp_name "), "exp_name")).alias("args"), "exp_name"
    )
    # The text of the command.
    head = F.concat(F.lit("sbatch --output "), F.col("save_dir"), F.lit("/slurm.out "))
    extra = F.concat(F.lit("--export=ALL,SAVE_DIR="), F.col("save_dir"), F.lit(",LONG_JOB=TRUE,PYTORCH_CUDA_ALLOC_CONF=expandable_segments:True "))
    return out.withColumn("command", F.concat(head, F.when(F.col("is_long"), extra).otherwise(F.lit("")), F.lit("aff_train.sh "), F.col("args")))


def combinations(params: dict[str, list]) -> list[tuple]:
    """The same order on the driver, for small sweeps."""
    return list(itertools.product(*params.values()))


def load_config(spark: SparkSession, path: str) -> dict:
    """A YAML file's content, from any store that Spark reads; needs PyYAML, which reads 1e-3 as text and 1_000_000 as a number."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML configuration needs PyYAML") from e
    return yaml.safe_load(read_text(spark, path))


#: Parts of an experiment's name after the time, in order: text before each option, and the option.
NAME_PARTS = (
    ("ds_", "data_setting"),
    ("_lrng", "long_range"),
    ("_s", "seed"),
    ("_b", "batch_size"),
    ("_m", "model_id"),
    ("_k", "kernel_size"),
    ("_lr", "learning_rate"),
    ("_wd", "weight_decay"),
    ("_sch", "scheduler"),
    ("_syn_", "synthetic"),
    ("_drop", "drop_slice_prob"),
    ("_shift", "shift_slice_prob"),
    ("_int", "intensity_aug"),
    ("_noise", "noise_scale"),
    ("_affine", "affine"),
    ("_ns", "n_steps"),
    ("_ss", "small_size"),
)


def experiment_name(ts: Column, option) -> Column:
    """The name made of a time and options; ``option`` gives an option's text as a column."""
    from lamellar.functions.scalar import stamp

    return F.concat(stamp(ts), *(c for text, key in NAME_PARTS for c in (F.lit(text), option(key))))
