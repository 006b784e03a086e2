"""Column expressions: voxel values, affinities, coordinates and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(value: Column, divide: float = 1.0) -> Column:
    """Intensity over a constant, 1 or 255 by dataset."""
    return value / F.lit(float(divide))


def scaled_sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-0.2 * x))


def above(value: Column, threshold: Column) -> Column:
    """Strictly above, compared as floats; NaN is above nothing."""
    return (value > threshold.cast("float")) & ~F.isnan(value)


def tri_state(affinity: Column, mask: Column) -> Column:
    """1 or 0 where the mask holds, else -1."""
    return F.when(mask, affinity.cast("tinyint")).otherwise(F.lit(-1).cast("tinyint"))


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Loss of one prediction in its stable closed form."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def clip_rescale(value: Column, low: float = 112.0, high: float = 144.0, factor: float = 8.0) -> Column:
    return (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) * factor


#: A prime, and a multiplier for each of red, green and blue.
_COLOURS = (65521, (7919, 15485, 32452))


def colour(seg: Column, channel: int, seed: int = 0) -> Column:
    """Red, green or blue (0, 1, 2) of a segment, from 0 to 1, scattered by its number; 0 is black."""
    prime, factors = _COLOURS
    return F.when(seg == 0, F.lit(0.0)).otherwise(F.pmod((seg + seed) * factors[channel], F.lit(prime)) / float(prime))


#: Nanometres per voxel, by axis.
SCALES = {"default": (9.0, 9.0, 20.0), "liconn": (9.0, 9.0, 12.0)}


def to_nanometres(axis: str, coordinate: Column, setting: Column) -> Column:
    k = "xyz".index(axis)
    return coordinate * F.when(setting == "liconn", SCALES["liconn"][k]).otherwise(SCALES["default"][k])


def format_value(kind: Column, text: Column, parts: Column) -> Column:
    """An option's value as text: bool in lower case, list joined by blanks, none empty, others as they are."""
    return (
        F.when(kind == "bool", F.lower(text)).when(kind == "list", F.array_join(parts, " ")).when(kind == "none", F.lit("")).otherwise(text)
    )


def experiment_in(command: Column) -> Column:
    """The experiment's name in a command line."""
    return F.regexp_extract(command, r"(?<=--exp_name )\S+", 0)


def stamp(ts: Column) -> Column:
    """Two-digit year to microseconds, as names of experiments begin."""
    return F.date_format(ts, "yy-MM-dd_HH-mm-ss-SSSSSS")
