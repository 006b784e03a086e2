"""Draws that are functions of a seed and of columns: the same in any partitioning, and when a task is repeated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, what: str, *of: str) -> Column:
    """A number in [0, 1) for the columns ``of``."""
    h = F.xxhash64(F.lit(seed), F.lit(what), *(F.col(f"`{c}`") for c in of))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def normal(seed: int, what: str, *of: str) -> Column:
    """A number of the standard normal distribution, from two even ones."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, f"{what} radius", *of)))
    return radius * F.cos(2 * math.pi * uniform(seed, f"{what} angle", *of))


#: A prime below 2^31, so that squares of what is below it fit 64 bits, and multipliers below it.
PRIME, FACTORS = 2_147_483_647, (48_271, 69_621, 39_373, 62_089)
#: Repetitions until a number lies within the range: as many as numbers lie outside it up to 900, beyond
#: that more are less likely than one in 10^70, and an error.
MOST_REPEATS = 64


def _once(x: np.ndarray, key: np.ndarray, side: int) -> np.ndarray:
    """The rounds of a balanced Feistel network on pairs of numbers below ``side``; remainders have the sign that SQL gives them."""
    right = np.fmod(x, side)
    left = (x - right) // side
    for factor in FACTORS:
        v = np.fmod(right * factor + key, PRIME)
        left, right = right, np.fmod(left + np.fmod(v * v + v * factor + 1, PRIME), side)
    return left * side + right


def shuffled(number: Column, many: int, key: Column) -> Column:
    """A keyed permutation of 0 to ``many`` - 1, one for each key from 0 to PRIME - 1.

    A balanced Feistel network on pairs of numbers below the root of ``many``; what lies outside the range is
    permuted again, so that each number comes from one. Arrays of a batch are permuted at once.
    """
    side = math.isqrt(max(0, many - 1)) + 1
    if side > PRIME:
        raise ValueError("more than 2^62 numbers")

    @F.pandas_udf("long")
    def walked(numbers: pd.Series, keys: pd.Series) -> pd.Series:
        if numbers.hasnans or keys.hasnans:
            raise ValueError("a number or a key is null")
        key = keys.to_numpy(np.int64)
        at = _once(numbers.to_numpy(np.int64), key, side)
        for _ in range(MOST_REPEATS):
            out = np.flatnonzero(at >= many)
            if not len(out):
                break
            at[out] = _once(at[out], key[out], side)
        if (at >= many).any():
            raise ValueError("a number stays outside the range")
        return pd.Series(at)

    return walked(number.cast("long"), key.cast("long"))


def alias_table(weights: list[float]) -> list[tuple[float, int]]:
    """For each number, the share of its slot that is its own, and whose the rest is: one draw of a slot serves any weights."""
    if not weights or min(weights) < 0 or not sum(weights) > 0:
        raise ValueError("weights must be 0 or more, and not all 0")
    n, total = len(weights), sum(weights)
    share = [w * n / total for w in weights]
    out = [(1.0, i) for i in range(n)]
    small, large = ([i for i in range(n) if (share[i] < 1) == below] for below in (True, False))
    while small and large:
        i, j = small.pop(), large[-1]
        out[i] = (share[i], j)
        share[j] -= 1 - share[i]
        if share[j] < 1:
            small.append(large.pop())
    return out


def chosen(weights: list[float], slot: Column, within: Column) -> Column:
    """A number by weight from two even draws in [0, 1)."""
    table = alias_table(weights)
    at = F.least(F.floor(slot * len(table)).cast("int"), F.lit(len(table) - 1))
    own, other = (F.array(*(F.lit(row[k]) for row in table)) for k in (0, 1))
    return F.when(within < F.get(own, at), at).otherwise(F.get(other, at))
