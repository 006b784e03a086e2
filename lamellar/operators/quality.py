"""Checks of data and options: all checks of a table in one aggregate, and an error that says which failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is wrong, and an aggregate that is true if all is well.
Check = tuple[str, Column]


def not_empty() -> Check:
    return "there are no rows", F.count("*") > 0


def mean_above(column: str, least: float) -> Check:
    """Of labelled shares, say; without rows it fails."""
    return f"the mean of {column} isn't above {least}", F.coalesce(F.avg(F.col(column).cast("double")) > least, F.lit(False))


def within(column: str, low: float, high: float) -> Check:
    """Nulls and no rows are well."""
    return f"{column} lies outside {low} to {high}", F.coalesce(F.bool_and((F.col(column) >= low) & (F.col(column) <= high)), F.lit(True))


def require(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """``df`` itself, or a ValueError with what is wrong. One pass over the columns that are named."""
    row = df.agg(*(ok.alias(f"c{i}") for i, (_, ok) in enumerate(checks))).first()
    wrong = [what for (what, _), ok in zip(checks, row, strict=True) if not ok]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df


def one_of(name: str, value: str, allowed: Sequence[str]) -> str:
    """An option's value, or a ValueError that lists those allowed."""
    if value not in allowed:
        raise ValueError(f"{name} is {value!r}, not one of {', '.join(map(repr, allowed))}")
    return value
