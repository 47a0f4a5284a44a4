"""Keeps Catalyst from inlining a projection into every use of its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each evaluated once a row however often it is used later.

    A one-element generator stands between the projections, which otherwise
    collapse into one whose size grows with the product of the uses.
    """
    staged = df.withColumns(columns)
    return staged.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in staged.columns)))))
