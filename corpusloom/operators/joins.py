"""A lookup that stays balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def lookup_join(fact: DataFrame, dim: DataFrame, on: Sequence[str], key: Column, how: str = "left") -> DataFrame:
    """Join a fact frame to a dimension on ``on``; ``key`` identifies fact rows.

    The join itself is left to adaptive execution, which broadcasts a dimension that it measures to be small and splits a
    key that is hot on the fact side; neither depends on a fixed number.
    """
    return fact.join(dim, list(on), how)
