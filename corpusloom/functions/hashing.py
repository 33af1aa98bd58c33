"""Portable pseudo-random ordering: md5 gives the same order in every engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash_order(seed: int | str, *keys: Column) -> Column:
    """Hex digest that orders rows reproducibly for a seed and a row key."""
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))
