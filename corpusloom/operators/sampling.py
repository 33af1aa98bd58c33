"""Reproducible samples per source: fixed size, and quotas with top-up.

Rows are ordered by a portable hash of seed and row key, so the same sample comes out on any cluster and in
any engine.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import hash_order

SALTS = 256


def smallest_per_group(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group in ``order``, with their 1-based ``_rank``.

    The smallest rows merge: every task keeps its own first ``n`` of a group before anything is shuffled, these are cut again
    among every ``SALTS``-th task, and what is left of a group, ``n`` rows for each salt at most, once more. So the
    shuffles carry ``n`` rows for each task and group, however many rows a group has (for ``n`` up to the session's
    ``spark.sql.optimizer.windowGroupLimitThreshold``; beyond that the result is the same, but whole groups are shuffled).
    """
    part = Window.partitionBy(by, "_salt").orderBy(*order)
    # The salt is one for all rows of a task, so Spark's limit on ranks below the shuffle leaves n rows of a group in it.
    # It decides where rows meet, not which are kept.
    trimmed = (
        df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("_rank", F.row_number().over(part))
        .where(F.col("_rank") <= n).drop("_salt", "_rank")
    )
    whole = Window.partitionBy(by).orderBy(*order)
    return trimmed.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= n)


def sample_n(df: DataFrame, key: str, n: int = 50, by: str = "source", seed: int = 42) -> DataFrame:
    """``n`` rows per group; groups with fewer rows are skipped."""
    picked = smallest_per_group(
        df.withColumn("_hash", hash_order(seed, F.col(key))), by, [F.col("_hash"), F.col(key)], n
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(by))
    return picked.withColumn("_size", size).where(F.col("_size") == n).drop("_hash", "_rank", "_size")


def quota_sample(
    df: DataFrame,
    key: str,
    quotas: Mapping[str, int],
    default: int = 14,
    total: int = 100,
    by: str = "source",
    seed: int = 42,
) -> DataFrame:
    """``quotas[group]`` (else ``default``) rows per group, topped up or trimmed to ``total`` rows.

    The deficit is filled from the leftovers of the first groups in name order; an excess is trimmed from
    the last groups.  A group can give at most its quota plus the whole deficit, so ranking stops there and
    the final cut is a top-k.
    """
    quota = F.lit(default)
    for name, n in quotas.items():
        quota = F.when(F.col(by) == name, n).otherwise(quota)
    most = max([default, *quotas.values()]) + total
    ranked = smallest_per_group(
        df.withColumn("_hash", hash_order(seed, F.col(key))), by, [F.col("_hash"), F.col(key)], most
    )
    return (
        ranked.withColumn("topped_up", F.col("_rank") > quota)
        .orderBy("topped_up", by, "_rank").limit(total)
        .drop("_hash", "_rank")
    )
