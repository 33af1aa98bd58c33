"""Skew-safe order statistics: running indexes, ranks and exact quantiles.

A plain ``Window.partitionBy(source)`` sends a hot source to a single task.  The operators here cut the
order into blocks first, count per block (partial aggregation, small), turn the counts into block offsets,
and only then order rows inside a block.  Results are exact; the blocks only balance the work.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK_ROWS = 65_536
VALUE_BLOCKS = 1_024
SKETCH_ACCURACY = 10_000


def block_of(position: Column, size: int) -> Column:
    """Whole-number block of a position (integer division, exact for any 64-bit value)."""
    return F.call_function("div", position, F.lit(size))


def running_index(
    df: DataFrame, by: Sequence[str], order: str, name: str = "idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the 0-based position of each row within ``by``, in ``order``.

    ``order`` is an integral column, unique within ``by``.  A block spans ``block_rows`` consecutive values
    of it, so no task orders more rows than that for one key.
    """
    keys = [*by, "_block"]
    blocked = df.withColumn("_block", block_of(F.col(order), block_rows))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return (
        blocked.withColumn("_inside", inside).join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_inside") - 1)
        .drop("_block", "_inside", "_offset")
    )


def next_value(df: DataFrame, order: str, name: str = "next", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the next larger value of ``order`` that exists, to the largest the smallest; pass narrow rows.

    ``order`` is an integral column of unique values; they may have gaps of any size. Values are ordered inside blocks of
    ``block_rows`` of them, and only the first value of each block is ordered over all blocks.
    """
    blocked = df.withColumn("_block", block_of(F.col(order), block_rows))
    across = Window.partitionBy(F.lit(0)).orderBy("_first")
    firsts = blocked.groupBy("_block").agg(F.min(order).alias("_first"))
    begins = firsts.select("_block", F.coalesce(F.lead("_first").over(across), F.min("_first").over(Window.partitionBy(F.lit(0)))).alias("_after"))
    inside = F.lead(order).over(Window.partitionBy("_block").orderBy(order))
    return (
        blocked.withColumn(name, inside).join(begins, "_block")
        .withColumn(name, F.coalesce(name, "_after")).drop("_block", "_after")
    )


def with_next(df: DataFrame, order: str, columns: Sequence[str], blocks: int = VALUE_BLOCKS) -> DataFrame:
    """``order, columns`` and ``next_...`` of each column: its value in the row of the next larger ``order``, for the largest of the smallest.

    ``order`` has unique values, of any gaps; rows without one are left out. The first values of blocks are the values of
    smallest hash and the smallest value, so about as many rows lie in each block. Wide rows are shuffled once, to their block;
    the first row of a block also goes to the block before.
    """
    rows = df.select(order, *columns).where(F.col(order).isNotNull())
    chosen = rows.select(F.xxhash64(order).alias("_hash"), order).orderBy("_hash", order).limit(blocks).select(order)
    cuts = chosen.union(rows.agg(F.min(order).alias(order))).agg(F.array_sort(F.collect_set(order)).alias("cuts")).scalar()
    placed = rows.withColumns({"_cuts": cuts, "_begun": F.lit(0)})
    for shift in reversed(range((blocks + 1).bit_length())):
        step = 1 << shift
        begun = F.get("_cuts", F.col("_begun") + F.lit(step - 1)) <= F.col(order)
        placed = placed.withColumn("_begun", F.col("_begun") + F.when(begun, step).otherwise(0))
    block = F.col("_begun") - 1
    home = F.struct(block.alias("_block"), F.lit(False).alias("_guest"))
    before = F.struct(F.pmod(block - 1, F.size("_cuts")).alias("_block"), F.lit(True).alias("_guest"))
    first = F.get("_cuts", block) == F.col(order)
    sent = placed.select(order, *columns, F.inline(F.when(first, F.array(home, before)).otherwise(F.array(home))))
    inside = Window.partitionBy("_block").orderBy("_guest", order)
    return sent.withColumns({f"next_{c}": F.lead(c).over(inside) for c in columns}).where(~F.col("_guest")).drop("_block", "_guest")


def numbered(df: DataFrame, x: str, name: str = "number", blocks: int = VALUE_BLOCKS) -> DataFrame:
    """Add the 1-based position of each row in the order of ``x``, whose values are unique and may be texts.

    Cut points are the values of smallest hash, so about as many values lie between any two of them, whatever the texts begin
    with. Positions are counted inside blocks; the rows of the blocks before come from an array of their sizes.
    """
    chosen = df.select(F.xxhash64(x).alias("_hash"), x).orderBy("_hash", x).limit(blocks - 1)
    cuts = chosen.agg(F.array_sort(F.collect_list(x)).alias("cuts")).scalar()
    placed = _add_value_blocks(df, x, cuts, blocks - 1)
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("block", "n")).alias("sizes")).scalar()
    before = F.aggregate(
        F.filter("_sizes", lambda s: s["block"] < F.col("block")), F.lit(0).cast("bigint"), lambda total, s: total + s["n"]
    )
    inside = F.row_number().over(Window.partitionBy("block").orderBy(x))
    return placed.withColumns({name: inside, "_sizes": sizes}).withColumn(name, F.col(name) + before).drop("block", "_sizes")


def _add_value_blocks(rows: DataFrame, x: str, cuts: Column, n_cuts: int) -> DataFrame:
    """Add ``block``, the number of cut points below ``x``, by binary search over a sorted array.

    One projection per step keeps the search in generated code; a higher-order function would be
    interpreted row by row.
    """
    out = rows.withColumns({"_cuts": cuts, "block": F.lit(0)})
    for shift in reversed(range(n_cuts.bit_length())):
        step = 1 << shift
        beyond = F.get("_cuts", F.col("block") + F.lit(step - 1)) < F.col(x)
        out = out.withColumn("block", F.col("block") + F.when(beyond, step).otherwise(0))
    return out.drop("_cuts")


def rank_table(
    df: DataFrame, by: Sequence[str], x: str, blocks: int = VALUE_BLOCKS, quantiles: Sequence[float] = ()
) -> DataFrame:
    """Distinct values of ``x`` per key with their frequency and the rows below them.

    Returns ``by..., x, freq, below, total, block``; null and NaN values are left out.  Cut points come
    from a sketch over the whole column (one row, a scalar subquery); equal values are merged before the
    value shuffle, so a value that holds most rows costs one row per map task.  With ``quantiles`` only the
    blocks that hold their ranks are ordered and returned.
    """
    by = list(by)
    value = F.col(x).cast("double")
    rows = df.select(*by, value.alias(x)).where(F.col(x).isNotNull() & ~F.isnan(x))
    points = F.expr(f"array({', '.join(f'{i / blocks}D' for i in range(1, blocks))})")
    cuts = rows.agg(F.percentile_approx(x, points, SKETCH_ACCURACY).alias("cuts")).scalar()
    keys = [*by, "block"]
    freq = (
        _add_value_blocks(rows, x, cuts, blocks - 1)
        .groupBy(*keys, x).agg(F.count(F.lit(1)).alias("freq"))
    )
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = freq.groupBy(*keys).agg(F.sum("freq").alias("_rows")).select(
        *keys,
        "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(whole).alias("total"),
    )
    placed = freq.join(offsets, keys)
    if quantiles:
        last = F.col("_offset") + F.col("_rows") - 1
        placed = placed.where(reduce(lambda a, b: a | b, [
            (F.col("_offset") <= F.ceil((F.col("total") - 1) * q)) & (F.floor((F.col("total") - 1) * q) <= last)
            for q in map(float, quantiles)
        ]))
    inside = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_offset") + F.coalesce(F.sum("freq").over(inside), F.lit(0))
    return placed.select(*by, x, "freq", below.alias("below"), "total", "block")


def quantile_aggregates(x: str, quantiles: dict[str, float]) -> list[Column]:
    """Aggregates over a :func:`rank_table` giving interpolated quantiles (one column per name)."""
    out = []
    for name, q in quantiles.items():
        at = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)

        def value_at(rank: Column) -> Column:
            hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("freq"))
            return F.max(F.when(hit, F.col(x)))

        share = F.max(at - low)
        out.append((value_at(low) * (1 - share) + value_at(high) * share).alias(name))
    return out


def exact_quantiles(
    df: DataFrame, by: Sequence[str], x: str, quantiles: dict[str, float], blocks: int = VALUE_BLOCKS
) -> DataFrame:
    """Exact quantiles of ``x`` per key with linear interpolation, without gathering a key in one task."""
    ranks = rank_table(df, by, x, blocks, list(quantiles.values()))
    return ranks.groupBy(*by).agg(*quantile_aggregates(x, quantiles))


def average_ranks(df: DataFrame, x: str, name: str, blocks: int = VALUE_BLOCKS) -> DataFrame:
    """Distinct values of ``x`` with their 1-based average rank over all rows."""
    ranks = rank_table(df, [], x, blocks)
    return ranks.select(x, (F.col("below") + (F.col("freq") + 1) / F.lit(2.0)).alias(name))
