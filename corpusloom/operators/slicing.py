"""Greedy size-limited slicing of ordered sources, computed in parallel.

Greedy slicing is a left fold: a row opens a new part when the running fill would pass the limit.  The
effect of a whole block of rows on that fold is a small step function (entry fill -> exit fill, parts
opened), and step functions compose, so the fold is an associative scan.  Blocks are summarised
independently; a tree of summaries is built upwards, ``group_blocks`` neighbours at a time; entry states
then run down the tree, and each block places its own cuts.  A task handles many nodes, one after the
other, and holds one node's children or one block at a time; no task sees a whole source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .ordering import block_of

SLICE_BYTES = 20_000_000
BLOCK_ROWS = 1_000_000
GROUP_BLOCKS = 256
# Rows that have been read before a task passes its results on.
OUT_ROWS = 65_536


def _next_cut(ends: np.ndarray, limit: int) -> np.ndarray:
    """For a part opened at each row, the row that opens the following part (``len`` if none)."""
    starts = np.concatenate(([0], ends[:-1]))
    follow = np.searchsorted(ends, starts + limit, side="right")
    return np.maximum(follow, np.arange(1, len(ends) + 1))


def _block_summary(sizes: np.ndarray, limit: int) -> dict[str, object]:
    """Step function of a block: ``reach[i]`` bounds the entries that end in ``fill[i]``, ``cuts[i]``."""
    ends = np.cumsum(sizes)
    n = len(ends)
    jump = _next_cut(ends, limit)
    last = jump >= n
    jump = np.where(last, np.arange(n), jump)
    hops = np.where(last, 0, 1)
    while True:  # pointer doubling to the last part opened in the block
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        hops = hops + hops[jump]
        jump = further
    exit_fill = ends[-1] - (ends[jump] - sizes[jump])
    # An entry fill of 0 cuts latest, so rows behind its first cut are never a first cut.
    used = min(int(np.searchsorted(ends, limit, side="right")) + 1, n)
    fill, cuts, reach = exit_fill[:used], hops[:used] + 1, ends[:used]
    run_end = np.append((fill[1:] != fill[:-1]) | (cuts[1:] != cuts[:-1]), True)
    return {"total": int(ends[-1]), "reach": reach[run_end], "fill": fill[run_end], "cuts": cuts[run_end]}


def _enter(summary: tuple, fill: int, limit: int) -> tuple[int, int]:
    """Fill on leaving and parts opened, for one entry fill of a step function ``total, reach, fill, cuts``."""
    total, reach, fills, cuts = summary
    at = int(np.searchsorted(reach, limit - fill, side="right"))
    return (int(fills[at]), int(cuts[at])) if at < len(reach) else (fill + int(total), 0)


def _compose(first: tuple, then: tuple, limit: int) -> tuple:
    """The step function of two neighbours: entries that cut in ``first`` leave it with a known fill; the others pass it,
    so they meet the steps of ``then`` later by the total of ``first``."""
    total, reach, fill, cuts = first
    total_then, reach_then, fill_then, cuts_then = then
    at = np.searchsorted(reach_then, limit - fill, side="right")
    beyond = np.minimum(at, len(reach_then) - 1)
    passed = at >= len(reach_then)
    fill = np.concatenate((np.where(passed, fill + total_then, fill_then[beyond]), fill_then))
    cuts = np.concatenate((cuts + np.where(passed, 0, cuts_then[beyond]), cuts_then))
    reach = np.concatenate((reach, reach_then + total))
    used = min(int(np.searchsorted(reach, limit, side="right")) + 1, len(reach))  # no entry has more room than the limit
    fill, cuts, reach = fill[:used], cuts[:used], reach[:used]
    run_end = np.append((fill[1:] != fill[:-1]) | (cuts[1:] != cuts[:-1]), True)
    return total + total_then, reach[run_end], fill[run_end], cuts[run_end]


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys, put together across batches."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for key in keys:
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            change[1:] |= codes[1:] != codes[:-1]
        begins = np.flatnonzero(change)
        heads = zip(*(batch.column(key).take(pa.array(begins)).to_pylist() for key in keys))
        for begin, end, key in zip(begins, [*begins[1:], batch.num_rows], heads):
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield current, pa.Table.from_batches(held)


def _map_runs(df: DataFrame, keys: Sequence[str], order: str, fn: Callable[[tuple, pa.Table], list[tuple]], schema: T.StructType) -> DataFrame:
    """Rows that ``fn`` gives for each run of equal ``keys``, many runs to an Arrow batch.

    Rows are dealt out by a hash of the keys.  Where the keys themselves deal them out, Spark leaves that shuffle to a join
    below; ``mapInArrow`` asks for no distribution, so a join that is broadcast while it runs would then read its rows map
    task by map task, and a run would come in pieces.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        for key, table in _runs(batches, keys):
            rows += fn(key, table)
            weight += table.num_rows
            if rows and weight > OUT_ROWS:
                yield batch_of(rows)
                rows, weight = [], 0
        if rows:
            yield batch_of(rows)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _functions(table: pa.Table) -> list[tuple]:
    """The step functions in a run of summaries."""
    lists = [[np.array(x, np.int64) for x in table.column(c).to_pylist()] for c in ("reach", "fill", "cuts")]
    return list(zip(table.column("total").to_pylist(), *lists))


def slice_starts(df: DataFrame, size: Column, limit: int, by: str, order: str, block_rows: int, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """Per block: the part that is open on entry and the order values that open further parts.

    The height of the tree comes from the largest order value, one aggregate that runs when the frame is built.
    """
    rows = df.select(
        by, F.col(order).cast("bigint").alias("_ord"), size.cast("bigint").alias("_size")
    ).withColumn("_block", block_of(F.col("_ord"), block_rows))
    one, longs = T.LongType(), T.ArrayType(T.LongType())

    def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([T.StructField(by, df.schema[by].dataType), *[T.StructField(n, t) for n, t in fields]])

    summary = schema(("_node", one), ("total", one), ("reach", longs), ("fill", longs), ("cuts", longs))

    def summarise(key: tuple, table: pa.Table) -> list[tuple]:
        s = _block_summary(table.column("_size").to_numpy(), limit)
        return [(*key, s["total"], s["reach"], s["fill"], s["cuts"])]

    def compose(key: tuple, table: pa.Table) -> list[tuple]:
        first, *others = _functions(table)
        for then in others:
            first = _compose(first, then, limit)
        return [(*key, *first)]

    def descend(key: tuple, table: pa.Table) -> list[tuple]:
        fill, part, out = table.column("_fill")[0].as_py(), table.column("_part")[0].as_py(), []
        for node, step in zip(table.column("_node").to_pylist(), _functions(table)):
            out.append((key[0], node, fill, part))
            fill, opened = _enter(step, fill, limit)
            part += opened
        return out

    def place(key: tuple, table: pa.Table) -> list[tuple]:
        ends, at_ord = np.cumsum(table.column("_size").to_numpy()), table.column("_ord").to_numpy()
        fill, part = table.column("_fill")[0].as_py(), table.column("_part")[0].as_py()
        follow = _next_cut(ends, limit)
        at, starts = int(np.searchsorted(ends, limit - fill, side="right")), []
        while at < len(ends):
            starts.append(at_ord[at])
            at = int(follow[at])
        return [(*key, part, starts)]

    def parent(level: DataFrame) -> DataFrame:
        return level.withColumn("_parent", block_of(F.col("_node"), group_blocks))

    group_blocks = max(2, group_blocks)
    top = rows.agg(F.max(F.abs(F.col("_block")))).first()[0] or 0
    levels = [_map_runs(rows.withColumnRenamed("_block", "_node"), (by, "_node"), "_ord", summarise, summary)]
    while top or len(levels) == 1:
        above = _map_runs(parent(levels[-1]), (by, "_parent"), "_node", compose, T.StructType(
            [T.StructField("_parent", one) if f.name == "_node" else f for f in summary]))
        levels.append(above.withColumnRenamed("_parent", "_node"))
        top //= group_blocks
    # the first row of a source always opens part 1
    entries = levels[-1].select(by, "_node", F.lit(limit + 1).cast("bigint").alias("_fill"), F.lit(0).cast("bigint").alias("_part"))
    for level in levels[-2::-1]:
        known = parent(level).join(entries.withColumnRenamed("_node", "_parent"), [by, "_parent"])
        entries = _map_runs(known, (by, "_parent"), "_node", descend, schema(("_node", one), ("_fill", one), ("_part", one)))
    opened = rows.join(entries.withColumnRenamed("_node", "_block"), [by, "_block"])
    return _map_runs(opened, (by, "_block"), "_ord", place, schema(("_block", one), ("_part", one), ("_starts", longs)))


def slice_by_size(
    df: DataFrame,
    size: Column,
    limit: int = SLICE_BYTES,
    by: str = "source",
    order: str = "ord",
    block_rows: int = BLOCK_ROWS,
    group_blocks: int = GROUP_BLOCKS,
) -> DataFrame:
    """Add the 1-based ``part`` of each row: greedy slices of at most ``limit`` bytes per source.

    A part is closed when the next row would pass the limit; a row larger than the limit is a part of its
    own.  Rows without a source are left out.  A row finds its part among the cuts of its block by binary search, one projection per step.
    """
    starts = slice_starts(df, size, limit, by, order, block_rows, group_blocks)
    at = F.col(order).cast("bigint")
    placed = df.withColumn("_block", block_of(at, block_rows)).join(starts, [by, "_block"]).withColumn("_opened", F.lit(0))
    for shift in reversed(range(block_rows.bit_length())):
        step = 1 << shift
        begun = F.get("_starts", F.col("_opened") + F.lit(step - 1)) <= at
        placed = placed.withColumn("_opened", F.col("_opened") + F.when(begun, step).otherwise(0))
    return placed.withColumn("part", F.col("_part") + F.col("_opened")).drop("_block", "_part", "_starts", "_opened")


def row_totals(df: DataFrame, size: Column, by: str = "source") -> DataFrame:
    """Rows and bytes per source with a pooled ``ALL`` row."""
    per = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.sum(size.cast("bigint")).alias("_b"))
    totals = per.rollup(by).agg(
        F.sum("_n").alias("num_rows"), F.sum("_b").alias("num_bytes"), F.grouping_id().alias("_pooled")
    )
    name = F.when(F.col("_pooled") == 1, "ALL").otherwise(F.col(by))
    return totals.select(name.alias(by), "num_rows", "num_bytes")
