"""Grouping question/answer pairs by their table, and statistics over the group sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from .extract import answer_text
from .ordering import block_of

SEGMENT_BYTES = 64 << 20
BLOCK_ROWS = 4_096


def concat_by_table(
    df: DataFrame,
    table: Column,
    piece: Column,
    segment_bytes: int = SEGMENT_BYTES,
    block_rows: int = BLOCK_ROWS,
    keep_empty: bool = False,
) -> DataFrame:
    """Concatenate ``piece`` over the rows of each (source, table), in ``ord`` order.

    Returns ``source, table, segment, num_pairs, content``.  A table comes as consecutive segments of about
    ``segment_bytes`` whose texts, joined by a blank in segment order, are the whole text; most have segment 0 only.
    ``num_pairs`` counts all pairs of the table, also those with an empty piece; empty pieces add no text unless
    ``keep_empty``.

    All tables take the same way: pieces are joined per block of ``block_rows`` positions, the bytes before a block say
    which segment it belongs to, and blocks are joined per segment.  No task holds more than a segment of a table.
    """
    keys = ["source", "_key", "_block"]
    rows = df.select("source", "ord", table.alias("table"), piece.alias("_piece")).withColumns({
        "_key": F.coalesce(F.sha2(F.col("table"), 256), F.lit("")),  # not null: no filter is inferred
        "_block": block_of(F.col("ord"), block_rows),
    })
    kept = F.col("_piece").isNotNull() if keep_empty else F.col("_piece") != ""
    size = F.coalesce(F.sum(F.when(kept, F.octet_length("_piece") + 1)), F.lit(0))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs"), size.alias("_bytes"))
    whole = Window.partitionBy("source", "_key")
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.select(
        *keys,
        block_of(F.coalesce(F.sum("_bytes").over(before), F.lit(0)), segment_bytes).alias("segment"),
        F.sum("_pairs").over(whole).alias("num_pairs"),
    )
    pieces = F.array_sort(F.collect_list(F.when(kept, F.struct("ord", "_piece"))))
    blocks = rows.groupBy(*keys).agg(
        F.any_value("table").alias("table"), F.array_join(F.transform(pieces, lambda p: p["_piece"]), " ").alias("_text"),
        F.count_if(kept).alias("_kept"),
    )
    texts = F.array_sort(F.collect_list(F.when(F.col("_kept") > 0, F.struct("_block", "_text"))))
    return (
        blocks.join(placed, keys).groupBy("source", "_key", "segment")
        .agg(F.any_value("table").alias("table"), F.any_value("num_pairs").alias("num_pairs"),
             F.array_join(F.transform(texts, lambda t: t["_text"]), " ").alias("content"))
        .select("source", "table", "segment", "num_pairs", "content")
    )


def group_claims(df: DataFrame, **limits: int) -> DataFrame:
    """Claims per cleaned table as one line: table text, then the claims in arrival order, each after a blank (also empty ones).

    The table text opens only segment 0, so segments still add up to the whole line.
    """
    grouped = concat_by_table(
        df, tx.clean_caption(F.col("input_seg")), tx.clean_claim(F.col("question")), keep_empty=True, **limits
    )
    line = F.when(F.col("segment") == 0, F.concat_ws(" ", "table", "content")).otherwise(F.col("content"))
    return grouped.select("source", "table", "segment", F.col("num_pairs").alias("num_claims"), line.alias("line"))


def group_qa_by_table(df: DataFrame, **limits: int) -> DataFrame:
    """Pairs per raw table as ``Q1 A1 Q2 A2 ...``; empty pairs count but add no text."""
    piece = F.trim(F.concat_ws(" ", tx.collapse_ws(F.col("question")), tx.collapse_ws(F.col("answer"))))
    return concat_by_table(df, F.col("table"), piece, **limits).withColumnRenamed("content", "qas")


def group_qa_clean(df: DataFrame, compat: bool = False, **limits: int) -> DataFrame:
    """Pairs per cleaned table with punctuation-free text, ready for similarity scoring.

    ``df`` holds raw examples whose ``question`` is already taken out of its wrapper; rows without table
    text or question are left out.
    """
    asked = df.where(tx.has_text(F.col("question")))
    piece = tx.collapse_ws(tx.strip_punct(F.concat_ws(
        " ", tx.drop_quotes(F.col("question")), answer_text(df, "output")
    )))
    table = tx.clean_segment(F.col("input_seg"), 2, compat)
    # The empty table is dropped after grouping, so the costly cleaning is not repeated inside a filter.
    grouped = concat_by_table(asked, table, piece, **limits).where(F.col("table") != "")
    return grouped.withColumnRenamed("content", "qas")


def group_size_stats(df: DataFrame) -> DataFrame:
    """Group-size statistics per source plus a pooled ``ALL`` row; population standard deviation.

    ``ALL`` pools the per-source groups: a table that occurs in two sources counts as two groups.  The
    median keeps one counter per distinct size, at most about the square root of twice the pairs.
    """
    groups = df.groupBy("source", F.sha2(F.col("table"), 256).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    stats = groups.rollup("source").agg(
        F.count(F.lit(1)).alias("num_tables"),
        F.sum("_n").alias("total_qas"),
        F.avg("_n").alias("mean"),
        F.median("_n").alias("median"),
        F.stddev_pop("_n").alias("stdev"),
        F.grouping_id().alias("_pooled"),
    )
    name = F.when(F.col("_pooled") == 1, "ALL").otherwise(F.col("source"))
    return stats.select(name.alias("source"), "num_tables", "total_qas", "mean", "median", "stdev")
