"""Sinks: per-source files, text lines and size-sliced JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.slicing import SLICE_BYTES, slice_by_size

def write_by_source(df: DataFrame, path: str, fmt: str = "parquet", style: str = "minimal", by: str = "source") -> None:
    """One folder per source.  Parquet is the lossless form; CSV is for exchange.

    A source is spread over as many files as it has input partitions, so a hot source is not one task.  CSV
    style ``minimal`` has a header and quotes fields where needed; style ``none`` never quotes: backslashes,
    separators and line breaks inside a field stand behind a backslash, and there is no header line.
    """
    if fmt == "csv" and style == "none":
        unquoted_lines(df, by).write.mode("overwrite").partitionBy(by).text(path)
        return
    out = df.write.mode("overwrite").partitionBy(by)
    if fmt == "csv":
        out.options(header=True, quote='"', escape='"').csv(path)
    else:
        out.format(fmt).save(path)


def unquoted_lines(df: DataFrame, by: str = "source") -> DataFrame:
    """``by`` and ``value``: all other columns as one unquoted CSV line."""
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns if c != by]
    escaped = [F.regexp_replace(f, r"([\\,\r\n])", r"\\$1") for f in fields]
    return df.select(by, F.concat_ws(",", *escaped).alias("value"))


def flat_lines(df: DataFrame, line: str = "line", by: str = "source", order: tuple[str, ...] = ()) -> DataFrame:
    """``by``, ``order`` and ``value``: the line without line breaks."""
    return df.select(by, *order, F.regexp_replace(F.col(line), r"\R", " ").alias("value"))


def write_lines(df: DataFrame, path: str, line: str = "line", by: str = "source", order: tuple[str, ...] = ()) -> None:
    """Text files per source, one row per line; within a file lines stand in the order of the columns ``order``.

    Sources are dealt out by range of (source, order), so a large source spans several files that follow each other.
    """
    flat = flat_lines(df, line, by, order)
    if order:
        flat = flat.repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    flat.select(by, "value").write.mode("overwrite").partitionBy(by).text(path)


def record_bytes(df: DataFrame, by: str = "source") -> Column:
    """Bytes of a row as a line of a JSON-lines file that is laid out by ``by``, line break included."""
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != by]))) + 1


def write_slices(
    df: DataFrame, path: str, size: Column | None = None, limit: int = SLICE_BYTES, by: str = "source", order: str = "ord", **slicing: int
) -> DataFrame:
    """JSON lines in folders ``by=/part=``, one file for each part, rows in ``order``; returns the sliced frame.

    By default a row counts with the bytes that it takes in the file, so a file has at most ``limit`` bytes, or one row;
    :func:`slice_files` reads the sizes back.  A task writes whole parts, one after the other.
    """
    sliced = slice_by_size(df, record_bytes(df, by) if size is None else size, limit, by, order, **slicing)
    laid = sliced.repartition(by, "part").sortWithinPartitions(by, "part", order)
    laid.write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", 0).partitionBy(by, "part").json(path)
    return sliced


def slice_files(spark: SparkSession, path: str, by: str = "source") -> DataFrame:
    """``by, part, files, bytes`` of written slices, from the file sizes alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    place = F.regexp_extract("path", rf"/{by}=([^/]*)/part=(\d+)/[^/]*\z", 1), F.regexp_extract("path", r"/part=(\d+)/[^/]*\z", 1)
    return files.select(F.url_decode(place[0]).alias(by), place[1].cast("bigint").alias("part"), "length").groupBy(by, "part").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
