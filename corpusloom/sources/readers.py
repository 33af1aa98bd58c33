"""Readers: every row carries its source name and, where the input has one, its position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text as tx
from .arrays import array_items

EXAMPLE_FIELDS = "input_seg string, question string, output variant"


def file_name(path: Column | None = None) -> Column:
    """Base name of the input file."""
    return F.element_at(F.split(F.col("_metadata.file_path") if path is None else path, "/"), -1)


def dataset_name(name: Column) -> Column:
    """Dataset of a file name: known endings are removed, stage suffixes after the file type."""
    # File types, then stage suffixes.
    stem = F.regexp_replace(name, r"\.(?:csv|json|jsonl|txt)\z", "")
    return F.regexp_replace(stem, r"(?:-type|\.grouped|\.gtqa)\z", "")


def read_examples(spark: SparkSession, path: str, fields: str = EXAMPLE_FIELDS) -> DataFrame:
    """Examples of JSON-array files as ``source, ord, <fields>``; ``ord`` is the position in the file.

    A file that is not valid JSON or not a list of objects is skipped. Files are read in parallel, large ones too, by
    two passes over their byte ranges and one more that looks for broken files (:func:`.arrays.array_items`).
    """
    items = array_items(spark, path, f"struct<{_as_struct(fields)}>")
    return items.select(dataset_name(file_name(F.col("file"))).alias("source"), "ord", "item.*")


def _as_struct(fields: str) -> str:
    return ", ".join(":".join(part.strip().split(" ", 1)) for part in fields.split(","))


def read_example_lines(
    spark: SparkSession, path: str, fields: str = EXAMPLE_FIELDS, ord_col: str | None = None
) -> DataFrame:
    """Examples of JSON-lines files (splittable); broken lines are skipped.

    ``ord`` comes from a field of the record where there is one.  Otherwise it is a generated id that is
    increasing within a file of one read; write the frame once before using it as a key.
    """
    return parse_example_lines(spark.read.text(path).select(dataset_name(file_name()).alias("source"), "value"), fields, ord_col)


def parse_example_lines(lines: DataFrame, fields: str = EXAMPLE_FIELDS, ord_col: str | None = None) -> DataFrame:
    """Examples of the JSON records in ``value`` of ``source, value``; broken ones are skipped."""
    corrupt = "_corrupt"
    extra = f", {ord_col} bigint" if ord_col else ""
    record = F.from_json(
        "value", f"{fields}{extra}, {corrupt} string", {"columnNameOfCorruptRecord": corrupt}
    )
    raw = lines.select("source", record.alias("_r")).select("source", "_r.*")
    order = F.col(ord_col) if ord_col else F.monotonically_increasing_id()
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    return raw.where(F.col(corrupt).isNull()).select("source", order.cast("bigint").alias("ord"), *names)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    on_bad: str = "drop",
    escape: str = '"',
    multi_line: bool = False,
    skip: Sequence[str] = (),
    on_header: str = "raise",
) -> DataFrame:
    """CSV files with a header as ``source, <schema>``, without the datasets named in ``skip``.

    The header of every file is compared with the schema, blanks around names aside: a file whose columns differ or stand
    in another order raises at once (``on_header="raise"``, one job over the files' first ranges, of which one row comes back)
    or is left out (``"skip"``).  No list of files passes through the driver.  ``on_bad``: ``drop`` leaves out rows that do
    not fit the schema, whichever columns are selected later, ``keep`` fills their missing fields with null,
    ``fail`` stops the job.  ``multi_line=True`` allows line breaks inside fields, but then a file cannot be split.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    corrupt = "_corrupt_record"
    frame = (
        spark.read.schema(T.StructType([*fields.fields, T.StructField(corrupt, T.StringType())])).option("header", True)
        .option("mode", "FAILFAST" if on_bad == "fail" else "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
        .option("multiLine", multi_line).option("quote", '"').option("escape", escape).option("pathGlobFilter", "*.csv").csv(path)
    ).withColumn("_file", F.col("_metadata.file_path"))
    wrong = header_files(spark, path, fields.names, escape).where("NOT right").select(F.col("file").alias("_file"))
    if on_header == "raise":
        first = wrong.agg(F.min("_file").alias("file"), F.count(F.lit(1)).alias("n")).first()  # one row, however many files
        if first["n"]:
            raise ValueError(f"header differs from {', '.join(fields.names)}: {first['file']} and {first['n'] - 1} others")
    else:
        frame = frame.join(F.broadcast(wrong), "_file", "left_anti")  # a path for each wrong file
    if on_bad != "keep":  # always true, but it reads every column, so that none is pruned and each row is checked whole
        frame = frame.where(F.col(corrupt).isNull() & (F.xxhash64(*[f"`{c}`" for c in fields.names]) >= F.lit(-(1 << 63))))
    named = frame.select(dataset_name(file_name(F.col("_file"))).alias("source"), *[f"`{c}`" for c in fields.names])
    return named.where(~F.col("source").isin(*skip)) if skip else named


def header_files(spark: SparkSession, path: str, names: Sequence[str], escape: str = '"') -> DataFrame:
    """``file, right``: CSV files below ``path`` and whether their first line holds ``names`` in this order."""
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path)
    first = lines.where(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\A\x{feff}", "").alias("value")
    ).groupBy("file").agg(F.min_by("value", "at").alias("value"))
    wanted = ", ".join(f"c{i} string" for i in range(len(names) + 1))  # one more, to see what is too much
    cells = F.from_csv("value", wanted, {"quote": '"', "escape": escape, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    same = [F.trim(cells[f"c{i}"]).eqNullSafe(F.lit(name)) for i, name in enumerate(names)]
    return first.select("file", (reduce(and_, same, cells[f"c{len(names)}"].isNull())).alias("right"))


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file (one line is read), for ``require_columns`` style checks."""
    return [c.strip() for c in spark.read.option("header", True).csv(path).columns]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank text lines as ``source, value``."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path)
    return lines.select(
        dataset_name(file_name()).alias("source"), tx.strip(F.col("value")).alias("value")
    ).where(F.col("value") != "")


def to_parquet(df: DataFrame, path: str) -> None:
    """Convert a corpus once to Parquet, one folder per source."""
    df.write.mode("overwrite").partitionBy("source").parquet(path)
