"""Presentation of metric frames as text or markdown lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..operators.ordering import numbered
from ..operators.outcomes import STATUSES


def fixed(value: Column, digits: int = 4) -> Column:
    """Number with a fixed count of decimals; a missing value reads ``nan``."""
    return F.coalesce(F.format_string(f"%.{digits}f", value.cast("double")), F.lit("nan"))


def report(metrics: DataFrame, digits: int = 4, markdown: bool = False) -> DataFrame:
    """Lines ``metric: value`` from ``line_no, metric, value``."""
    line = F.concat(F.col("metric"), F.lit(": "), F.when(F.col("value").isNull(), "nan").otherwise(fixed(F.col("value"), digits)))
    return metrics.select("line_no", (F.concat(F.lit("- "), line) if markdown else line).alias("line")).orderBy("line_no")


def share_report(shares: DataFrame, label: str, n: str, percent: str) -> DataFrame:
    """Console table of labels with count and percentage, most frequent first."""
    # Column widths.
    line = F.format_string("%-30s%-10d%.2f%%", F.col(label), F.col(n), F.col(percent))
    return shares.orderBy(F.desc(n), label).select(line.alias("line"))


def outcome_report(summary: DataFrame, errors: DataFrame, title: str = "Query Summary") -> DataFrame:
    """Markdown lines ``section, number, line`` of an outcome summary and its distinct error messages.

    Messages are cut for display, but two that differ are two rows.  They are numbered in order, block by block
    (:func:`.ordering.numbered`), so no task sorts all of them.
    """
    # Report wording.
    titles = dict(zip(STATUSES, ("Non-empty results", "Empty results", "Errors (NaN)")))

    def of(status: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("status") == status, F.col(column))), F.lit(0))

    def row(section: int, number: int, line: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(number).cast("bigint").alias("number"), line.alias("line"))

    lines = [
        row(0, 0, F.lit(f"# {title}")),
        row(1, 0, F.concat(F.lit("**Total rows processed:** "), of("TOTAL", "n").cast("string"))),
        *[row(2, i, F.format_string(f"- **{name}:** %d (%.2f%%)", of(status, "n"), of(status, "percent").cast("double")))
          for i, (status, name) in enumerate(titles.items())],
    ]
    head = summary.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines"))
    found = errors.select("error").where(F.col("error") != "").distinct()
    listed = numbered(found, "error")
    safe = F.replace(tx.truncate(F.col("error")), F.lit("|"), F.lit("\\|"))
    tail = listed.select(
        F.lit(4).alias("section"), "number", F.concat(F.lit("| "), F.col("number").cast("string"), F.lit(" | "), safe, F.lit(" |")).alias("line")
    )
    table = F.array(*[row(3, i, F.lit(t)) for i, t in enumerate(("## Distinct Error Types", "| # | Error Message |", "|---|---------------|"))])
    opening = found.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(F.inline(table))
    return head.unionByName(opening).unionByName(tail).orderBy("section", "number")


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
