"""Outcomes of generated queries: result normalisation, outcome summary and change counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx

# Text for an empty result, status names, and error message forms.
EMPTY = "empty"
STATUSES = ("non_empty", "empty", "error_nan")
BAD_FORMAT = "Unexpected results format"
_MALFORMED = "_malformed"
_RESULT_SCHEMA = f"results struct<bindings: array<struct<obj: struct<value: string>>>>, {_MALFORMED} string"


def _snippet(body: Column) -> Column:
    """A message body on one line; it is kept whole, reports cut it for display."""
    return F.replace(tx.strip(body), F.lit("\n"), F.lit(" "))


def http_error(status: Column, body: Column) -> Column:
    """Error message of a response that is not 200; null for a good one."""
    message = F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), _snippet(body))
    return F.when(status != 200, message)


def normalize_results(df: DataFrame, json_col: str, error_col: str | None = None) -> DataFrame:
    """Add ``obj_list``, ``obj_values`` and ``error`` from SPARQL JSON results.

    Values of ``obj`` are de-duplicated in order and joined by ';'.  No value gives ``empty``; a failed row
    has null values and its message.
    """
    body = F.col(json_col)
    given = F.col(error_col) if error_col else F.lit(None).cast("string")
    parsed = F.from_json(body, _RESULT_SCHEMA, {"columnNameOfCorruptRecord": _MALFORMED})
    read = df.withColumn("_parsed", parsed)
    # One typed parse decides for good rows; only the others are looked at again.
    misread = F.col("_parsed").isNull() | F.col(f"_parsed.{_MALFORMED}").isNotNull()
    raw_bindings = F.get_json_object(body, "$.results.bindings")
    problem = (
        F.when(given.isNotNull() & (given != ""), given)
        .when(misread & F.try_parse_json(body).isNull(),
              F.concat(F.lit("Invalid JSON: JSONDecodeError: "), _snippet(F.coalesce(body, F.lit("")))))
        .when(misread & raw_bindings.isNotNull() & ~raw_bindings.startswith("["), F.lit(BAD_FORMAT))
    )
    values = F.transform("_parsed.results.bindings", lambda b: b["obj"]["value"])
    ordered = F.coalesce(
        F.array_distinct(F.filter(values, lambda v: v.isNotNull())), F.array().cast("array<string>")
    )
    checked = read.withColumn("_problem", problem)
    failed = F.col("_problem").isNotNull()
    return checked.withColumns({
        "obj_list": F.when(~failed, ordered),
        "error": F.coalesce("_problem", F.lit("")),
    }).withColumn(
        "obj_values",
        F.when(F.size("obj_list") > 0, F.array_join("obj_list", ";")).when(~failed, F.lit(EMPTY)),
    ).drop("_problem", "_parsed")


def outcome_status(df: DataFrame) -> Column:
    return (
        F.when(F.col("obj_values").isNull(), "error_nan").when(F.col("obj_values") == EMPTY, "empty")
        .otherwise("non_empty")
    )


def outcome_summary(df: DataFrame) -> DataFrame:
    """Rows and percentage per status, plus a ``TOTAL`` row."""
    counts = df.groupBy(outcome_status(df).alias("status")).agg(F.count(F.lit(1)).alias("_n"))
    rolled = counts.rollup("status").agg(F.sum("_n").alias("n"), F.grouping_id().alias("_pooled"))
    # over the four rows of the result; the rows themselves are read once
    total = F.max("n").over(Window.partitionBy(F.lit(0)))
    name = F.when(F.col("_pooled") == 1, "TOTAL").otherwise(F.col("status"))
    return rolled.select(name.alias("status"), "n", F.try_divide(F.col("n") * F.lit(100.0), total).alias("percent"))


def distinct_errors(df: DataFrame) -> DataFrame:
    """Distinct error messages in order.

    The empty one goes after grouping, by an aggregate: a filter on the text itself would be pushed below and repeat the parse.
    """
    found = df.groupBy("error").agg(F.bool_or(F.col("error") != "").alias("_real"))
    return found.where("_real").select("error").orderBy("error")


def changed_count(df: DataFrame, before: str, after: str, by: str = "source") -> DataFrame:
    """Rows and changed rows per source."""
    changed = F.count_if(~F.col(before).eqNullSafe(F.col(after)))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("num_rows"), changed.alias("changed"))
