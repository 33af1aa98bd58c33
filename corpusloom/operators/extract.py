"""Extraction: from raw examples to question/answer pairs, tables and typed answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx

# Which source names use which question wrapper or table lead-in.
HIGHLIGHTED = "fetaqa"
WRAPPED = "hybridqa"
CAPTIONED = "hitab"
# Keys under which an object output may hold its answer, in order of preference.
ANSWER_KEYS = ("answer", "final_answer", "prediction", "result")


def source_is(tag: str) -> Column:
    return F.lower(F.col("source")).contains(tag)


def dispatch(rules: Sequence[tuple[str, Column]], default: Column) -> Column:
    """First expression whose tag occurs in the source name, else ``default``."""
    out = None
    for tag, value in rules:
        out = F.when(source_is(tag), value) if out is None else out.when(source_is(tag), value)
    return default if out is None else out.otherwise(default)


def unwrap_question(question: Column) -> Column:
    """Question text taken out of the wrapper its source uses; null when the wrapper is missing."""
    return dispatch(
        [
            (HIGHLIGHTED, tx.question_after(question, tx.HIGHLIGHT_MARK)),
            (WRAPPED, tx.question_after(question, tx.QUESTION_MARK)),
        ],
        tx.strip(question),
    )


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows whose text columns are all present and not blank."""
    keep = F.lit(True)
    for name in columns:
        keep = keep & (F.coalesce(tx.strip(F.col(name)), F.lit("")) != "")
    return df.where(keep)


def output_text(df: DataFrame, column: str = "output") -> Column:
    """Output as text; null where a ``VARIANT`` output holds anything else."""
    c = F.col(column)
    if not isinstance(df.schema[column].dataType, T.VariantType):
        return c
    return F.when(F.schema_of_variant(c) == "STRING", F.variant_get(c, "$", "string"))


def extract_qa(df: DataFrame) -> DataFrame:
    """Question/answer pairs without double quotes; incomplete pairs are dropped."""
    pairs = df.select(
        "source", "ord",
        tx.drop_quotes(unwrap_question(F.col("question"))).alias("question"),
        tx.drop_quotes(tx.strip(output_text(df))).alias("answer"),
    )
    return pairs.where((F.col("question") != "") & (F.col("answer") != ""))


def _wrap(c: Column, template: str) -> Column:
    """Put a non-empty text into a template (``$1``); '' stays ''.  The text occurs once in the plan."""
    return F.regexp_replace(c, r"(?s)\A(.+)\z", template)


def _join_known(separator: str, *parts: Column) -> Column:
    return F.array_join(F.array_remove(F.array(*parts), ""), separator)


def table_with_prefix(input_seg: Column) -> Column:
    """Raw table behind a bracketed prefix with its titles or caption, by source."""
    lead = dispatch(
        [
            (HIGHLIGHTED, _join_known(
                "; ",
                _wrap(tx.page_title(input_seg), "Wikipedia page title:$1"),
                _wrap(tx.section_title(input_seg), "Wikipedia section title:$1"),
            )),
            (CAPTIONED, _wrap(tx.caption(input_seg), "Table caption:$1")),
        ],
        F.lit(""),
    )
    return _join_known(" ", _wrap(lead, "[$1; ]"), tx.raw_table(input_seg))


def extract_tqa(df: DataFrame) -> DataFrame:
    """Rows ``question, answer, table`` with normalised text and the prefixed raw table."""
    question, answer = unwrap_question(F.col("question")), output_text(df)
    return df.where(tx.has_text(question) & tx.has_text(answer)).select(
        "source", "ord",
        tx.sanitize(question).alias("question"),
        tx.sanitize(answer).alias("answer"),
        table_with_prefix(F.col("input_seg")).alias("table"),
    )


def spaced_json(text: Column) -> Column:
    """JSON text with a blank after each comma and colon outside strings, and none elsewhere; keys keep their order."""
    string = r'"(?:[^"\\]|\\.)*+"'
    dense = F.regexp_replace(text, rf'({string})|\s+', "$1")
    return F.regexp_replace(dense, rf'\G(?:{string}|[^",:])++[,:]', "$0 ")


def answer_of(output: Column, text: Column | None = None) -> Column:
    """Answer text of a polymorphic ``VARIANT`` output.

    Text is trimmed; an object gives its first text answer key, a list its first text item; anything else
    becomes JSON with a blank after commas and colons.  ``text`` is the JSON that ``output`` was parsed from; it keeps the
    order of keys, which a ``VARIANT`` alone has lost.
    """
    shape = F.coalesce(F.schema_of_variant(output), F.lit("MISSING"))
    json_text = tx.collapse_ws(spaced_json(F.to_json(output) if text is None else text))

    def text_at(path: str) -> Column:
        part = F.variant_get(output, path, "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.variant_get(output, path, "string"))

    by_key = F.coalesce(*[tx.strip(text_at(f"$.{key}")) for key in ANSWER_KEYS], json_text)
    return (
        F.when(shape == "MISSING", "")
        .when(shape == "STRING", tx.strip(F.variant_get(output, "$", "string")))
        .when(shape.startswith("OBJECT"), by_key)
        .when(shape.startswith("ARRAY"), F.coalesce(tx.strip(text_at("$[0]")), json_text))
        .when(shape == "BOOLEAN", F.initcap(json_text))
        .when(shape == "VOID", "None")
        .otherwise(json_text)
    )


def answer_text(df: DataFrame, column: str) -> Column:
    """Answer of ``column`` whether it is read as text or as ``VARIANT``."""
    if isinstance(df.schema[column].dataType, T.VariantType):
        return answer_of(F.col(column))
    return F.coalesce(tx.strip(F.col(column)), F.lit(""))


def require_columns(df: DataFrame, columns: Sequence[str], on_missing: str = "raise") -> DataFrame | None:
    """Check the columns of a frame: ``raise``, ``skip`` (returns None) or ``fill`` with nulls."""
    missing = [c for c in columns if c not in df.columns]
    if not missing:
        return df
    if on_missing == "skip":
        return None
    if on_missing == "fill":
        return df.withColumns({c: F.lit(None).cast("string") for c in missing})
    raise ValueError(f"missing columns: {', '.join(missing)}")


def align(df: DataFrame, schema: T.StructType, fill: dict[str, object] | None = None) -> DataFrame:
    """Trim header names, add missing columns (null or ``fill``), and fix order and types."""
    trimmed = df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})
    fill = fill or {}
    have = set(trimmed.columns)
    return trimmed.select(*[
        (F.col(f.name) if f.name in have else F.lit(fill.get(f.name))).cast(f.dataType).alias(f.name)
        for f in schema
    ])
