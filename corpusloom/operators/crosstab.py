"""Counts, shares, cross-tabs and hierarchies over labelled rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import classify as cl
from ..functions import text as tx

# Section and row names of the question overview.
SECTION_TYPE = "Question Type"
SECTION_SKILL = "Skill"
SECTION_COUNT = "Skills per question"
SKILL_COUNTS = ("One skill", "Two skills", "Three skills")


def value_counts(df: DataFrame, column: str, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """Rows per value, most frequent first; nulls are not counted."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias(name))
    return counts.orderBy(*by, F.desc(name), column)


def with_share(counts: DataFrame, n: str, name: str = "share", scale: float = 1.0) -> DataFrame:
    """Add the share of the total of ``n``; the total is one row, read as a scalar subquery."""
    total = counts.agg(F.sum(n).alias("total")).scalar()
    return counts.withColumn(name, F.try_divide(F.col(n) * F.lit(scale), total))


def mean_by(df: DataFrame, label: str, score: str, name: str = "mean_score") -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.avg(score).alias(name))


def pivot_counts(
    df: DataFrame, row: str, column: str, labels: Sequence[str], total: str | None = "Total"
) -> DataFrame:
    """One row per ``row`` value with a count per label, zeros filled, plus a total row.

    Rows are counted per (row, label) first; the wide table and its total are built from those counts.
    """
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("_n"))
    wide = [F.sum(F.when(F.col(column) == l, F.col("_n")).otherwise(0)).alias(l) for l in labels]
    if total is None:
        return counts.groupBy(row).agg(*wide)
    rolled = counts.rollup(row).agg(*wide, F.grouping_id().alias("_pooled"))
    name = F.when(F.col("_pooled") == 1, total).otherwise(F.col(row))
    return rolled.select(name.alias(row), *[F.col(f"`{l}`") for l in labels])


def _short_decimal(share: Column) -> Column:
    """Four-place decimal text without trailing zeros, at least one decimal kept."""
    digits = F.round(share, 4).cast("decimal(6,4)").cast("string")
    return F.regexp_replace(digits, r"(\.\d+?)0+\z", "$1")


def pivot_display(wide: DataFrame, row: str, labels: Sequence[str], total: str = "Total") -> DataFrame:
    """Text form of :func:`pivot_counts` with ``count (share)`` in the total row."""
    everything = sum((F.col(f"`{l}`") for l in labels), F.lit(0))
    cells = []
    for label in labels:
        n = F.col(f"`{label}`")
        share = _short_decimal(n / everything)
        text = F.when(F.col(row) == total, F.concat(n.cast("string"), F.lit(" ("), share, F.lit(")")))
        cells.append(text.otherwise(n.cast("string")).alias(label))
    return wide.select(row, *cells)


def crosstab(df: DataFrame, column: str, labels: Sequence[str], row: str = "source") -> DataFrame:
    """Cross-tab of fixed labels per source with a ``TOTAL`` row."""
    return pivot_counts(df, row, column, labels, total="TOTAL")


def typed_questions(df: DataFrame) -> DataFrame:
    """Add question type, skills and answer type to ``question, answer`` rows.

    Tokens and the lower-cased text are computed once per row and shared by all rules.
    """
    answer = F.coalesce(F.col("answer"), F.lit(""))
    prepared = df.withColumns({
        "_q": F.lower("question"), "_words": tx.tokens(F.col("question")), "_a_words": tx.tokens(answer),
    }).withColumn("answer_type", cl.answer_type_of(answer, F.col("_a_words")))
    return prepared.select(
        *df.columns,
        cl.question_type_of(F.col("_q"), F.col("_words")).alias("question_type"),
        cl.skills_of(F.col("_q"), F.col("answer_type")).alias("skills"),
        "answer_type",
    )


def _fixed_rows(df: DataFrame, names: Sequence[str], rows: Sequence[Sequence[object]]) -> DataFrame:
    """A small constant frame (report categories)."""
    entries = [
        F.struct(F.lit(i).alias("_line"), *[F.lit(v).alias(n) for n, v in zip(names, row)])
        for i, row in enumerate(rows)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*entries)))


def overview_with_example(typed: DataFrame) -> DataFrame:
    """Percentage per answer type and its first non-blank answer in (source, position) order."""
    answer = tx.strip(F.col("answer"))
    seen = typed.groupBy("answer_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.when(answer != "", answer), F.when(answer != "", F.struct("source", "ord"))).alias("example"),
    )
    shares = with_share(seen, "n", "percent", 100.0)
    rows = _fixed_rows(typed, ["answer_type"], [[t] for t in cl.ANSWER_TYPES])
    return rows.join(shares, "answer_type", "left").select(
        "answer_type",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("percent", F.lit(0.0)).alias("percent"),
        F.coalesce("example", F.lit("")).alias("example"),
    )


def overview(typed: DataFrame) -> DataFrame:
    """Counts and percentages of question types, skills and skills per question, in one pass.

    Percentages are over questions, so the skill section can add up to more than 100.
    """
    def entry(section: str, label: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), label.alias("label"))

    skill_count = F.get(F.array(*map(F.lit, SKILL_COUNTS)), F.size("skills") - 1)
    entries = F.concat(
        F.array(entry(SECTION_TYPE, F.col("question_type")), entry(SECTION_COUNT, skill_count)),
        F.transform("skills", lambda s: entry(SECTION_SKILL, s)),
    )
    seen = typed.select(F.inline(entries)).groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"))
    lines = (
        [(SECTION_TYPE, t) for t in cl.QUESTION_TYPES]
        + [(SECTION_SKILL, s) for s in cl.SKILLS]
        + [(SECTION_COUNT, c) for c in SKILL_COUNTS]
    )
    rows = _fixed_rows(typed, ["section", "label"], lines).join(seen, ["section", "label"], "left")
    n = F.coalesce("n", F.lit(0))
    # The window spans the fixed report lines only.
    questions = F.sum(F.when(F.col("section") == SECTION_TYPE, n)).over(Window.partitionBy(F.lit(0)))
    return rows.select(
        F.col("_line").alias("line_no"), "section", "label", n.alias("n"),
        F.try_divide(n * F.lit(100.0), questions).alias("percent"),
    )


def skill_crosstab(typed: DataFrame, row: str = "source") -> DataFrame:
    """Cross-tab of skills; a question counts once for each of its skills."""
    return crosstab(typed.select(row, F.explode("skills").alias("skill")), "skill", cl.SKILLS, row)


def skill_histogram(typed: DataFrame) -> DataFrame:
    """Questions by number of skills, with their percentage."""
    counts = typed.groupBy(F.size("skills").alias("num_skills")).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n", "percent", 100.0)


def phrase_hierarchy(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Counts of the one, two and three word levels of question phrases, with parent and path.

    Phrases are counted first, so only distinct phrases are expanded into levels.
    """
    words = F.split(phrase, " ")
    paths = F.transform(
        F.sequence(F.lit(1), F.least(F.size(words), F.lit(3))), lambda k: F.slice(words, F.lit(1), k)
    )
    levels = (
        phrases.groupBy(phrase).agg(F.count(F.lit(1)).alias("_n"))
        .select(F.explode(paths).alias("_path"), "_n")
        .groupBy("_path").agg(F.sum("_n").alias("count"))
    )
    parent = F.slice("_path", F.lit(1), F.size("_path") - 1)
    return levels.select(
        F.element_at("_path", -1).alias("label"),
        "count",
        F.array_join(parent, "/").alias("parent"),
        F.array_join("_path", "/").alias("id"),
    ).orderBy(F.desc("count"), "id")
