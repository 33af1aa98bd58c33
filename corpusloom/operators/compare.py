"""Comparison of two topic predictors: agreement, overlap, correlation and rank similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import kept
from .ordering import average_ranks

TOP = 3
_NULL_TOPIC = "\x00"


def align_predictions(a: DataFrame, b: DataFrame, key: str, on_duplicate: str = "raise") -> DataFrame:
    """Pair two prediction frames ``(key, topics)`` one to one as ``key, topics_a, topics_b``; keys of one side only are left out.

    The rows of both sides meet in one shuffle, which gives the pairs and how often each side holds a key, so a key that holds
    most rows is merged before it is sent.  ``on_duplicate``: ``raise`` stops the job and names the key, ``skip`` leaves out
    the keys that :func:`alignment_audit` reports.  Null keys pair with nothing.
    """
    counted = _both_sides(a, b, key)
    told = F.concat(F.lit(f"{key} is not unique: "), F.col(f"`{key}`").cast("string"))
    repeated = F.raise_error(told).cast("boolean") if on_duplicate == "raise" else F.lit(False)
    # one expression, so that no part of it is tested before the others
    paired = F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), repeated).otherwise((F.col("n_a") == 1) & (F.col("n_b") == 1))
    return counted.where(paired).select(
        key, F.col("first_a.topics").alias("topics_a"), F.col("first_b.topics").alias("topics_b")
    )


def alignment_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that :func:`align_predictions` can't pair one to one: ``key, n_a, n_b, problem``, nulls included."""
    problem = (
        F.when(F.col(f"`{key}`").isNull(), "null").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated")
        .when(F.col("n_b") == 0, "only in a").when(F.col("n_a") == 0, "only in b")
    )
    return _both_sides(a, b, key, nulls=True).select(key, "n_a", "n_b", problem.alias("problem")).where("problem IS NOT NULL")


def _both_sides(a: DataFrame, b: DataFrame, key: str, nulls: bool = False) -> DataFrame:
    """Per key, how many rows each side has and one of them."""
    sides = a.select(key, F.col("topics"), F.lit(0).alias("_side")).unionByName(b.select(key, F.col("topics"), F.lit(1).alias("_side")))
    rows = sides if nulls else sides.where(F.col(f"`{key}`").isNotNull())

    def of(side: int, name: str) -> list[Column]:
        mine = F.col("_side") == side
        one = F.first(F.when(mine, F.struct("topics")), ignorenulls=True)  # a struct, as the topics may be null themselves
        return [F.count_if(mine).alias(f"n_{name}"), one.alias(f"first_{name}")]

    return rows.groupBy(key).agg(*of(0, "a"), *of(1, "b"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that break the one-to-one pairing of :func:`align_predictions`."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def select_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


def _labels(topics: Column) -> Column:
    return F.transform(topics, lambda t: t["label"])


def _top(topics: Column) -> Column:
    return F.get(topics, F.lit(0))


def _same_top(a: Column, b: Column) -> Column:
    return F.coalesce(_top(a)["label"] == _top(b)["label"], F.lit(False))


def agreement(a: str = "topics_a", b: str = "topics_b") -> Column:
    """Aggregate: share of rows whose best topics agree; a missing topic never agrees."""
    return F.avg(_same_top(F.col(a), F.col(b)).cast("double"))


def overlap(a: str = "topics_a", b: str = "topics_b") -> Column:
    """Aggregate: share of rows whose topic sets have a topic in common."""
    shared = F.arrays_overlap(F.array_compact(_labels(F.col(a))), F.array_compact(_labels(F.col(b))))
    return F.avg(F.coalesce(shared, F.lit(False)).cast("double"))


def pearson(x: Column, y: Column, strict: bool = False) -> Column:
    """Aggregate: correlation over complete pairs; ``strict`` gives null when any pair is incomplete."""
    complete = x.isNotNull() & y.isNotNull()
    x, y = F.when(complete, x), F.when(complete, y)
    # not corr(): that fails in ANSI mode when one side is constant
    value = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.bool_and(complete), value) if strict else value


def score_pairs(df: DataFrame, a: str = "topics_a", b: str = "topics_b") -> DataFrame:
    """Best scores of both sides as ``score_a, score_b``, complete pairs only."""
    pairs = df.select(_top(F.col(a))["score"].alias("score_a"), _top(F.col(b))["score"].alias("score_b"))
    return pairs.where(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())


def spearman(pairs: DataFrame, x: str = "score_a", y: str = "score_b", name: str = "spearman") -> DataFrame:
    """Rank correlation with average ranks for ties.

    Distinct values are ranked in blocks.  Ranks of ``y`` are looked up for the distinct value pairs, summed
    per ``x``, and only then meet the ranks of ``x``, so a frequent ``x`` is one row in the second join.
    """
    n, rx, ry = F.col("_n"), F.col("_rx"), F.col("_ry")
    per_x = (
        pairs.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n"))
        .join(average_ranks(pairs, y, "_ry"), y)
        .groupBy(x).agg(
            F.sum(n).alias("_n"), F.sum(n * ry).alias("_sum_y"), F.sum(n * ry * ry).alias("_sum_yy")
        )
    )
    total = F.sum(n)
    sums = per_x.join(average_ranks(pairs, x, "_rx"), x).agg(
        total.alias("n"),
        F.sum(rx * F.col("_sum_y")).alias("xy"), F.sum(n * rx * rx).alias("xx"), F.sum("_sum_yy").alias("yy"),
        ((total + 1) / 2.0).alias("m"),  # the mean of 1..n, with or without ties
    )
    centred = F.col("n") * F.col("m") * F.col("m")
    return sums.select(F.try_divide(
        F.col("xy") - centred, F.sqrt((F.col("xx") - centred) * (F.col("yy") - centred))
    ).alias(name))


def kendall_row(a: Column, b: Column, compat: bool = False) -> Column:
    """Kendall's tau-b over the union of two ranked lists; an absent topic ranks behind the last place of the longer one.

    Missing topics are left out, and a row with no comparable pair gives null.  ``compat=True`` treats
    missing topics as one more topic instead.
    """
    left, right = _labels(a), _labels(b)
    if compat:
        def keep(t: Column) -> Column:
            return F.coalesce(t, F.lit(_NULL_TOPIC))
        left, right = F.transform(left, keep), F.transform(right, keep)
    names = F.array_compact(F.array_union(left, right))

    places = F.greatest(F.size(left), F.size(right))

    def rank(ranking: Column, topic: Column) -> Column:
        # a repeated topic counts at its last place; array_position gives 0 for an absent topic
        behind = F.array_position(F.reverse(ranking), topic)
        return F.when(behind > 0, F.size(ranking) + 1 - behind).otherwise(places + 1)

    ranks = F.transform(names, lambda t: F.struct(rank(left, t).alias("a"), rank(right, t).alias("b")))

    def against_later(r: Column, i: Column) -> Column:
        return F.transform(F.slice(ranks, i + 2, F.size(ranks)), lambda s: F.struct(
            F.signum(r["a"] - s["a"]).alias("a"), F.signum(r["b"] - s["b"]).alias("b")
        ))

    pairs = F.flatten(F.transform(ranks, against_later))

    def total(term) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + term(p))

    untied_a, untied_b = total(lambda p: F.abs(p["a"])), total(lambda p: F.abs(p["b"]))
    score = F.try_divide(total(lambda p: p["a"] * p["b"]), F.sqrt(untied_a * untied_b))
    if compat:
        return score
    missing = (F.size(F.array_compact(left)) == 0) | (F.size(F.array_compact(right)) == 0)
    return F.when(~missing, score)


def kendall(a: str = "topics_a", b: str = "topics_b", compat: bool = False) -> Column:
    """Aggregate: mean of :func:`kendall_row`."""
    return F.avg(kendall_row(F.col(a), F.col(b), compat))


def comparison(df: DataFrame) -> DataFrame:
    """Metric rows of a predictor comparison: ``line_no, metric, value``.

    ``df`` is read twice: for the plain aggregates, and for the two score columns, which are written once, as the ranks
    behind the Spearman correlation read them again for cut points, blocks and pairs.
    """
    one = df.agg(
        agreement().alias("agreement"),
        overlap().alias("overlap"),
        pearson(_top(F.col("topics_a"))["score"], _top(F.col("topics_b"))["score"]).alias("pearson"),
        kendall().alias("kendall"),
    ).withColumn("spearman", spearman(kept(score_pairs(df), "scores")).scalar())
    # Metric names of the comparison report, in order.
    lines = [
        ("Top 1 Topic Agreement Rate", "agreement"), ("Top 3 Topic Overlap Rate", "overlap"),
        ("Pearson Correlation of Top 1 Scores", "pearson"),
        ("Spearman Correlation of Top 1 Scores", "spearman"), ("Average Kendall’s Tau", "kendall"),
    ]
    entries = [
        F.struct(F.lit(i + 1).alias("line_no"), F.lit(text).alias("metric"), F.col(c).alias("value"))
        for i, (text, c) in enumerate(lines)
    ]
    return one.select(F.inline(F.array(*entries)))


def disagreements(df: DataFrame, a: str = "topics_a", b: str = "topics_b") -> DataFrame:
    """Rows whose best topics differ, with the score difference per rank (a - b)."""
    gaps = {
        f"score_diff_{i + 1}": F.get(F.col(a), F.lit(i))["score"] - F.get(F.col(b), F.lit(i))["score"]
        for i in range(TOP)
    }
    return df.where(~_same_top(F.col(a), F.col(b))).withColumns(gaps)


def topic_counts(df: DataFrame, sides: dict[str, str], ranks: int = TOP, name: str = "n") -> DataFrame:
    """Rows per predictor, 1-based rank and topic, in one pass; ``sides`` names the topic column of each predictor.

    Missing topics are not counted.
    """
    entries = F.array(*[
        F.struct(F.lit(side).alias("predictor"), F.lit(i + 1).alias("rank"), F.get(F.col(c), F.lit(i))["label"].alias("topic"))
        for side, c in sides.items() for i in range(ranks)
    ])
    return (
        df.select(F.inline(entries)).where(F.col("topic").isNotNull())
        .groupBy("predictor", "rank", "topic").agg(F.count(F.lit(1)).alias(name))
    )
