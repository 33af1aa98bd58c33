"""Topic labels: scoring, top-k, entity lists and lookups of entity topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from .joins import lookup_join

# The topic labels, in order.
LABELS = (
    "Food and Beverage", "Culture", "Media and Entertainment", "Religion and Philosophy", "Sports", "Art",
    "Business and Economic", "Education", "Warfare and Conflict", "Political", "Society",
    "Science and Technology", "Environmental", "Healthcare and Medicine",
)
MIN_ENTITY_CHARS = 3
SCORE_DIGITS = 4

# Cue words of the built-in scorer; replace it with a model through ``score_topics(scorer=...)``.
LEXICON: Mapping[str, Sequence[str]] = {
    "Food and Beverage": ("food", "wine", "restaurant", "recipe", "beer", "cuisine"),
    "Culture": ("culture", "festival", "tradition", "folk", "heritage", "language"),
    "Media and Entertainment": ("film", "album", "song", "series", "television", "episode"),
    "Religion and Philosophy": ("church", "god", "faith", "temple", "bishop", "philosophy"),
    "Sports": ("team", "league", "season", "match", "game", "club"),
    "Art": ("painting", "museum", "sculpture", "gallery", "artist", "design"),
    "Business and Economic": ("company", "market", "bank", "price", "trade", "sales"),
    "Education": ("school", "university", "student", "college", "teacher", "degree"),
    "Warfare and Conflict": ("war", "battle", "army", "navy", "soldier", "weapon"),
    "Political": ("election", "party", "president", "senate", "minister", "vote"),
    "Society": ("population", "family", "community", "people", "city", "women"),
    "Science and Technology": ("science", "software", "engine", "data", "computer", "physics"),
    "Environmental": ("river", "forest", "climate", "species", "mountain", "water"),
    "Healthcare and Medicine": ("hospital", "disease", "doctor", "medicine", "health", "patient"),
}


def label_scores(scores: Sequence[Column], labels: Sequence[str] = LABELS) -> Column:
    """Array of ``(label, score)`` from one score column per label."""
    return F.array(*[
        F.struct(F.lit(label).alias("label"), s.cast("double").alias("score"))
        for label, s in zip(labels, scores, strict=True)
    ])


def lexicon_scores(text: Column, lexicon: Mapping[str, Sequence[str]] = LEXICON) -> Column:
    """Share of the cue words of each label among all cue words of the whole text.

    One membership test per token finds the cue words; labels are counted over those few hits.
    """
    vocabulary = sorted({w for words in lexicon.values() for w in words})
    hits = F.filter(tx.tokens(text), lambda t: t.isin(*vocabulary))

    def share(words: Sequence[str]) -> Column:
        return lambda found: F.coalesce(
            F.try_divide(F.size(F.filter(found, lambda t: t.isin(*words))), F.size(found)), F.lit(0.0)
        )

    # transform over a one-element array binds the hits once for all labels
    bound = F.transform(F.array(hits), lambda found: label_scores(
        [share(words)(found) for words in lexicon.values()], list(lexicon)
    ))
    return F.get(bound, F.lit(0))


def score_topics(
    df: DataFrame,
    text: str,
    labels: Sequence[str] = LABELS,
    scorer: Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[Sequence[float]]]] | None = None,
) -> DataFrame:
    """Add ``scores``, an array of ``(label, score)``.

    ``scorer`` is a factory called once per task; the scorer it returns maps a batch of texts and the labels
    to one score list per text.  Without it the native lexicon scorer is used.
    """
    if scorer is None:
        return df.withColumn("scores", lexicon_scores(F.col(text)))
    names = list(labels)

    @F.pandas_udf("array<double>")
    def batch_scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer()
        for batch in batches:
            yield pd.Series([[float(x) for x in row] for row in score(batch.tolist(), names)])

    return df.withColumn("_raw", batch_scores(F.col(text))).withColumn(
        "scores", label_scores([F.get("_raw", F.lit(i)) for i in range(len(names))], names)
    ).drop("_raw")


def fit_topic_weights(df: DataFrame, text: str, label: str, labels: Sequence[str], smooth: float = 1.0) -> DataFrame:
    """Fitted term weights ``term, weights``: for each label the smoothed log-odds of the term inside it against all others.

    Terms are counted over whole texts with map-side combining; rows without one of ``labels`` are left out.  What is kept
    is one array a term, and the totals are one row.  The test for null, which a join on the term brings along, stands here,
    so that totals and weights are the same shuffle, and texts are counted once.
    """
    names, n = list(labels), len(labels)
    known = df.where(F.col(label).isin(*names)).select(F.col(label).alias("_label"), F.explode(tx.tokens(F.col(text))).alias("term"))
    counts = known.where(F.col("term").isNotNull()).groupBy("term").agg(*[F.count_if(F.col("_label") == name).cast("double").alias(f"_{i}") for i, name in enumerate(names)])
    totals = counts.agg(F.count(F.lit(1)).cast("double").alias("terms"), *[F.sum(f"_{i}").alias(f"n{i}") for i in range(n)])
    total = totals.agg(F.first(F.struct("*"))).scalar()
    mass = F.lit(float(smooth)) * total["terms"]

    def weight(i: int) -> Column:
        inside, others = F.col(f"_{i}"), [j for j in range(n) if j != i]
        outside, size = sum((F.col(f"_{j}") for j in others), F.lit(0.0)), sum((total[f"n{j}"] for j in others), F.lit(0.0))
        return F.ln((inside + smooth) / (total[f"n{i}"] + mass)) - F.ln((outside + smooth) / (size + mass))

    return counts.select("term", F.array(*[weight(i) for i in range(n)]).alias("weights"))


def fitted_scores(df: DataFrame, key: str, text: str, weights: DataFrame, labels: Sequence[str]) -> DataFrame:
    """``key, scores``: for each label the logistic of the mean weight of a text's known terms; 0.5 where it has none.

    ``key`` is unique.  Terms are counted inside the row, and counts per (text, term) are shuffled once, to meet the weights in
    one join on the term; a frequent term is a skewed key of the larger side, which adaptive execution splits.
    """
    n = len(labels)
    terms = df.select(key, F.inline(tx.term_counts(F.col(text)))).withColumnRenamed("n", "_n")
    sums = terms.join(weights, "term").groupBy(key).agg(
        F.sum("_n").alias("_all"), *[F.sum(F.col("_n") * F.get("weights", F.lit(i))).alias(f"_{i}") for i in range(n)])
    means = [F.coalesce(F.col(f"_{i}") / F.col("_all"), F.lit(0.0)) for i in range(n)]
    return df.select(key).join(sums, key, "left").select(key, label_scores([1 / (1 + F.exp(-m)) for m in means], labels).alias("scores"))


def top_labels(scores: Column, k: int = 3, digits: int | None = SCORE_DIGITS) -> Column:
    """The ``k`` best ``(label, score)`` of an array, ties in label order; no shuffle."""
    ranked = F.array_sort(F.transform(
        scores, lambda s, i: F.struct((-s["score"]).alias("neg"), i.alias("at"), s["label"].alias("label"))
    ))

    def entry(r: Column) -> Column:
        score = -r["neg"]
        return F.struct(
            r["label"].alias("label"), (score if digits is None else F.round(score, digits)).alias("score")
        )

    return F.transform(F.slice(ranked, 1, k), entry)


def flatten_top(df: DataFrame, topics: str = "topics", k: int = 3, pad: tuple | None = None) -> DataFrame:
    """Columns ``top_1_topic, top_1_score, ...`` from a topic array; missing ranks are null or ``pad``."""
    out = {}
    for i in range(k):
        topic = F.get(topics, F.lit(i))
        label, score = topic["label"], topic["score"]
        if pad is not None:
            label, score = F.coalesce(label, F.lit(pad[0])), F.coalesce(score, F.lit(pad[1]))
        out[f"top_{i + 1}_topic"], out[f"top_{i + 1}_score"] = label, score
    return df.withColumns(out)


def tag_entities(text: Column) -> Column:
    """Built-in tagger: runs of capitalised words, and numbers, in order of appearance."""
    word = rf"\p{{Lu}}{tx.WORD}*"
    return F.regexp_extract_all(
        text, F.lit(rf"{tx.WORD_START}(?:{word}(?: {word})*|\p{{Nd}}+){tx.WORD_END}"), F.lit(0)
    )


def entities(tagged: Column) -> Column:
    """Distinct entities of at least three characters, first occurrence first."""
    return F.array_distinct(F.filter(tagged, lambda e: F.length(e) >= MIN_ENTITY_CHARS))


def entities_text(found: Column) -> Column:
    return F.array_join(found, ", ")


def lookup_topics(df: DataFrame, key: str, titles: DataFrame, topics: DataFrame) -> DataFrame:
    """Look up the topics of each row through its ``entities``.

    ``titles(entity, title)`` maps entities to page titles, ``topics(title, scores)`` scores a title.  The
    page used is the one of the earliest entity that has a title.  Rows without a title keep null topics.
    Adds ``titles``, ``page`` and ``topics``.
    """
    mentions = df.select(key, F.posexplode("entities").alias("_at", "entity"))
    found = lookup_join(mentions, titles, ["entity"], F.col(key), how="inner")
    pages = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_at", "title"))).alias("_hits")  # bounded by one row's entities
    ).select(key, F.array_distinct(F.transform("_hits", lambda h: h["title"])).alias("titles"))
    scored = lookup_join(
        pages.withColumn("page", F.get("titles", F.lit(0))),
        topics.select(F.col("title").alias("page"), top_labels(F.col("scores")).alias("topics")),
        ["page"], F.col(key),
    )
    return df.join(scored, key, "left")
