"""Registered queries: every operator bound to the corpus views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import classify as cl
from ..functions import text as tx
from ..operators import compare, crosstab, extract, grouping, ordering, outcomes, relatedness, repair, sampling, slicing, tagger, topics
from ..sources import arrays, readers, reports, writers
from ..sources.shared import shared_path
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LANGS = ("de", "en", "es", "fr")
QUOTAS = {"src0": 15, "src1": 15}
SLICE_LIMIT, TIGHT_LIMIT = 30_000, 900
SEGMENT_LIMIT, SEGMENT_BLOCK = 1_500, 8_000
# Cue words that occur in the invented prose, three per topic label.
PROSE_LEXICON = dict(zip(topics.LABELS, (
    ("the", "thing", "whed"), ("and", "ing", "ned"), ("of", "re", "ha"), ("that", "with", "was"),
    ("la", "le", "les"), ("en", "de", "du"), ("une", "un", "ou"), ("que", "qui", "eau"),
    ("der", "die", "das"), ("und", "ein", "eine"), ("ist", "zu", "ver"), ("el", "los", "las"),
    ("y", "por", "con"), ("it", "is", "in"),
)))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _six(c: Column | str) -> Column:
    """Six digits: averages over shuffled rows differ in the last bits."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    return crosstab.typed_questions(v.qa(spark, sf).select("source", "ord", "question", "answer"))


# --- extraction and cleaning --------------------------------------------------------------------------


@query
def extract_qa(spark, sf):
    return extract.extract_qa(v.examples(spark, sf))


@query
def extract_tqa(spark, sf):
    return extract.extract_tqa(v.examples(spark, sf))


@query
def clean_segment_v1(spark, sf):
    seg = F.col("input_seg")
    return v.examples(spark, sf).select(
        "ord", tx.clean_segment(seg, 1).alias("cleaned"), tx.clean_segment(seg, 1, True).alias("cleaned_compat")
    )


@query
def clean_segment_v2(spark, sf):
    seg = F.col("input_seg")
    return v.examples(spark, sf).select(
        "ord", tx.clean_segment(seg, 2).alias("cleaned"), tx.clean_segment(seg, 2, True).alias("cleaned_compat")
    )


@query
def clean_caption(spark, sf):
    seg = F.col("input_seg")
    return v.examples(spark, sf).select(
        "ord", tx.clean_caption(seg).alias("caption"), tx.table_key(seg).alias("table_key")
    )


@query
def clean_claim(spark, sf):
    return v.claims(spark, sf).select("ord", tx.clean_claim(F.col("question")).alias("claim"))


@query
def strip_punct(spark, sf):
    text = F.col("text")
    return v.table(spark, sf, "documents").select(
        "doc_id", tx.strip_punct(text).alias("plain"), tx.collapse_ws(text).alias("collapsed"),
        F.size(tx.tokens(text)).cast("bigint").alias("num_tokens"),
    )


@query
def sanitize_pages(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", tx.sanitize(F.col("html")).alias("clean_html"))


@query
def table_prefix(spark, sf):
    seg = F.col("input_seg")
    return v.examples(spark, sf).select(
        "ord", tx.page_title(seg).alias("page_title"), tx.section_title(seg).alias("section_title"),
        tx.caption(seg).alias("caption"), tx.raw_table(seg).alias("raw_table"),
        extract.table_with_prefix(seg).alias("table"),
    )


@query
def question_prompts(spark, sf):
    # Fixed value: the instruction.
    return v.qa(spark, sf).select("ord", tx.prompt(F.col("question"), "Create SPARQL Query: ").alias("prompt"))


@query
def answer_shape(spark, sf):
    return v.output_shapes(spark, sf).select(
        "event_id", extract.answer_of(F.try_parse_json(F.col("output")), F.col("output")).alias("answer")
    )


@query
def complete_rows(spark, sf):
    turns = v.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.translate("text", "\n", "").alias("text")
    )
    return extract.drop_incomplete(turns, ["text"])


# --- classification -----------------------------------------------------------------------------------


@query
def question_phrase(spark, sf):
    return v.qa(spark, sf).select("ord", cl.question_phrase(F.col("question")).alias("phrase"))


@query
def phrase_hierarchy(spark, sf):
    return crosstab.phrase_hierarchy(
        v.qa(spark, sf).select(cl.question_phrase(F.col("question")).alias("phrase"))
    )


@query
def answer_type(spark, sf):
    return v.qa(spark, sf).select("ord", cl.answer_type(F.col("answer")).alias("answer_type"))


@query
def question_type(spark, sf):
    return v.qa(spark, sf).select("ord", cl.question_type(F.col("question")).alias("question_type"))


@query
def skills(spark, sf):
    return v.qa(spark, sf).select(
        "ord", cl.skills_text(cl.skills(F.col("question"), F.col("answer"))).alias("skills")
    )


@query
def typed_questions(spark, sf):
    return _typed(spark, sf).withColumn("skills", cl.skills_text(F.col("skills")))


@query
def document_question_types(spark, sf):
    """Classification of whole documents as questions: long texts, every language."""
    docs = v.table(spark, sf, "documents").select(
        "source", F.col("doc_id").alias("ord"), F.col("text").alias("question"), F.col("text").alias("answer")
    )
    typed = crosstab.typed_questions(docs)
    return typed.select(
        F.col("ord").alias("doc_id"), "question_type", cl.skills_text(F.col("skills")).alias("skills"), "answer_type"
    )


@query
def question_type_per_source(spark, sf):
    return crosstab.crosstab(_typed(spark, sf), "question_type", cl.QUESTION_TYPES)


@query
def answer_type_per_source(spark, sf):
    return crosstab.crosstab(_typed(spark, sf), "answer_type", cl.ANSWER_TYPES)


@query
def skills_per_source(spark, sf):
    return crosstab.skill_crosstab(_typed(spark, sf))


@query
def type_overview(spark, sf):
    return crosstab.overview(_typed(spark, sf)).withColumn("percent", _six("percent"))


@query
def answer_overview(spark, sf):
    return crosstab.overview_with_example(_typed(spark, sf)).withColumn("percent", _six("percent"))


@query
def skill_histogram(spark, sf):
    return crosstab.skill_histogram(_typed(spark, sf)).withColumn("percent", _six("percent"))


# --- grouping -----------------------------------------------------------------------------------------


@query
def group_claims(spark, sf):
    return grouping.group_claims(v.claims(spark, sf))


@query
def group_qa(spark, sf):
    return grouping.group_qa_by_table(extract.extract_tqa(v.examples(spark, sf)))


@query
def group_qa_segments(spark, sf):
    """The same groups with a small segment size, so that large groups come in several rows."""
    return grouping.group_qa_by_table(
        extract.extract_tqa(v.examples(spark, sf)), segment_bytes=SEGMENT_LIMIT, block_rows=SEGMENT_BLOCK
    )


def _clean_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.examples(spark, sf)
    return grouping.group_qa_clean(rows.withColumn("question", extract.unwrap_question(F.col("question"))))


@query
def group_qa_clean(spark, sf):
    return _clean_groups(spark, sf)


def _six_stats(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _six(n) for n in names})


@query
def group_size_stats(spark, sf):
    stats = grouping.group_size_stats(extract.extract_tqa(v.examples(spark, sf)))
    return _six_stats(stats, "mean", "median", "stdev")


# --- labels -------------------------------------------------------------------------------------------


@query
def label_summary(spark, sf):
    return crosstab.value_counts(v.table(spark, sf, "events"), "event_type")


@query
def label_shares(spark, sf):
    counts = crosstab.value_counts(v.table(spark, sf, "events"), "event_type")
    return crosstab.with_share(counts, "n", "percent", 100.0).withColumn("percent", _six("percent"))


@query
def label_mean_score(spark, sf):
    return crosstab.mean_by(v.table(spark, sf, "events"), "event_type", "value").withColumn(
        "mean_score", _six("mean_score")
    )


@query
def domain_pivot(spark, sf):
    return crosstab.pivot_counts(v.table(spark, sf, "documents"), "source", "lang", LANGS)


@query
def domain_pivot_display(spark, sf):
    wide = crosstab.pivot_counts(v.table(spark, sf, "documents"), "source", "lang", LANGS)
    return crosstab.pivot_display(wide, "source", LANGS)


def _document_topics(spark: SparkSession, sf: str) -> DataFrame:
    docs = v.table(spark, sf, "documents").select("doc_id", "source", "text")
    scored = docs.withColumn("scores", topics.lexicon_scores(F.col("text"), PROSE_LEXICON))
    return scored.withColumn("topics", topics.top_labels(F.col("scores")))


@query
def document_topics(spark, sf):
    return topics.flatten_top(_document_topics(spark, sf), pad=("N/A", 0.0)).drop("text", "scores", "topics")


@query
def topic_pivot(spark, sf):
    rows = _document_topics(spark, sf).select("source", F.get("topics", F.lit(0))["label"].alias("topic"))
    return crosstab.pivot_counts(rows, "source", "topic", topics.LABELS)


def letter_scorer():
    """Stand-in for a model: share of one letter per label in the whole text."""
    def score(texts, labels):
        letters = "abcdefghijklmnopqrstuvwxyz"[: len(labels)]
        return [[t.lower().count(c) / max(len(t), 1) for c in letters] for t in texts]
    return score


def letter_embedder():
    """Stand-in for an embedding model: letter counts of the whole text."""
    def encode(texts):
        return [[t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
    return encode


@query
def plugged_topics(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    scored = topics.score_topics(docs, "text", scorer=letter_scorer)
    flat = topics.flatten_top(scored.withColumn("topics", topics.top_labels(F.col("scores"))))
    return flat.drop("text", "scores", "topics")


@query
def document_entities(spark, sf):
    found = topics.entities(topics.tag_entities(F.col("text")))
    return v.table(spark, sf, "documents").select("doc_id", topics.entities_text(found).alias("entities"))


@query
def entity_topics(spark, sf):
    """Documents looked up through entities: pages are benchmark items, their topics embedding scores."""
    docs = v.table(spark, sf, "documents").select(
        "doc_id", topics.entities(topics.tag_entities(F.col("text"))).alias("entities")
    )
    items = v.table(spark, sf, "benchmark").select(
        "item_id", F.explode(topics.entities(topics.tag_entities(F.col("text")))).alias("entity")
    )
    titles = items.groupBy("entity").agg(F.concat(F.lit("item "), F.min("item_id")).alias("title"))
    scored = v.score_lists(spark, sf).select(
        F.concat(F.lit("item "), "vec_id").alias("title"), F.col("scores_a").alias("scores")
    )
    found = topics.flatten_top(topics.lookup_topics(docs, "doc_id", titles, scored))
    return found.select(
        "doc_id", F.size("entities").cast("bigint").alias("num_entities"),
        F.array_join("titles", ", ").alias("titles"), "page",
        *[f"top_{i}_{part}" for i in (1, 2, 3) for part in ("topic", "score")],
    )


@query
def title_entities(spark, sf):
    """Titles found in documents by a dictionary: the capitalised runs of the benchmark items, longest match first."""
    items = v.table(spark, sf, "benchmark").select(F.explode(topics.entities(topics.tag_entities(F.col("text")))).alias("title"))
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    found = tagger.dictionary_entities(docs, "text", items)
    return found.select("doc_id", F.size("entities").cast("bigint").alias("num_entities"), topics.entities_text(F.col("entities")).alias("entities"))


@query
def fitted_topics(spark, sf):
    """Documents scored by term weights fitted on their languages."""
    docs = v.table(spark, sf, "documents").select("doc_id", "text", "lang")
    weights = topics.fit_topic_weights(docs, "text", "lang", LANGS)
    ranked = topics.fitted_scores(docs, "doc_id", "text", weights, LANGS).withColumn("topics", topics.top_labels(F.col("scores"), len(LANGS), 6))
    return topics.flatten_top(ranked, k=len(LANGS)).drop("scores", "topics")


# --- predictor comparison -----------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    lists = v.score_lists(spark, sf)
    a = lists.select("vec_id", topics.top_labels(F.col("scores_a")).alias("topics"))
    b = lists.select("vec_id", topics.top_labels(F.col("scores_b")).alias("topics"))
    return compare.align_predictions(a, b, "vec_id")


@query
def top3_labels(spark, sf):
    ranked = v.score_lists(spark, sf).withColumn("topics", topics.top_labels(F.col("scores_a")))
    return topics.flatten_top(ranked).drop("scores_a", "scores_b", "topics")


@query
def alignment_audit(spark, sf):
    """Keys of two predictors that don't pair one to one: the second lacks one label and repeats another."""
    rows = v.table(spark, sf, "embeddings").select("vec_id", "label", F.array(F.struct("label")).alias("topics"))
    second = rows.where("label <> 3").unionByName(rows.where("label = 5"))
    return compare.alignment_audit(rows, second, "vec_id")


@query
def topic_agreement(spark, sf):
    return _predictions(spark, sf).agg(_six(compare.agreement()).alias("agreement"))


@query
def topic_overlap(spark, sf):
    return _predictions(spark, sf).agg(_six(compare.overlap()).alias("overlap"))


@query
def score_pearson(spark, sf):
    pairs = compare.score_pairs(_predictions(spark, sf))
    return pairs.agg(_six(compare.pearson(F.col("score_a"), F.col("score_b"))).alias("pearson"))


@query
def score_spearman(spark, sf):
    pairs = compare.score_pairs(_predictions(spark, sf))
    return compare.spearman(pairs).select(_six("spearman").alias("spearman"))


@query
def kendall_rows(spark, sf):
    tau = compare.kendall_row(F.col("topics_a"), F.col("topics_b"))
    return _predictions(spark, sf).select("vec_id", _six(tau).alias("tau"))


@query
def kendall_mean(spark, sf):
    return _predictions(spark, sf).agg(_six(compare.kendall()).alias("kendall"))


@query
def comparison_report(spark, sf):
    return compare.comparison(_predictions(spark, sf)).withColumn("value", F.round("value", 4))


@query
def disagreements(spark, sf):
    return compare.disagreements(_predictions(spark, sf)).select(
        "vec_id",
        F.get("topics_a", F.lit(0))["label"].alias("topic_a"), F.get("topics_b", F.lit(0))["label"].alias("topic_b"),
        *[_six(f"score_diff_{i}").alias(f"score_diff_{i}") for i in (1, 2, 3)],
    )


@query
def disagreeing_vectors(spark, sf):
    keys = compare.disagreements(_predictions(spark, sf))
    return compare.select_rows(v.table(spark, sf, "embeddings"), keys, "vec_id").select("vec_id", "label")


@query
def topic_counts(spark, sf):
    return compare.topic_counts(_predictions(spark, sf), {"a": "topics_a", "b": "topics_b"})


# --- relatedness --------------------------------------------------------------------------------------


@query
def relatedness_vectors(spark, sf):
    return v.similarities(spark, sf)


def _next_relatedness(docs: DataFrame) -> DataFrame:
    """Term cosine of each document and the next one that exists (of the last and the first), over the whole texts."""
    pairs = ordering.with_next(docs, "doc_id", ["text"])
    score = relatedness.text_relatedness(F.col("text"), F.col("next_text"))
    return pairs.select("doc_id", _six(score).alias("similarity_score"))


@query
def relatedness_text(spark, sf):
    return _next_relatedness(v.table(spark, sf, "documents").select("doc_id", "text"))


@query
def relatedness_text_english(spark, sf):
    """Over the documents of one language, whose ids have gaps."""
    return _next_relatedness(v.table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "text"))


@query
def relatedness_vectors_labels(spark, sf):
    """Over the vectors of some labels, whose ids have gaps."""
    return v.similarities(spark, sf, v.table(spark, sf, "embeddings").where("label IN (1, 4, 6)"))


@query
def relatedness_questions(spark, sf):
    texts = relatedness.question_table_texts(v.examples(spark, sf))
    scored = relatedness.token_relatedness(
        texts, ["source", "ord"], F.col("table_text"), F.col("question_text")
    )
    return scored.withColumn("similarity_score", _six("similarity_score"))


@query
def relatedness_groups(spark, sf):
    """Table text against the text of all its pairs; the segments of a large group add up."""
    return _group_scores(spark, sf).where("segment = 0").select("source", "table", "similarity_score")


@query
def relatedness_embedded(spark, sf):
    """Question and answer texts compared through a plugged embedder."""
    pairs = v.qa(spark, sf).select("source", "ord", "question", "answer")
    scored = relatedness.embedding_relatedness(pairs, F.col("question"), F.col("answer"), letter_embedder)
    return scored.select("source", "ord", _six("similarity_score").alias("similarity_score"))


@query
def similarity_sorted(spark, sf):
    return relatedness.sort_within(v.similarities(spark, sf))


@query
def similarity_summary(spark, sf):
    return _six_stats(
        relatedness.score_summary(v.similarities(spark, sf)), "mean", "median", "std", "min", "max"
    )


@query
def box_stats(spark, sf):
    return _six_stats(
        relatedness.box_stats(v.similarities(spark, sf)), "q1", "median", "q3", "whisker_low", "whisker_high"
    )


@query
def event_value_box(spark, sf):
    """Box statistics of event values: a long tail beyond the upper whisker."""
    rows = v.table(spark, sf, "events").select(F.col("event_type").alias("source"), "value")
    return _six_stats(relatedness.box_stats(rows, x="value"), "q1", "median", "q3", "whisker_low", "whisker_high")


@query
def similarity_series(spark, sf):
    return relatedness.similarity_series(v.similarities(spark, sf))


@query
def lowest_100(spark, sf):
    return relatedness.lowest_k(v.similarities(spark, sf))


@query
def lowest_shares(spark, sf):
    counts = crosstab.value_counts(relatedness.lowest_k(v.similarities(spark, sf)), "source")
    return crosstab.with_share(counts, "n", "percent", 100.0).withColumn("percent", _six("percent"))


# --- sampling and slicing -----------------------------------------------------------------------------


@query
def sample_50(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.sample_n(docs, "doc_id", 50, by="lang")


@query
def quota_sample(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "source")
    return sampling.quota_sample(docs, "doc_id", QUOTAS, default=14, total=300)


@query
def quota_top_up(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("source"))
    return sampling.quota_sample(docs, "doc_id", {"en": 15}, default=14, total=100)


@query
def slice_by_size(spark, sf):
    docs = v.table(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"), "text")
    sliced = slicing.slice_by_size(docs, F.octet_length("text"), SLICE_LIMIT)
    return sliced.select("source", "ord", "part")


@query
def slice_tight(spark, sf):
    """A limit that most rows pass by themselves, in small blocks and groups."""
    docs = v.table(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"), "text")
    sliced = slicing.slice_by_size(docs, F.octet_length("text"), TIGHT_LIMIT, block_rows=64, group_blocks=4)
    return sliced.select("source", "ord", "part")


@query
def slice_totals(spark, sf):
    docs = v.table(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"), "lang", "text")
    record = tx.json_size(F.struct("ord", "lang", "text"), 3)
    return slicing.row_totals(docs, record)


# --- generated queries --------------------------------------------------------------------------------


@query
def normalize_results(spark, sf):
    rows = outcomes.normalize_results(v.result_documents(spark, sf), "body", "failure")
    return rows.select("source", "ord", "obj_values", "error")


@query
def outcome_summary(spark, sf):
    rows = outcomes.normalize_results(v.result_documents(spark, sf), "body", "failure")
    return outcomes.outcome_summary(rows).withColumn("percent", _six("percent"))


@query
def distinct_errors(spark, sf):
    return outcomes.distinct_errors(outcomes.normalize_results(v.result_documents(spark, sf), "body", "failure"))


@query
def repair_queries(spark, sf):
    return repair.repair_text(v.broken_queries(spark, sf))[0]


@query
def repair_audit(spark, sf):
    return repair.repair_text(v.broken_queries(spark, sf))[1]


@query
def changed_rows(spark, sf):
    broken = v.broken_queries(spark, sf)
    both = repair.repair_text(broken.withColumn("before", F.col("sparql")))[0]
    return outcomes.changed_count(both, "before", "sparql")


# --- exchange: the text side of readers, sinks and reports ---------------------------------------------


@query
def dataset_names(spark, sf):
    """Dataset names of file names with known and unknown endings."""
    endings = ("-type.csv", ".grouped.json", ".txt", ".gtqa", ".jsonl", "")
    name = F.concat("p_name", v._pick(endings, F.col("p_partkey") % len(endings)))
    return v.table(spark, sf, "part").select("p_partkey", readers.dataset_name(name).alias("dataset"))


@query
def parsed_examples(spark, sf):
    """Examples back from JSON lines, some of them broken."""
    record = F.to_json(F.struct("input_seg", "question", "output", F.col("ord").alias("id")))
    lines = v.examples(spark, sf).select("source", F.when(F.col("ord") % 17 == 3, F.concat(F.lit("{"), record)).otherwise(record).alias("value"))
    rows = readers.parse_example_lines(lines, ord_col="id")
    return rows.select("source", "ord", "input_seg", "question", extract.answer_of(F.col("output")).alias("answer"))


@query
def aligned_rows(spark, sf):
    """Columns with blanks in their names, one missing, in another order."""
    rows = v.table(spark, sf, "part").select(F.col("p_size").alias("size "), F.col("p_partkey").alias(" id"), F.col("p_name").alias("name"), "p_brand")
    schema = T.StructType().add("id", "long").add("name", "string").add("size", "long").add("note", "string").add("topic", "string")
    return extract.align(rows, schema, {"note": "none"})


@query
def unquoted_csv_lines(spark, sf):
    return writers.unquoted_lines(v.table(spark, sf, "documents").select("source", "doc_id", "lang", "text"))


@query
def group_lines(spark, sf):
    return writers.flat_lines(grouping.group_claims(v.claims(spark, sf)), order=("segment",))


@query
def metric_report(spark, sf):
    return reports.report(compare.comparison(_predictions(spark, sf)), markdown=True)


@query
def share_report(spark, sf):
    counts = crosstab.value_counts(v.table(spark, sf, "events"), "event_type")
    return reports.share_report(crosstab.with_share(counts, "n", "percent", 100.0), "event_type", "n", "percent")


@query
def outcome_report(spark, sf):
    rows = outcomes.normalize_results(v.result_documents(spark, sf), "body", "failure")
    return reports.outcome_report(outcomes.outcome_summary(rows), rows)


@query
def relatedness_group_rows(spark, sf):
    """Score, pairs, texts, table and source of each group."""
    return _group_scores(spark, sf)


@query
def relatedness_group_summary(spark, sf):
    return _six_stats(relatedness.score_summary(_group_scores(spark, sf).where("segment = 0")), "mean", "median", "std", "min", "max")


@query
def relatedness_group_lowest(spark, sf):
    lowest = relatedness.lowest_k(_group_scores(spark, sf).where("segment = 0"), ties=("source", "table"))
    return lowest.select("source", "table", "num_pairs", "similarity_score")


def _group_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = relatedness.group_relatedness(_clean_groups(spark, sf))
    return scored.withColumn("similarity_score", _six("similarity_score"))


# --- files written and read back ----------------------------------------------------------------------


@query
def array_examples(spark, sf):
    """Examples as JSON arrays, one file a source, read back in parallel."""
    path = shared_path(spark, "arrays")
    arrays.write_arrays(v.examples(spark, sf), path)
    items = arrays.array_items(spark, path, "struct<input_seg: string, question: string, output: string>", "*.txt")
    return items.select(F.regexp_extract("file", "/source=([^/]*)/", 1).alias("source"), "ord", "item.*")


@query
def slice_files(spark, sf):
    """Slices of documents as files, with the sizes that the files have."""
    path = shared_path(spark, "slices")
    docs = v.table(spark, sf, "documents").select("source", F.col("doc_id").alias("ord"), "text")
    writers.write_slices(docs, path, limit=SLICE_LIMIT)
    return writers.slice_files(spark, path)


@query
def text_lines(spark, sf):
    """Questions as text lines, read back trimmed and counted."""
    path = shared_path(spark, "lines")
    writers.write_lines(v.examples(spark, sf).select("source", "ord", "question"), path, "question", order=("ord",))
    return readers.read_lines(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query
def table_rows(spark, sf):
    """Questions and answers as quoted CSV with line breaks inside fields, read back with the header checked."""
    path = shared_path(spark, "tables")
    writers.write_by_source(v.qa(spark, sf).select("source", "ord", "question", "answer"), path, "csv")
    return readers.read_table(spark, path, "ord bigint, question string, answer string", multi_line=True).drop("source")
