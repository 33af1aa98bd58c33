"""Corpus views over the test tables: the inputs the registered queries run on.

The tables hold invented prose, so fixed templates around the texts bring in the cues the rules look for.
Every view covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.vectors import cosine
from ..operators.ordering import next_value
from ..operators.topics import LABELS, label_scores

SOURCES = ("fetaqa_train", "fetaqa_test", "hitab_test", "hitab_train", "wikisql_test", "wikitq_test", "hybridqa_eval")

QUESTION_LEADS = (
    "how many points did the club score in the 1951 and 1957 season? ",
    "who directed the film that the writer of the novel described as the best? ",
    "in which year was ",
    "which player is both a captain and a coach of the team? ",
    "what type of structure was discovered by ",
    "what is the total number of games played before 2010 and after 2004? ",
    "who won ",
    "which city with more than 3 stations is the largest? ",
    "which of the many listed railway stations is the one with the longest platform? ",
    "list every driver who did not finish first in the race ",
    "what is the average attendance and the difference between the highest and lowest? ",
    "when was the date of the battle? ",
    "where the winner of the cup is from, tell me ",
    "name the only unique title ",
    "",
    "does the house whose roof is red have at least 4 rooms? ",
)
ANSWER_LEADS = (
    "12 March 1998: ", "Ada Lovelace, ", "river; ", "team; ", "battle; ", "novel; ", "largest; ", "musician; ",
    "1,250 km; ", "", "on May 12, ",
)
# Answers with these leads keep the blanks of their text; the others carry it as one token.
PLAIN_ANSWERS = (0, 1, 10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer pairs: a user turn and the assistant turn right after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("asked"),
        *[F.lead(c).over(order).alias(n) for c, n in (("turn", "_turn"), ("role", "_role"), ("text", "told"))],
    ).where("role = 'user' AND _role = 'assistant' AND _turn = turn + 1")
    kind = F.col("conv_id") * 3 + F.col("turn")
    blob = F.when((kind % len(ANSWER_LEADS)).isin(*PLAIN_ANSWERS), F.col("told")).otherwise(
        F.translate("told", " ", "_")
    )
    return turns.select(
        _pick(SOURCES, F.col("conv_id") % len(SOURCES)).alias("source"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        F.concat(_pick(QUESTION_LEADS, kind % len(QUESTION_LEADS)), F.col("asked")).alias("question"),
        F.concat(_pick(ANSWER_LEADS, kind % len(ANSWER_LEADS)), blob).alias("answer"),
        "conv_id",
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw examples ``source, ord, input_seg, question, output``; three conversations share a table."""
    pairs = qa(spark, sf_dir)
    tid = F.floor(F.col("conv_id") / 21) * 21 + F.col("conv_id") % 7
    body = F.when(tid % 10 == 9, F.lit("")).otherwise(F.format_string(
        '[TAB] col: | conv | src \\ | [SEP] | %d | set "%d" cat [TAB] col: |', tid, tid % 7
    ))
    lead = (
        F.when(F.col("source").contains("fetaqa"), F.format_string(
            "[TLE] The Wikipedia page title of this table is Page  %d. "
            "The Wikipedia section title of this table is Section \"%d\". ", tid, tid % 5))
        .when(F.col("source").contains("hitab"), F.format_string("[TLE]  The table caption is Caption %d. ", tid))
        .otherwise(F.format_string("[TLE] The table caption is about topic %d. ", tid))
    )
    bare = F.col("ord") % 13 == 0
    question = (
        F.when(bare, F.col("question"))
        .when(F.col("source").contains("fetaqa"),
              F.concat(F.lit("cells [HIGHLIGHTED_BEGIN] 1 [HIGHLIGHTED_END] "), F.col("question")))
        .when(F.col("source").contains("hybridqa"),
              F.concat(F.lit('A "passage". The question:'), F.col("question")))
        .otherwise(F.col("question"))
    )
    return pairs.select(
        "source", "ord", F.concat(lead, body).alias("input_seg"), question.alias("question"),
        F.col("answer").alias("output"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims about a table; a third of them stands in angle brackets, some are empty."""
    wrapped = F.concat(F.lit("statement: <"), F.col("question"), F.lit("> holds"))
    return examples(spark, sf_dir).withColumn(
        "question", F.when(F.col("ord") % 11 == 4, "").when(F.col("ord") % 3 == 0, wrapped).otherwise(F.col("question"))
    )


def score_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score lists per vector: each half of the dimensions, added up over the topic labels in turn."""
    half, n = 32, len(LABELS)

    def folded(first: int) -> list[Column]:
        at = [F.get("embedding", F.lit(d)).cast("double") for d in range(first, first + half)]
        return [sum(at[i + n :: n], at[i]) for i in range(n)]

    return table(spark, sf_dir, "embeddings").select(
        "vec_id", label_scores(folded(0)).alias("scores_a"), label_scores(folded(half)).alias("scores_b")
    )


def similarities(spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None) -> DataFrame:
    """Cosine similarity of each vector and the next one that exists (of the last and the first), rounded to six digits."""
    vectors = table(spark, sf_dir, "embeddings") if vectors is None else vectors
    following = next_value(vectors.select("vec_id"), "vec_id", "_at")
    others = vectors.select(F.col("vec_id").alias("_at"), F.col("embedding").alias("_next"))
    return vectors.join(following, "vec_id").join(others, "_at").select(
        F.concat(F.lit("label"), F.col("label").cast("string")).alias("source"),
        F.col("vec_id").alias("ord"),
        F.round(cosine(F.col("embedding"), F.col("_next")), 6).alias("similarity_score"),
    )


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query results as JSON text built from events: repeated values, no values, broken and failed ones."""
    k = F.get_json_object("props", "$.k")
    value = F.concat(F.lit('{"obj": {"type": "uri", "value": "v'), k, F.lit('"}}'))
    other = F.concat(F.lit('{"obj": {"value": "w'), F.col("user_id").cast("string"), F.lit('"}}'))
    skipped = F.lit('{"subj": {"value": "x"}}')
    kind = F.col("event_id") % 7
    wrapped = F.concat(F.lit('{"head": {}, "results": {"bindings": ['), F.concat_ws(
        ", ", F.when(kind != 0, other), F.when(kind != 0, value), F.when(kind > 2, other), skipped
    ), F.lit("]}}"))
    body = (
        F.when(kind == 5, F.concat(F.lit("<html> gone "), k, F.lit(" </html>\n")))
        .when(kind == 6, F.lit('{"results": {"bindings": {"a": 1}}}'))
        .otherwise(wrapped)
    )
    failed = F.col("event_type") == "error"
    from ..operators.outcomes import http_error

    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("ord"), body.alias("body"),
        http_error(F.when(failed, 400).otherwise(200), F.concat(F.lit("bad\nquery "), k)).alias("failure"),
    )


def output_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polymorphic outputs as JSON text: text, objects with and without an answer key, lists, scalars."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 8

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == 0, text('"  plain ', k, ' "'))
        .when(kind == 1, text('{"result": "r', k, '", "answer": " a', k, '"}'))
        .when(kind == 2, text('{"final_answer": 5, "prediction": "p', k, '"}'))
        .when(kind == 3, text('["first ', k, '", "second"]'))
        .when(kind == 4, text("[", k, ',  [2,{"b":', k, ' ,"a" : "x,y: z"}]]'))
        .when(kind == 5, F.lit("true"))
        .when(kind == 6, k)
        .otherwise(text('{"b": ', k, ',\n "a":"1:2,3"}')).alias("output"),
    )


# Broken queries ({k} is the part key, {b} the brand) and what their repair must give.
BROKEN_QUERIES = (
    ("select distinct ?uri where [ ?uri dbr:Part:{k} dbo:maker ?uri ]",
     "SELECT distinct ?uri WHERE {{ ?uri dbr:Part_{k} ?v1 . ?v1 dbo:maker ?uri }}"),
    ("select ?value where [ dbr:part_{k} p:weight ?value ]",
     "SELECT ?value WHERE {{ dbr:part_{k} dbo:weight ?value }}"),
    ("ask where [ dbr:P{k} dbo:origin ?obj . ?obj dbo:origin dbo:year ?x ]",
     "ASK WHERE {{ dbr:P{k} dbo:origin ?obj . ?obj dbo:origin ?v1 . ?v1 dbo:year ?x }}"),
    ("select distinct ?sbj where [ ?sbj wdt:colour wd:p{k} . ?sbj rdf:made_in ]",
     "SELECT distinct ?sbj WHERE {{ ?sbj dbo:colour dbr:p{k} . ?sbj rdf:made_in ?v1 }}"),
    ("select ?obj where [ dbr:Q{k} dbo:origin ?obj ] order  BY DESC(?obj)limit 5",
     "SELECT ?obj WHERE {{ dbr:Q{k} dbo:origin ?obj }} ORDER BY DESC(?obj) LIMIT 5"),
    ("select ?x where [ ?x dbo:name ?l . filter(contains(lcase(?l, 'b{k}', 'en') ]",
     "SELECT ?x WHERE {{ ?x dbo:name ?l . filter(CONTAINS(lcase(?l, b{k}) }}))"),
    ("select ?x where [ ?x ?x dbo:size {k} ; ]",
     "SELECT ?x WHERE {{ ?x dbo:size {k} }}"),
    ("select ?x where [ Position dbo:size ?x . dbr:P{k} dbo:size ?x ]",
     "SELECT ?x WHERE {{ dbr:P{k} dbo:size ?x }}"),
    ("select (count(?x) as n) where [ ?x dbo:at 12:30 & ?y ]",
     'SELECT (count(?x) AS ?n) WHERE {{ ?x dbo:at ?v1 . ?v1 "12:30" ?y }}'),
    ("select ?x where [ ?x {k} dbo:size ?y ?z . ?x {k} ?y ]",
     "SELECT ?x WHERE {{ ?x dbo:size ?y }}"),
    ("select ?x where [ ?x dbo:brand '{b}'@en > . . ?x dbo:p ?y ]]",
     "SELECT ?x WHERE {{ ?x dbo:brand ?v1 . ?v1 {b}@en > . ?x dbo:p ?v2 . ?v2 ?y }}"),
    ("select ?x where [ optional [ ?x dbo:a ?y . ?y dbo:b ?z ] . ?x dbo:k dbr:K{k} ]",
     "SELECT ?x WHERE {{ optional {{ ?x dbo:a ?y . ?y dbo:b ?z }} . ?x dbo:k dbr:K{k} }}"),
    ("select ?x where [ ?x dbo:k dbr:K{k} ) )",
     "SELECT ?x WHERE {{ ?x dbo:k dbr:K{k} ) ) }}"),
    ("SELECT ?x WHERE {{ ?x dbo:k dbr:K{k} }}",
     "SELECT ?x WHERE {{ ?x dbo:k dbr:K{k} }}"),
    ("select ?x where [ ?x dbo:n <http://e.org/{k}> ]",
     "SELECT ?x WHERE {{ ?x dbo:n <http://e }}"),
    ("no query for {k} )", "no query for {k}"),
)


def broken_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken SPARQL texts per part."""
    texts = [q.replace("{{", "{").replace("}}", "}") for q, _ in BROKEN_QUERIES]
    query = _pick(texts, F.col("p_partkey") % len(texts))
    query = F.replace(query, F.lit("{k}"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"), F.col("p_partkey").alias("ord"),
        F.replace(query, F.lit("{b}"), F.col("p_brand")).alias("sparql"),
    )
