"""Rule classification of questions and answers, as column expressions.

One regex per skill or answer type (alternation) and token-array membership for single words: no UDF and
no Python worker is involved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import SPACE, WORD, WORD_END, bounded, strip, tokens

# Words that open a question, and prepositions kept in front of them.
QUESTION_WORDS = ("what", "who", "how", "which", "when", "where", "does", "did", "is", "are")
LEADING_PREPOSITIONS = ("in", "by")

# Fixed value: the only skill cue that is a pattern; all others are plain text.
WHERE_IS = "where [^\n]* is "
# Reasoning skills in report order of precedence, with their cue patterns.  Blanks at the
# edges of a cue are significant.
SKILL_CUES = {
    "Aggregation": ("total", "sum of", "overall"),
    "Negation": (" did not ", " does not ", " not ", " never ", "has never ", "no ", " what other "),
    "Superlative": ("most ", "least ", "highest", "lowest", "best", "worst", "largest", "smallest",
                    "longest", "shortest", "earliest", "latest"),
    "Comparative": (" earlier than ", " later than ", " before ", " after ", " more than ", " greater than ",
                    " less than ", " fewer than ", " higher than ", " lower than ", " older than ",
                    " younger than "),
    "Ordinal": (" first ", " second ", " third ", " 1st ", " 2nd ", " 3rd ", " last ", " next "),
    "Unique": ("different", "unique", "only one", "no two"),
    "All": ("all of", "every ", "none of"),
    "Filtering numeric": (" greater than ", " less than ", " more than ", " fewer than ", ">", "<",
                          "at least", "at most"),
    "Filtering time": (" before ", " after ", " earlier than ", " later than ", "since ", "until ", "date",
                       " year of ", " in what year", " year was", " on which date", " what date",
                       " on what date", "date of", "date did", "when was"),
    "Filtering entity": (" whose ", " with ", WHERE_IS),
    "Average": (" sum of ", " average of ", "avg of", " total of ", "average ", "mean "),
    "Difference": (" how many years", " how long", " lived", " years old", "difference in years",
                   " difference between", " how many more", " how many less", " how much more",
                   " difference in"),
}
COUNTING = "Counting"
NO_SKILL = "No skill"
MAX_SKILLS = 3

# Answer types in order of precedence with their word lists.
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
_MONTH_FIRST = "[jfmasondJFMASOND]"
ANSWER_WORDS = {
    "Location": "road|avenue|street|city|state|country|river|mountain|park|lake|building|airport|station|"
                "square|valley|island|region|area",
    "Group": "team|band|group|organization|committee|council|corporation|company",
    "Event": "war|battle|conference|summit|meeting|ceremony|game|match|tournament",
    "Artwork": "song|album|book|movie|film|novel|painting|sculpture|opera",
    "Adjective": "best|worst|largest|smallest|most|least|first|second|last|only",
    "Common noun": "musician|writer|teacher|city|dog|car|food|instrument",
}
UNKNOWN_TYPE = "Unknown"

# Report categories.
ANSWER_TYPES = ("Adjective", "Artwork", "Common noun", "Date", "Event", "Group", "Location", "Number",
                "Person", "Unknown")
QUESTION_TYPES = ("Composition", "Intersection", "Simple")
SKILLS = ("Aggregation", "All", "Average", "Comparative", "Counting", "Difference", "Filtering entity",
          "Filtering numeric", "Filtering time", "Negation", "No skill", "Ordinal", "Superlative", "Unique")

# Cues of the question structure rules.
WH_WORDS = ("who", "what", "which", "how", "when")
NESTING_WORDS = ("that", "whose", "where")
CONSTRAINT_WORDS = ("in", "with", "for", "of", "from", "by", "at", "on", "when", "where", "which")
MAKER_CUES = ("discovered by", "written by", "founded by", "built by", "composed by")
KIND_CUES = ("type", "kind", "category", "group", "genre", "form", "class", "species")
SPORT_CUES = ("serie a", "serie b", "league", "division", "club", "team")
MATCH_CUES = ("match", "game", "season", "round")
MIN_NESTED_TOKENS = 10
MIN_WITH_DISTANCE = 20
DIGIT = r"\p{Nd}"


def _any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _mentions(q: Column, cues) -> Column:
    """Whether any cue occurs; plain cues are byte searches, several times cheaper than a regex."""
    return _any_of(*[q.rlike(cue) if cue == WHERE_IS else q.contains(cue) for cue in cues])


def _words(values) -> Column:
    return F.array(*map(F.lit, values))


def question_phrase_of(words: Column) -> Column:
    """Question-word phrase of a token array: see :func:`question_phrase`."""
    hits = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(*QUESTION_WORDS), i)), lambda i: i.isNotNull()
    )
    first = F.get(hits, F.lit(0))
    anchor = F.when(first < 3, first).otherwise(F.element_at(hits, -1))
    lead = F.when(
        (anchor > 0) & F.get(words, anchor - 1).isin(*LEADING_PREPOSITIONS), F.lit(1)
    ).otherwise(F.lit(0))
    phrase = F.array_join(F.slice(words, anchor - lead + 1, lead + 3), " ")
    return F.when(F.size(hits) > 0, phrase).otherwise(F.lit("other"))


def question_phrase(question: Column) -> Column:
    """Phrase that opens the question: the question word, a preposition before it, two words after it.

    The word is the first question word among the first three tokens, else the last one anywhere.
    """
    return question_phrase_of(tokens(question))


def answer_type_of(answer: Column, words: Column) -> Column:
    """Answer type given the answer and its tokens."""
    def matches(body: str) -> Column:
        return answer.rlike(f"(?iu){body}")

    day = rf"{DIGIT}{{1,2}} (?:{_MONTHS})"
    dates = "|".join((
        bounded(rf"{DIGIT}{{4}}|{day}(?: {DIGIT}{{4}})?|{DIGIT}{{1,2}}/{DIGIT}{{1,2}}/{DIGIT}{{2,4}}", DIGIT),
        bounded(rf"(?:{_MONTHS}) {DIGIT}{{1,2}}", _MONTH_FIRST),
    ))
    # Case is ignored throughout, so two adjacent alphabetic words already make a Person, and a rule for
    # longer proper nouns could never be reached.
    out = F.when(matches(dates), "Date").when(matches(bounded("[A-Z][a-z]+ [A-Z][a-z]+")), "Person")
    for label, listed in ANSWER_WORDS.items():
        out = out.when(F.arrays_overlap(words, _words(listed.split("|"))), label)
    # Sign, separators and unit are optional in a number, so one digit decides.
    return out.when(answer.rlike(DIGIT), "Number").otherwise(F.lit(UNKNOWN_TYPE))


def answer_type(answer: Column) -> Column:
    """Type of the answer by the first matching rule."""
    a = F.coalesce(answer, F.lit(""))
    return answer_type_of(a, tokens(a))


def question_type_of(q: Column, words: Column) -> Column:
    """Structure of a lower-cased question given its tokens."""
    wh_hits = F.array_intersect(words, _words(WH_WORDS))  # in question order
    has_wh = F.size(wh_hits) > 0
    nested = F.arrays_overlap(words, _words(NESTING_WORDS)) | (
        q.contains("who ha") & q.rlike(bounded("who has|who have", "w"))
    )
    with_at = F.locate(" with ", q)
    wh_at = F.position(F.get(wh_hits, F.lit(0)), q)
    has_and = F.array_contains(words, "and")
    constraints = F.array_intersect(words, _words(CONSTRAINT_WORDS))
    only = F.get(constraints, F.lit(0))
    several_constraints = (F.size(constraints) >= 2) | (
        (F.size(constraints) == 1) & (F.size(words) - F.size(F.array_remove(words, only)) >= 2)
    )
    joined = (has_and & several_constraints) | (
        q.contains("both") & q.rlike(rf"{bounded('both', 'b')}[^\n]*{bounded('and', 'a')}")
    )
    made = _mentions(q, MAKER_CUES) & _mentions(q, KIND_CUES)
    # four digits that are a whole token; the boundary before them is tested last
    years = F.regexp_count(q, F.lit(rf"{DIGIT}{{4}}{WORD_END}(?<!{WORD}{DIGIT}{{4}})"))
    filters = (
        (years > 0).cast("int") + _mentions(q, SPORT_CUES).cast("int") + _mentions(q, MATCH_CUES).cast("int")
    )
    several = (filters >= 2) & (has_and | (years >= 2))
    fallback = F.when(several, "Intersection").otherwise("Simple")
    return (
        F.when(has_wh & nested & (F.size(words) > MIN_NESTED_TOKENS), "Composition")
        .when(has_wh & (with_at > 0),
              F.when(with_at - wh_at > MIN_WITH_DISTANCE, "Composition").otherwise(fallback))
        .when(joined | made, "Intersection")
        .otherwise(fallback)
    )


def skills_of(q: Column, a_type: Column) -> Column:
    """Up to three skills of a lower-cased question, in precedence order."""
    found = [F.when(_mentions(q, cues), F.lit(skill)) for skill, cues in SKILL_CUES.items()]
    counting = _any_of(
        q.rlike(rf"\A{SPACE}*how many"), q.contains(" how many "), q.contains(" number of ")
    )
    found.append(F.when(counting, F.lit(COUNTING)))
    fallback = (
        F.when(a_type == "Number", COUNTING).when(a_type == "Date", "Filtering time").otherwise(NO_SKILL)
    )
    # The fallback stands last and is cut off by the slice or dropped when a skill was found.
    hits = F.slice(F.array_compact(F.array(*found, fallback)), 1, MAX_SKILLS + 1)
    return F.slice(hits, 1, F.least(F.greatest(F.size(hits) - 1, F.lit(1)), F.lit(MAX_SKILLS)))


def question_type(question: Column) -> Column:
    """Composition, Intersection or Simple."""
    return question_type_of(F.lower(question), tokens(question))


def skills(question: Column, answer: Column) -> Column:
    return skills_of(F.lower(question), answer_type(answer))


def skills_text(skill_list: Column) -> Column:
    """Skill list as the ';'-joined text used in files."""
    return F.array_join(skill_list, ";")


def skills_from_text(text: Column) -> Column:
    """Inverse of :func:`skills_text`; blank text means no skill."""
    blank = F.coalesce(strip(text), F.lit("")) == ""
    return F.when(blank, F.array(F.lit(NO_SKILL))).otherwise(F.split(text, ";"))
