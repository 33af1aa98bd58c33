"""Audited text repair of generated SPARQL queries.

Each rule is a ``Column -> Column`` expression applied in order; the stages are kept so that one aggregate
can report how many rows each rule changed.  Only the clause rule needs a scan with nesting depth; it runs
as one Arrow-batched function over the body text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import SPACE, WORD, WORD_START, bounded, strip

Rule = tuple[str, Callable[[Column], Column]]
INLINE_SPACE = r"[^\S\n]*"


def _sub(pattern: str, replacement: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, replacement)


def _then(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def run(c: Column) -> Column:
        for step in steps:
            c = step(c)
        return c
    return run


# Prefixes without a definition and the ones they become.
PROPERTY_PREFIXES, PROPERTY_TARGET = ("wdt", "ps", "p"), "dbo"
ENTITY_PREFIXES, ENTITY_TARGET = ("wd",), "dbr"
# Clause keywords whose clauses are kept as they are.
KEPT_CLAUSES = ("filter", "optional", "values", "bind", "minus", "service", "graph", "union")
NUMBER = r"\d+(\.\d+)?"

brackets_to_braces = lambda c: F.translate(c, "[]", "{}")

map_prefixes = _then(
    _sub(f"{WORD_START}(?:{'|'.join(PROPERTY_PREFIXES)}):", f"{PROPERTY_TARGET}:"),
    _sub(f"{WORD_START}(?:{'|'.join(ENTITY_PREFIXES)}):", f"{ENTITY_TARGET}:"),
)

# A name is ``prefix:local``; every further colon of its local part becomes an underscore.  ``\G`` continues
# inside the same name.
local_names = _sub(rf"({WORD_START}[A-Za-z_][A-Za-z0-9_-]*:|\G(?!\A))([^\s.,;){{}}:]*):", "$1$2_")

# The patterns of the following rules.
stray_characters = _then(
    lambda c: F.translate(c, "&", " "),
    _sub(r"(?<![<=>!])>(?!\s)", " "),
    lambda c: F.translate(c, "'", ""),
)

# Pattern and replacement.
quote_times = _sub(rf'(?<!"){bounded(r"(\p{Nd}{1,2}:\p{Nd}{2})")}(?!")', '"$1"')

_ARG = rf"{INLINE_SPACE}([^,)\n]*?){INLINE_SPACE}"
# Patterns and replacements.
contains_arguments = _then(
    _sub(rf"(?i)CONTAINS\s*\(\s*{_ARG},{_ARG}(?:,[^)\n]*)?\s*\)", "CONTAINS($1, $2)"),
    _sub(rf"(?i)CONTAINS\s*\(\s*{_ARG}\s*\)", "CONTAINS($1)"),
)

alias_variables = _sub(rf"(?i){WORD_START}AS\s+([A-Za-z_]{WORD}*)", "AS ?$1")

upper_where = _sub(f"(?i){bounded('where')}", "WHERE")

# Keywords, patterns and replacements.
keywords_and_spacing = _then(
    lambda c: F.trim(F.regexp_replace(c, f"{SPACE}+", " ")),
    _sub(f"(?i){bounded('select')}", "SELECT"),
    _sub(f"(?i){bounded('ask')}", "ASK"),
    _sub(rf"(?i){bounded(rf'order{SPACE}+by')}", "ORDER BY"),
    _sub(f"(?i){bounded('limit')}", "LIMIT"),
    _sub(r"\s*\{\s*", " { "),
    _sub(r"\s*\}\s*", " } "),
    _sub(r"ORDER BY\s*DESC\s*\(", "ORDER BY DESC("),
    _sub(r"(?i)\)\s*limit", ") LIMIT"),
    strip,
)


def _balance(opening: str, closing: str, appended: str) -> Callable[[Column], Column]:
    """Make bracket counts match at the end: drop surplus trailing closers or append missing ones."""
    def run(c: Column) -> Column:
        def count(text: Column, ch: str) -> Column:
            return F.length(text) - F.length(F.translate(text, ch, ""))

        surplus = count(c, closing) - count(c, opening)
        tail = F.regexp_extract(c, rf"(?:\s*\{closing})+\z", 0)
        kept = F.greatest(count(tail, closing) - surplus, F.lit(0))
        stem = F.substr(c, F.lit(1), F.length(c) - F.length(tail))
        # text up to and including the last closer that stays
        rest = F.call_function("substring_index", tail, F.lit(closing), kept)
        closed = F.when(kept > 0, F.concat(stem, rest, F.lit(closing))).otherwise(F.rtrim(stem))
        return (
            F.when((surplus > 0) & (tail != ""), closed)
            .when(surplus < 0, F.concat(c, F.repeat(F.lit(appended), -surplus)))
            .otherwise(c)
        )
    return run


balance_brackets = _then(_balance("{", "}", " }"), _balance("(", ")", ")"))


# --- clause repair ----------------------------------------------------------------------------------

_MARKS = re.compile(r"[.{}()\[\]]")
_KEPT = re.compile(rf"(?:{'|'.join(KEPT_CLAUSES)})\b", re.IGNORECASE)
_NUMBER_TERM = re.compile(NUMBER)


def _top_level(body: str) -> Iterator[str]:
    """Non-blank pieces of ``body`` between dots that stand outside all brackets."""
    depth, begin = 0, 0
    for mark in _MARKS.finditer(body):
        ch = mark.group()
        if ch != ".":
            depth = depth + 1 if ch in "{([" else max(depth - 1, 0)
        elif depth == 0:
            yield body[begin:mark.start()]
            begin = mark.end()
    yield body[begin:]


def _valid_subject(term: str) -> bool:
    is_iri = term.startswith("<") and term.endswith(">")
    return term.startswith("?") or is_iri or term.find(":") > 0


def _triples(clause: str, fresh: Iterator[str]) -> list[str]:
    """Usable triples of one clause; ``fresh`` supplies variable names for missing terms."""
    raw = clause.split()
    terms = [t for i, t in enumerate(raw) if not (t[0] == "?" and i and raw[i - 1] == t)]
    if _KEPT.match(terms[0]):
        return [clause]
    while terms and terms[-1] in (";", ","):
        del terms[-1]
    if terms and not _valid_subject(terms[0]):
        return []
    match terms:
        case [subject, predicate]:
            return [f"{subject} {predicate} {next(fresh)}"]
        case [subject, first, second, obj]:
            if not (first.startswith("?") or ":" in first) or _NUMBER_TERM.fullmatch(first):
                return []
            middle = next(fresh)
            return [f"{subject} {first} {middle}", f"{middle} {second} {obj}"]
        case [subject, number, *others] if _NUMBER_TERM.fullmatch(number):
            terms = [subject, *others]
    return [" ".join(terms[:3])] if len(terms) > 2 else []


def repair_body(body: str) -> str:
    """Repair the clauses of one query body."""
    names = (f"?v{i}" for i in range(1, len(body) + 2))
    triples = [t for piece in _top_level(body) if piece.strip() for t in _triples(piece.strip(), names)]
    return re.sub(r"\s*\.\s*\.\s*", " . ", " . ".join(triples)).strip()


@F.pandas_udf(T.StringType())
def _repair_bodies(bodies: pd.Series) -> pd.Series:
    return bodies.map(repair_body, na_action="ignore")


def repair_clauses(c: Column) -> Column:
    """Repair the text between the first ``WHERE {`` (else the first brace) and the last closing brace."""
    where, braces = r"(?is)\A(.*?WHERE\s*\{)(.*)(\}.*)\z", r"(?is)\A(.*?\{)(.*)(\}.*)\z"
    where = where.replace("WHERE", f"{WORD_START}WHERE")
    body = F.when(c.rlike(where), F.regexp_extract(c, where, 2)).when(c.rlike(braces), F.regexp_extract(c, braces, 2))

    def around(i: int) -> Column:
        return F.when(c.rlike(where), F.regexp_extract(c, where, i)).otherwise(F.regexp_extract(c, braces, i))

    return F.coalesce(F.concat(around(1), _repair_bodies(body), around(3)), c)


RULES: Sequence[Rule] = (
    ("brackets_to_braces", brackets_to_braces),
    ("map_prefixes", map_prefixes),
    ("local_names", local_names),
    ("stray_characters", stray_characters),
    ("quote_times", quote_times),
    ("contains_arguments", contains_arguments),
    ("alias_variables", alias_variables),
    ("upper_where", upper_where),
    ("repair_clauses", repair_clauses),
    ("keywords_and_spacing", keywords_and_spacing),
    ("balance_brackets", balance_brackets),
)


def _stages(df: DataFrame, column: str, rules: Sequence[Rule]) -> tuple[DataFrame, list[str]]:
    names = [f"_stage_{i}" for i in range(len(rules) + 1)]
    out = df.withColumn(names[0], F.col(column))
    for (_, rule), before, after in zip(rules, names, names[1:]):
        out = out.withColumn(after, rule(F.col(before)))
    return out, names


def repair_text(
    df: DataFrame, column: str = "sparql", rules: Sequence[Rule] = RULES, by: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """Apply the rules to a text column.

    Returns the frame with the column repaired, and an audit frame ``by, rule, num_rows, changed`` with the
    rows each rule changed and a last line ``any`` for rows changed overall.  Both are lazy.
    """
    staged, names = _stages(df, column, rules)
    repaired = staged.select(
        *[F.col(names[-1]).alias(column) if c == column else F.col(c) for c in df.columns]
    )

    def changed(before: str, after: str) -> Column:
        return F.count_if(~F.col(before).eqNullSafe(F.col(after)))

    hits = [changed(b, a) for b, a in zip(names, names[1:])] + [changed(names[0], names[-1])]
    counts = staged.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_rows"), *[h.alias(f"_hits_{i}") for i, h in enumerate(hits)]
    )
    lines = [
        F.struct(F.lit(rule).alias("rule"), F.col(f"_hits_{i}").alias("changed"))
        for i, rule in enumerate([*[r for r, _ in rules], "any"])
    ]
    return repaired, counts.select(by, "num_rows", F.inline(F.array(*lines)))
