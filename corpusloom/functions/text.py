"""Text kernel: column expressions for trimming, tokenising and cleaning corpus text.

Everything here is a pure ``Column -> Column`` expression, so it stays in the JVM and inside
whole-stage code generation.  Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII by default and differ from the
Unicode-aware classes the corpora were built with, so the classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# letter/digit/underscore class, white space class (the information separators count as white
# space here), ASCII punctuation.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]"
NOT_SPACE = r"[^\p{IsWhite_Space}\x{1c}-\x{1f}]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Markers of the linearised table format and of the wrapped questions.
TITLE_MARK = "[TLE]"
TABLE_MARK = "[TAB]"
ROW_MARK = "[SEP]"
CAPTION_MARK = "The table caption is about"
HIGHLIGHT_MARK = "[HIGHLIGHTED_END]"
QUESTION_MARK = "The question:"
UNKNOWN_TABLE = "UNKNOWN_TABLE"

WORD_START = f"(?<!{WORD})"
WORD_END = f"(?!{WORD})"


def bounded(body: str, first: str = "") -> str:
    """Regex for ``body`` standing between Unicode word boundaries.

    ``first`` is a class of possible first characters: testing it before the boundary makes long texts cheap.
    """
    ahead = f"(?={first})" if first else ""
    return f"{ahead}{WORD_START}(?:{body}){WORD_END}"


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space (``trim`` removes only U+0020)."""
    return F.regexp_extract(c, rf"(?s)\A{SPACE}*+(.*{NOT_SPACE})?", 1)


def collapse_ws(c: Column) -> Column:
    """White space runs become one space; ends are trimmed; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def drop_quotes(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def sanitize(c: Column) -> Column:
    """Remove double quotes, then collapse white space."""
    return collapse_ws(drop_quotes(c))


def has_text(c: Column) -> Column:
    """Whether :func:`sanitize` leaves anything, decided by the first telling character."""
    return F.coalesce(c.rlike(r'[^"\p{IsWhite_Space}\x{1c}-\x{1f}]'), F.lit(False))


def strip_punct(c: Column) -> Column:
    """Delete the 32 ASCII punctuation characters."""
    return F.translate(c, PUNCTUATION, "")


def tokens(c: Column) -> Column:
    """Lower-cased word tokens in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), F.lit(0))


def bound(c: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a column that is worked out once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def run_begins(ordered: Column) -> Column:
    """Places of a sorted array (a bound one) where another value begins."""
    places = F.transform(ordered, lambda w, i: F.when((i == 0) | (F.get(ordered, i - 1) != w), i))
    return F.filter(places, lambda i: i.isNotNull())


def run_lengths(ordered: Column, at: Column) -> Column:
    """How often each value of a sorted array stands in it; ``at`` are its :func:`run_begins`, bound."""
    return F.transform(at, lambda b, i: (F.coalesce(F.get(at, i + 1), F.size(ordered)) - b).cast("bigint"))


def term_counts(c: Column) -> Column:
    """The distinct tokens and how often each occurs, ``array<struct<term, n>>``; counted by sorting inside the row."""
    def counts(words: Column) -> Column:
        return bound(run_begins(words), lambda at: F.arrays_zip(
            F.transform(at, lambda b: F.get(words, b)).alias("term"), run_lengths(words, at).alias("n")))

    return bound(F.sort_array(tokens(c)), counts)


def after_first(c: Column, marker: str) -> Column:
    """Text after the first ``marker``; null when the marker is absent."""
    return F.get(F.split(c, rf"\Q{marker}\E", 2), F.lit(1))


def from_first(c: Column, marker: str) -> Column:
    """Text from the first ``marker`` on, marker included; '' when absent or null."""
    return F.coalesce(F.regexp_extract(c, rf"(?s)(\Q{marker}\E.*)\z", 1), F.lit(""))


def clean_caption(c: Column) -> Column:
    """Table text without the caption lead-in and without table markup."""
    body = F.regexp_replace(c, rf"(?s)\A.*?\Q{CAPTION_MARK}\E", "")
    return strip(F.regexp_replace(body, r"\[TAB\]|\[SEP\]|\|", ""))


def table_key(c: Column) -> Column:
    """Text between the title mark and the first table mark of the same line."""
    found = rf"\[TLE\]([^\n]*?)\[TAB\]"
    return F.when(c.rlike(found), strip(F.regexp_extract(c, found, 1))).otherwise(F.lit(UNKNOWN_TABLE))


def clean_claim(c: Column) -> Column:
    """Content of the first ``<...>`` on one line, else the trimmed text."""
    found = r"<([^\n]*?)>"
    return strip(F.when(c.rlike(found), F.regexp_extract(c, found, 1)).otherwise(c))


# Deletions of the segment cleaner, applied in this order, ignoring case.  ``{gap}`` is the
# white space allowed inside a marker: exactly one space in version 1, any run in version 2.
_SEGMENT_DELETIONS = (
    r"\[TLE\]{gap}The Wikipedia page title of this table is",
    r"The Wikipedia section title of this table is",
    r"\[TLE\]{gap}The table caption is",
    r"\[TAB\]",
    r"\[TAB\]{gap}col:",
    r"{start}col:(?={word})",
    r"\|",
    r"\\",
    r"\[SEP\]",
    r"{tab}{gap}col:",
    r"col:",
)


def clean_segment(c: Column, version: int = 2, compat: bool = False) -> Column:
    """Delete table markup and lead-ins, drop quotes, collapse white space.

    ``compat=True`` keeps a historical quirk in which the last ``[TAB] col:`` deletion acts as a
    character class, so one of the letters t, a, b before ``col:`` disappears as well.
    """
    gap = " " if version == 1 else f"{SPACE}*"
    tab = "[TAB]" if compat else r"\[TAB\]"
    out = F.coalesce(c, F.lit(""))
    for deletion in _SEGMENT_DELETIONS:
        pattern = (
            deletion.replace("{gap}", gap).replace("{tab}", tab)
            .replace("{start}", WORD_START).replace("{word}", WORD)
        )
        out = F.regexp_replace(out, f"(?iu){pattern}", "")
    return sanitize(out)


def question_after(c: Column, marker: str) -> Column:
    """Trimmed question behind a marker; null when the marker is absent."""
    return strip(after_first(c, marker))


def _lead_in(c: Column, lead: str) -> Column:
    return sanitize(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?isu){lead}{SPACE}+(.*?)\.", 1))


def page_title(c: Column) -> Column:
    return _lead_in(c, "The Wikipedia page title of this table is")


def section_title(c: Column) -> Column:
    return _lead_in(c, "The Wikipedia section title of this table is")


def caption(c: Column) -> Column:
    return _lead_in(c, "The table caption is")


def raw_table(c: Column) -> Column:
    """Unchanged text from the table mark on."""
    return from_first(c, TABLE_MARK)


def prompt(c: Column, instruction: str) -> Column:
    """Fixed instruction followed by the question."""
    return F.concat(F.lit(instruction), c)


def truncate(c: Column, limit: int = 180) -> Column:
    """First ``limit`` characters plus an ellipsis when the text is longer (message display)."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def json_size(record: Column, n_fields: int) -> Column:
    """Bytes of a flat record as JSON with a blank after each separator.

    Spark writes no blanks, so the ``2 * fields - 1`` separators are added.
    """
    text = F.to_json(record, {"ignoreNullFields": "false"})
    return (F.octet_length(text) + F.lit(2 * n_fields - 1)).cast("bigint")
