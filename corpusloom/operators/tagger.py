"""Entities from a dictionary of titles, found by an Aho-Corasick automaton.

Titles are measured first.  Up to ``most_bytes`` of them are one shard, sent to all tasks and built into an automaton once per
worker; larger dictionaries are cut by hash into shards of about that size, each of which passes over the texts, and the
matches of a text are put together before the longest ones are chosen.  So what is sent at once is bounded, and results do
not depend on the number of shards.

A match is a title that stands in the text with no word character (Unicode letters, digits, underscore) next to a word
character of its own ends.  Of overlapping matches the leftmost is kept, of those that begin together the longest.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Bytes of titles in a shard.
SHARD_BYTES = 1 << 24
#: Texts that a worker turns into Python objects at a time.
TEXTS = 256
_WORD = re.compile(r"\w")
MATCHES = "array<struct<start: int, end: int>>"


@functools.lru_cache(maxsize=1)
def _automaton(titles: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for title in titles:
        found.add_word(title)
    found.make_automaton()
    return found


def spans(text: str, automaton) -> list[tuple[int, int]]:
    """All places where a title stands between word boundaries, as (start, end); no automaton stands for no titles."""
    out = []
    if text and automaton is not None:
        for last, length in automaton.iter(text):
            start, end = last + 1 - length, last + 1
            before = start and _WORD.match(text[start - 1]) and _WORD.match(text[start])
            after = end < len(text) and _WORD.match(text[end]) and _WORD.match(text[last])
            if not before and not after:
                out.append((start, end))
    return out


def longest(found: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Leftmost and then longest of overlapping spans."""
    out, free = [], 0
    for start, end in sorted(found, key=lambda s: (s[0], -s[1])):
        if start >= free:
            out.append((start, end))
            free = end
    return out


def dictionary_entities(df: DataFrame, text: str, titles: DataFrame, title: str = "title", name: str = "entities",
                        most_bytes: int = SHARD_BYTES) -> DataFrame:
    """Add ``name``, the titles found in ``text`` in order of appearance, repeats included; null texts have none.

    Null and empty titles are ignored.  One aggregate over the titles runs when the frame is built, and their shards come to
    the driver one at a time.
    """
    known = titles.select(F.col(title).alias("title")).where(F.length("title") > 0).distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length("title")), F.lit(0))).first()[0]
    shards = 1 + size // most_bytes
    out = df.withColumn("_spans", F.array().cast(MATCHES))
    for shard in range(shards):
        held = known.where(F.pmod(F.xxhash64("title"), F.lit(shards)) == shard).collect()  # about most_bytes
        out = _with_spans(out, text, sorted(r["title"] for r in held), name if shard == shards - 1 else None)
    return out


def _arrow(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def _with_spans(df: DataFrame, text: str, titles: list[str], name: str | None) -> DataFrame:
    """Adds the spans of a shard's titles to ``_spans``; with ``name``, for the last shard, the texts of the longest spans
    stand in its place.  ``TEXTS`` rows at a time become Python objects and are passed on."""
    shared = df.sparkSession.sparkContext.broadcast(titles)
    at, place = df.columns.index(text), df.columns.index("_spans")
    kind = df.schema
    if name is not None:
        kind = T.StructType([*(f for f in kind.fields if f.name != "_spans"), T.StructField(name, T.ArrayType(T.StringType()))])
    schema = _arrow(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(tuple(shared.value)) if shared.value else None
        for whole in batches:
            for begin in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(begin, TEXTS)
                texts = batch.column(at).to_pylist()
                found = [
                    [(m["start"], m["end"]) for m in old] + spans(t, automaton) for t, old in zip(texts, batch.column(place).to_pylist())
                ]
                if name is None:
                    rows, columns = [[{"start": s, "end": e} for s, e in f] for f in found], list(batch.columns)
                    columns[place] = pa.array(rows, schema.field(place).type)
                else:
                    rows, columns = [[t[s:e] for s, e in longest(f)] for t, f in zip(texts, found)], list(batch.columns)
                    del columns[place]
                    columns.append(pa.array(rows, schema.field(len(columns)).type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(run, kind)
