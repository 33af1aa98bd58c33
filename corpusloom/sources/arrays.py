"""JSON-array files read in parallel, whatever their size.

A file is read as text whose "lines" end at closing braces, so Spark splits it into byte ranges like any text file. Where a
range lies in the file's structure isn't known when its task starts. So the first pass turns each range into a transition: for
either case, starting outside or inside a string, it gives the case at its end, the change of nesting depth, and how many
commas and closing braces there are by relative depth. The transitions of a file, one small row a range, are composed in
order. The second pass starts each range from its true state, cuts the text where top-level objects end, and knows each
element's position; what lies across ranges is put together by file and number. Groups of elements are parsed natively.

The small rows with the ranges' states are sent to all tasks: under 100 bytes for a range, which is
``spark.sql.files.maxPartitionBytes`` of input (128 MB by default), so less than a millionth of the files.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_STRUCTURE = b"{}[],"
_OTHER = bytes(set(range(256)) - set(_STRUCTURE))
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_BLANK = r"[ \t\r\n]*"

TRANSITION = ", ".join(
    f"inside{q} boolean, delta{q} int, commas{q} map<int, bigint>, closes{q} map<int, bigint>" for q in (0, 1)
)
STATE = "file string, block bigint, inside boolean, depth int, commas bigint, closes bigint, last boolean"
PIECE = "file string, number bigint, block bigint, text binary, commas bigint, after bigint, whole boolean, eof boolean, bad boolean"


def outside_strings(fragment: bytes, inside: bool) -> tuple[bytes, bool]:
    """Brackets, braces and commas of a fragment that stand outside strings, and whether it ends inside one.

    A fragment never begins between a backslash and what it escapes, unless that is a closing brace, which JSON forbids.
    """
    if b"\\" in fragment:
        fragment = _ESCAPED.sub(b"", fragment)
    parts = fragment.split(b'"')
    return b"".join(parts[1::2] if inside else parts[::2]).translate(None, _OTHER), inside ^ (len(parts) % 2 == 0)


def _fragments(spark: SparkSession, path: str, glob: str) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", glob).option("lineSep", "}").text(path)
    return lines.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


class _Transition:
    """What a range does to the state in which it is entered, for one of the two cases."""

    def __init__(self, inside: bool) -> None:
        self.inside, self.depth, self.commas, self.closes = inside, 0, Counter(), Counter()

    def step(self, fragment: bytes) -> None:
        marks, self.inside = outside_strings(fragment, self.inside)
        for mark in marks:
            if mark == 0x2C:
                self.commas[self.depth] += 1
            else:
                self.depth += 1 if mark in b"{[" else -1
        if not self.inside:  # the brace that ends the fragment
            self.depth -= 1
            self.closes[self.depth] += 1


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, both = None, ()

    def row() -> pa.RecordBatch:
        values = [[place[0]], [place[1]]]
        kinds = [pa.string(), pa.int64()]
        for t in both:
            values += [[t.inside], [t.depth], [list(t.commas.items())], [list(t.closes.items())]]
            kinds += [pa.bool_(), pa.int32(), pa.map_(pa.int32(), pa.int64()), pa.map_(pa.int32(), pa.int64())]
        names = ["file", "block", *(f"{n}{q}" for q in (0, 1) for n in ("inside", "delta", "commas", "closes"))]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

    for batch in batches:
        for value, *here in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
            if here != place:
                if place:
                    yield row()
                place, both = here, (_Transition(False), _Transition(True))
            for one in both:
                one.step(value)
    if place:
        yield row()


def _composed(ranges: pa.Table) -> pa.Table:
    """States in which a file's ranges are entered; an element is at depth 1."""
    rows = sorted(ranges.to_pylist(), key=lambda r: r["block"])
    inside, depth, commas, closes, out = False, 0, 0, 0, []
    for i, r in enumerate(rows):
        out.append({"file": r["file"], "block": r["block"], "inside": inside, "depth": depth, "commas": commas, "closes": closes,
                    "last": i == len(rows) - 1})
        q = int(inside)
        commas += dict(r[f"commas{q}"]).get(1 - depth, 0)
        closes += dict(r[f"closes{q}"]).get(1 - depth, 0)
        depth += r[f"delta{q}"]
        inside = r[f"inside{q}"]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
    names = list(out[0])
    return pa.table([pa.array([o[n] for o in out], k) for n, k in zip(names, kinds)], names)


class _Cutter:
    """Cuts a range, entered in a known state, into pieces that end where a top-level object ends."""

    def __init__(self, file: str, block: int, inside: bool, depth: int, commas: int, closes: int, last: bool) -> None:
        self.file, self.block, self.inside, self.depth, self.last = file, block, inside, depth, last
        self.after, self.number, self.held, self.commas = commas, closes, [], 0
        self.whole, self.bad, self.ended, self.waiting = depth == 0, False, False, None
        self.out: list[tuple] = []

    def add(self, fragment: bytes) -> None:
        if self.waiting is not None:
            self._step(self.waiting, True)
        self.waiting = fragment

    def _step(self, fragment: bytes, closed: bool) -> None:
        marks, self.inside = outside_strings(fragment, self.inside)
        for mark in marks:
            self.bad |= self.ended
            if mark == 0x2C:
                if self.depth == 1:
                    self.after += 1
                    self.commas += 1
            else:
                self.depth += 1 if mark in b"{[" else -1
                self.ended |= self.depth <= 0
        self.held.append(fragment)
        if closed and not self.inside:
            self.depth -= 1
            self.bad |= self.depth < 1
            if self.depth == 1:
                self._emit(b"}", True)

    def _emit(self, end: bytes, complete: bool, eof: bool = False) -> None:
        text = b"}".join(self.held) + end
        self.out.append((self.file, self.number, self.block, text, self.commas, self.after, self.whole and complete, eof, self.bad))
        self.number += complete
        self.held, self.commas, self.whole = [], 0, True

    def finish(self) -> None:
        if self.last:
            self._step(self.waiting, False)
            self.bad |= self.inside or self.depth != 0
            self._emit(b"", True, True)
        else:
            self._step(self.waiting, True)
            if self.held:
                self._emit(b"}", False)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split(" ")[0] for part in PIECE.split(", ")]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    cutter, place = None, None

    def rows() -> pa.RecordBatch:
        columns = list(zip(*cutter.out)) or [[]] * len(names)
        cutter.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("value", "file", "block", "inside", "depth", "commas", "closes", "last"))
        for value, file, block, *state in zip(*columns):
            if (file, block) != place:
                if cutter:
                    cutter.finish()
                    yield rows()
                cutter, place = _Cutter(file, block, *state), (file, block)
            cutter.add(value)
        if cutter and cutter.out:
            yield rows()
    if cutter:
        cutter.finish()
        yield rows()


def array_items(spark: SparkSession, path: str, item: str, glob: str = "*.json") -> DataFrame:
    """``file, ord, item``: the elements of JSON-array files, ``item`` being their type; ``ord`` is the position in the file.

    A file that isn't valid JSON, isn't a list, or holds an element of another kind than ``item`` is left out as a whole.
    """
    fragments = _fragments(spark, path, glob)
    transitions = fragments.mapInArrow(_transitions, f"file string, block bigint, {TRANSITION}")
    states = transitions.groupBy("file").applyInArrow(_composed, STATE)
    entered = fragments.join(F.broadcast(states), ["file", "block"], "left").select(
        "value", "file", "block", F.coalesce("inside", F.raise_error(F.lit("the files changed while they were read"))).alias("inside"),
        "depth", F.col("commas"), "closes", "last",
    )
    pieces = entered.mapInArrow(_pieces, PIECE)
    parts = pieces.where("NOT whole").groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", F.col("text").cast("string").alias("text")))).alias("parts"),
        F.sum("commas").alias("commas"), F.max("after").alias("after"), F.max("eof").alias("eof"), F.max("bad").alias("bad"),
    )
    joined = parts.select("file", "number", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "commas", "after", "eof", "bad")
    groups = pieces.where("whole").select("file", "number", F.col("text").cast("string").alias("text"), "commas", "after", "eof", "bad").unionByName(joined)

    first = F.col("number") == 0
    opening = F.when(first, F.lit(rf"\A\x{{feff}}?{_BLANK}\[")).otherwise(F.lit(rf"\A{_BLANK},"))
    closing = F.lit(rf"\]{_BLANK}\z")
    inner = F.regexp_replace(F.col("text"), opening, F.lit(""))
    inner = F.when(F.col("eof"), F.regexp_replace(inner, closing, F.lit(""))).otherwise(inner)
    items = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), f"array<{item}>", {"allowSingleQuotes": "false"})
    no_more = F.when(first, F.col("text").rlike(rf"\A\x{{feff}}?{_BLANK}\[{_BLANK}\]{_BLANK}\z")).otherwise(F.col("text").rlike(rf"\A{_BLANK}\]{_BLANK}\z"))
    empty = F.col("eof") & no_more
    within = F.col("commas") - F.when(first, 0).otherwise(1)  # commas between the group's elements
    framed = F.regexp_like("text", opening) & (~F.col("eof") | F.regexp_like("text", closing))
    parsed = groups.select("file", "after", "bad", within.alias("within"), (F.col("eof") & no_more).alias("empty"), framed.alias("framed"), items.alias("items"))
    whole = F.col("framed") & F.coalesce(F.size("items") == F.col("within") + 1, F.lit(False))
    checked = parsed.withColumn("right", ~F.col("bad") & (F.col("empty") | whole))
    wrong = checked.where("NOT right").select("file").distinct()
    found = checked.where("right AND NOT empty").select("file", (F.col("after") - F.col("within")).alias("begin"), F.posexplode("items").alias("place", "item"))
    return found.select("file", (F.col("begin") + F.col("place")).alias("ord"), "item").join(wrong, "file", "left_anti")


def write_arrays(df: DataFrame, path: str, by: str = "source", order: str = "ord", fields: list[str] | None = None) -> None:
    """One JSON-array file for each value of ``by``, in folders ``by=value``, elements in ``order``: the form :func:`array_items` reads.

    A single array is a single file, so one task writes all of a source, row after row; nothing of it is held.
    """
    names = fields or [c for c in df.columns if c not in (by, order)]
    at = Window.partitionBy(by).orderBy(order)
    before, behind = F.lag(F.lit(True)).over(at), F.lead(F.lit(True)).over(at)
    text: Column = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    line = F.concat(F.when(before.isNull(), "[").otherwise(","), text, F.when(behind.isNull(), "]").otherwise(""))
    df.select(by, line.alias("value")).write.mode("overwrite").partitionBy(by).option("compression", "none").text(path)
