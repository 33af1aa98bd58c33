"""Document fingerprints as invertible Bloom lookup tables.

A text is cut into paragraphs: lines, cut further after sentences; a run of over ``LONG`` words without a sentence mark is cut
after words chosen by their last bytes, and after ``WORDS`` words at the latest. So equal passages are cut alike wherever they
stand. The digest of each paragraph (with its number among equal ones) is added to three cells of a table of counts, key sums
and check sums. A third of a table has a power of two of cells, at least half the number of paragraphs and ``LEAST``, so a larger table
folds to the size of a smaller one. Tables of two versions subtract cell by cell; peeling cells that hold one key recovers
the digests that differ. If that fails, the number of differences is estimated from the counts that are left, and tables of
that size, with other places, are built from the digests, doubling until it succeeds. The likeness of two versions is the
share of their digests that they have in common.

:func:`decode` and :func:`decoded` subtract and peel two stored fingerprints, without the texts.

All texts of a block are built, subtracted and peeled together in flat arrays.

Versions that follow each other in an order are paired in one shuffle: the order is cut into ranges, each range goes to a
task together with the first row of the range that follows it.

Nulls: a null text is empty; two empty texts have likeness 1. Rows without ``doc_id`` come last in the order, ties are
ordered by a hash of the text and the text; repeated rows are paired once each. A single document follows itself. Empty
tables give empty results. Other columns are ignored. A null fingerprint decodes like that of an empty text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, utf8, written
from corpusloom.operators.ordering import _add_value_blocks

#: Words of a paragraph without a sentence mark before it is cut, at the earliest and at the latest; bytes of text in a block.
LONG, WORDS, BLOCK = 16, 48, 1 << 20
#: Cells of the least third of a stored fingerprint, a power of two.
LEAST = 8
#: Rows of the sample that cuts the order into ranges, for each range.
SAMPLED = 20
#: A cell of a stored fingerprint.
CELL = np.dtype([("n", "<i4"), ("key", "<u8"), ("check", "<u8")])
MARKS = np.frombuffer(b".!?", np.uint8)
STEP, SEEDS = np.uint64(0x9E3779B97F4A7C15), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed & 0xFFFFFFFFFFFFFFFF)) * STEP
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def paragraphs(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All paragraphs of the texts in order, and the place of each one's text."""
    datas = [utf8(t) + b"\n" for t in texts]
    data = b"".join(datas)
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:])  # last bytes of words
    if not len(ends):
        return [], np.zeros(0, np.int64)
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    lines = np.cumsum(raw == 10)
    new_line = np.append(lines[starts[1:]] != lines[ends[:-1]], True)
    final = raw[ends]
    ideographic = (final == 0x82) & (raw[ends - 1] == 0x80) & (raw[ends - 2] == 0xE3)
    cut = new_line | np.isin(final, MARKS) | ideographic
    number = np.arange(len(ends))

    def since() -> np.ndarray:
        """Words since the last cut, this one left out."""
        return number - np.maximum.accumulate(np.where(np.concatenate(([True], cut[:-1])), number, 0))

    cut |= (since() >= LONG) & ((final.astype(int) * 7 + raw[ends - 1] * 13) % 16 == 0)
    cut |= since() % WORDS == WORDS - 1
    stop = np.flatnonzero(cut)
    begin = np.concatenate(([0], stop[:-1] + 1))
    row = np.searchsorted(np.cumsum([len(d) for d in datas]), starts[begin], "right")
    return [data[a:b] for a, b in zip(starts[begin].tolist(), (ends[stop] + 1).tolist(), strict=True)], row


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs, the n-th of equal ones in a text with its own, and the place of each one's text."""
    found, row = paragraphs(texts)
    digest = xxhash.xxh64_intdigest
    keys = np.array([digest(p) for p in found], np.uint64)
    order = np.lexsort((keys, row))
    same = np.zeros(len(keys), bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (row[order][1:] == row[order][:-1])
    at = np.arange(len(keys))
    nth = at - np.maximum.accumulate(np.where(same, 0, at)) if len(at) else at
    out = keys.copy()
    out[order] = mixed(keys[order] + nth.astype(np.uint64) * STEP, 1)
    return out, row


class Tables:
    """A table of three times ``thirds`` cells (powers of two) for every text, in flat arrays."""

    def __init__(self, thirds: np.ndarray, attempt: int = 0) -> None:
        self.thirds, self.attempt = thirds, attempt
        self.first = np.concatenate(([0], np.cumsum(3 * thirds)))
        self.count = np.zeros(self.first[-1], np.int64)
        self.key, self.check = np.zeros((2, self.first[-1]), np.uint64)

    def places(self, keys: np.ndarray, row: np.ndarray) -> Iterator[np.ndarray]:
        third = self.thirds[row]
        for n, seed in enumerate(SEEDS):
            yield self.first[row] + n * third + (mixed(keys, seed + 977 * self.attempt) & (third - 1).astype(np.uint64)).astype(np.int64)

    def add(self, keys: np.ndarray, row: np.ndarray, sign: np.ndarray | int = 1) -> Tables:
        factor = np.broadcast_to(np.asarray(sign), keys.shape).astype(np.int64)
        wide = factor.astype(np.uint64)
        checks = mixed(keys, 2)
        for at in self.places(keys, row):
            np.add.at(self.count, at, factor)
            np.add.at(self.key, at, keys * wide)
            np.add.at(self.check, at, checks * wide)
        return self

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.thirds, self.attempt)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def folded(self, thirds: np.ndarray) -> Tables:
        """The same tables with no more than ``thirds`` cells a third; a place depends on its last bits only."""
        out = Tables(thirds, self.attempt)
        owner = self.owner()
        part, place = np.divmod(np.arange(self.first[-1]) - self.first[owner], self.thirds[owner])
        at = out.first[owner] + part * thirds[owner] + (place & (thirds[owner] - 1))
        for mine, theirs in ((out.count, self.count), (out.key, self.key), (out.check, self.check)):
            np.add.at(mine, at, theirs)
        return out

    def owner(self) -> np.ndarray:
        """The text of every cell."""
        return np.repeat(np.arange(len(self.thirds)), 3 * self.thirds)

    def estimate(self) -> np.ndarray:
        """About how many keys each difference holds: keys of random place and sign leave counts whose squares add up to
        their number, but for the part that one sign has more of."""
        owner = self.owner()
        size = len(self.thirds)
        squares = np.bincount(owner, self.count.astype(float) ** 2, size) / 3
        more = np.bincount(owner, self.count.astype(float), size) / 3
        return np.maximum(np.maximum(squares - more**2 / self.thirds, np.abs(more)), 1)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys that differ, their texts, their signs, and for each text whether all were recovered."""
        owner = self.owner()
        out = []
        while True:
            single = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[single].astype(np.int64)
            keys = self.key[single] * sign.astype(np.uint64)
            pure = mixed(keys, 2) == self.check[single] * sign.astype(np.uint64)
            if not pure.any():
                break
            keys, sign, row = keys[pure], sign[pure], owner[single[pure]]
            _, first = np.unique(keys + row.astype(np.uint64) * STEP, return_index=True)
            keys, sign, row = keys[first], sign[first], row[first]
            out.append((keys, row, sign))
            self.add(keys, row, -sign)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = np.ones(len(self.thirds), bool)
        done[owner[left]] = False
        keys, row, sign = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return keys, row, sign, done

    def texts(self) -> list[str]:
        """Each table as text: count, key and check of every cell."""
        packed = np.zeros(len(self.count), CELL)
        packed["n"], packed["key"], packed["check"] = self.count, self.key, self.check
        whole, width = packed.tobytes(), packed.itemsize
        return [base64.b64encode(whole[a * width : b * width]).decode() for a, b in zip(self.first[:-1], self.first[1:], strict=True)]


def read_back(prints: list[str | None]) -> Tables:
    """The tables of stored fingerprints; null is the table of an empty text."""
    cells = [np.frombuffer(base64.b64decode(p), CELL) if p is not None else np.zeros(3 * LEAST, CELL) for p in prints]
    out = Tables(np.array([len(c) // 3 for c in cells], np.int64))
    if cells:
        whole = np.concatenate(cells)
        out.count, out.key, out.check = whole["n"].astype(np.int64), whole["key"].copy(), whole["check"].copy()
    return out


Digests = tuple[np.ndarray, np.ndarray]


def powers(n: np.ndarray) -> np.ndarray:
    """The least powers of two that aren't below ``n``."""
    return 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def stored(one: Digests, size: int) -> Tables:
    """The tables that serve as fingerprints; their size follows from the text's own paragraphs."""
    return Tables(powers(np.maximum(np.bincount(one[1], minlength=size) / 2, LEAST))).add(*one)


def difference(first: Tables, second: Tables) -> Tables:
    """One minus the other, both at the smaller size."""
    thirds = np.minimum(first.thirds, second.thirds)
    return first.folded(thirds).minus(second.folded(thirds))


def decode(one: str | None, two: str | None) -> tuple[list[int], list[int], bool]:
    """The digests that only the first and only the second of two stored fingerprints holds, and whether these are all."""
    keys, _, sign, done = difference(read_back([one]), read_back([two])).peel()
    return sorted(keys[sign > 0].tolist()), sorted(keys[sign < 0].tolist()), bool(done[0])


def decoded(pairs: DataFrame, key: str, one: str = "fingerprint", two: str = "edited_fingerprint") -> DataFrame:
    """Key, ``only_one``, ``only_two`` (digests as 64-bit integers) and ``complete`` for every row's two stored fingerprints."""
    narrow = pairs.select(F.col(key).alias("key"), F.col(one).alias("one"), F.col(two).alias("two"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        first, second = (read_back(batch.column(c).to_pylist()) for c in ("one", "two"))
        keys, row, sign, done = difference(first, second).peel()

        def lists(of: int) -> list[list[int]]:
            out: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for r, k in sorted(zip(row[sign == of].tolist(), keys[sign == of].view(np.int64).tolist(), strict=True)):
                out[r].append(k)
            return out

        yield {"key": batch.column("key"), "only_one": lists(1), "only_two": lists(-1), "complete": done}

    kind = narrow.schema["key"].dataType.simpleString()
    return map_batches(narrow, run, f"key {kind}, only_one array<bigint>, only_two array<bigint>, complete boolean").withColumnRenamed("key", key)


def differences(one: Digests, two: Digests, first: Tables, second: Tables) -> np.ndarray:
    """For each pair of versions the number of digests that differ, from the stored tables or, where these can't be peeled,
    from tables of the size that they suggest."""
    size = len(first.thirds)
    left = difference(first, second)
    guess, thirds = left.estimate(), left.thirds
    _, row, _, done = left.peel()
    out = np.bincount(row, minlength=size)
    thirds = np.maximum(2 * thirds, powers(guess / 2))
    attempt = 0
    while not done.all():
        attempt += 1
        todo = np.flatnonzero(~done)
        place = np.full(size, -1)
        place[todo] = np.arange(len(todo))
        a, b = ((keys[place[row] >= 0], place[row[place[row] >= 0]]) for keys, row in (one, two))
        _, found, _, right = Tables(thirds[todo], attempt).add(*a).minus(Tables(thirds[todo], attempt).add(*b)).peel()
        out[todo] = np.bincount(found, minlength=len(todo))
        done[todo] = right
        thirds = 2 * thirds
    return out


def likeness(differing: np.ndarray, one: Digests, two: Digests) -> np.ndarray:
    total = np.bincount(one[1], minlength=len(differing)) + np.bincount(two[1], minlength=len(differing))
    return np.where(total > 0, 1 - differing / np.maximum(total, 1), 1.0)


def edited(text: str, follower: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``follower``."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(pairs: list[tuple[str, str]]) -> list[list]:
    """The values of ``COLUMNS``, column by column, for pairs of a text and the one that follows it."""
    texts, followers = [p[0] for p in pairs], [p[1] for p in pairs]
    versions = [edited(t, f) for t, f in pairs]
    own, changed, after = digests(texts), digests(versions), digests(followers)
    size = len(pairs)
    first, second, third = (stored(d, size) for d in (own, changed, after))
    return [
        [len(t) for t in texts], [hashlib.sha256(utf8(v)).hexdigest() for v in versions], first.texts(), second.texts(),
        likeness(differences(own, changed, first, second), own, changed), likeness(differences(own, after, first, third), own, after),
    ]


def ranges(narrow: DataFrame, parts: int) -> DataFrame:
    """``narrow`` (``key``, ``text``) with ``part`` and ``extra``: consecutive ranges of its order by key and hash, and in each
    range, marked ``extra``, also the row at the top of the next lower range (in the lowest, that of the highest).

    The ranges are cut by a sample of keys and hashes, the rows at their tops are one for each range.
    """
    placed = narrow.withColumn("at", F.struct("key", F.xxhash64("text").alias("hash")))
    chosen = placed.select("at").orderBy(F.xxhash64("at.key", "at.hash"), "at").limit(SAMPLED * parts)
    ordered = chosen.agg(F.array_sort(F.collect_list("at")).alias("all"))
    every = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.get("all", F.call_function("div", i * F.size("all"), F.lit(parts)).cast("int")))
    cuts = written(ordered.select((every if parts > 1 else F.slice("all", 1, 0)).alias("cuts"))).scalar()
    placed = _add_value_blocks(placed, "at", cuts, parts - 1)
    below = Window.orderBy("block")  # a row for each range
    tops = placed.groupBy("block").agg(F.max("at").alias("top"))
    tops = tops.withColumn("above", F.coalesce(F.lead("block").over(below), F.min("block").over(Window.partitionBy(F.lit(0)))))
    both = placed.join(F.broadcast(written(tops)), "block")

    def place(part: str, extra: bool) -> Column:
        return F.struct(F.col(part).alias("part"), F.lit(extra).alias("extra"))

    twice = F.when(F.col("at") == F.col("top"), F.array(place("block", False), place("above", True))).otherwise(F.array(place("block", False)))
    return both.select("key", "text", F.col("at.hash").alias("hash"), F.inline(twice))


def version_fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``COLUMNS`` of every row; each is followed by the one with the next smaller key, the last by the first.

    The tasks are as many as ``spark.sql.shuffle.partitions`` says.
    """
    narrow = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges(narrow, parts).repartitionById(parts, F.col("part"))
    ordered = dealt.sortWithinPartitions("extra", F.col("key").desc_nulls_last(), F.desc("hash"), F.desc("text")).select("key", "text", "extra")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = narrow.schema["key"].dataType
    names = ["key", *(c.split()[0] for c in COLUMNS.split(", "))]
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows(keys: list, pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([keys, *compared(pairs)], types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, keys, pairs, held = None, [], [], 0
        for batch in batches:
            for k, t, extra in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "extra")), strict=True):
                if before is not None:
                    keys.append(before[0])
                    pairs.append((before[1], t))
                    held += len(before[1])
                    if held > BLOCK:
                        yield rows(keys, pairs)
                        keys, pairs, held = [], [], 0
                before = None if extra else (k, t)
        if pairs:
            yield rows(keys, pairs)

    return ordered.mapInArrow(run, f"key {kind.simpleString()}, {COLUMNS}").withColumnRenamed("key", key)
