"""Best-fit packing of token pieces into sequences (large-item matching).

Lengths are small integers, so a plan needs no more than the number of pieces of each length: at most ``capacity``
numbers, however many pieces there are. The plan is a list of groups of equal sequences; every piece finds its place by
its length and its rank among the pieces of that length, which are counted in salted groups. No task sees more than a
salt group, nothing but the length counts reaches the driver.

Nulls: a null text is empty (one piece, the closing id alone); a null ``length`` is an error of the caller.
Repeated rows are packed once each. Empty tables give empty results. Other columns are carried by :func:`pack` and
ignored by :func:`pieces`.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, slices, written

#: Rows of one length that one window task ranks.
RANKED = 100_000
#: Chunks and words whose ids a worker remembers, and the longest of them in characters.
CHUNKS, WORDS, LONGEST = 250_000, 700_000, 40


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers, for vocabularies that put letters in lower case, never join
    what blanks or ASCII punctuation separate, and mark the last piece of a word.

    A text's ids are those of its blank-separated chunks in turn. A chunk that is a word and then punctuation is looked
    up in these two parts, any other is encoded as it is. Distinct words are encoded many at a time and cut apart at the
    pieces that end a word. Both memories are emptied when they are full.
    """

    #: Punctuation that splits off a word; an apostrophe may not.
    SIGNS = "!#$%&*,.:;?|"

    def __init__(self, path: str) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many workers as there are cores
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for text in texts]
        if len(self.chunks) > CHUNKS:
            self.chunks = {}
        if len(self.words) > WORDS:
            self.words = {}
        chunks = self.chunks
        new = list(set(itertools.chain.from_iterable(parts)).difference(chunks))
        split = {}
        for chunk in new:
            word = chunk.rstrip(self.SIGNS)
            if word.isalpha() and word.lower().isalpha() and "\u03a3" not in word and unicodedata.is_normalized("NFC", word):
                split[chunk] = word.lower(), chunk[len(word):]
        self._learn({part for pair in split.values() for part in pair if part}.difference(self.words))
        whole = [chunk for chunk in new if chunk not in split]
        for chunk, found in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            chunks[chunk] = np.array(found.ids, "<u4").tobytes()
        words = self.words
        for chunk, (word, signs) in split.items():
            chunks[chunk] = words[word] + words[signs] if signs else words[word]
        out = [b"".join(map(chunks.__getitem__, some)) for some in parts]
        for chunk in new:
            if len(chunk) > LONGEST:
                del chunks[chunk]
                words.pop(split.get(chunk, ("",))[0], None)
        return out

    def _learn(self, new: set[str], together: int = 500) -> None:
        """Ids of words and runs of signs, ``together`` of them in one encoding."""
        items = list(new)
        groups = [items[i : i + together] for i in range(0, len(items), together)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(group):  # a part is more than one word of the vocabulary
                for item, one in zip(group, self.tokenizer.encode_batch_fast(group, add_special_tokens=False), strict=True):
                    self.words[item] = np.array(one.ids, "<u4").tobytes()
                continue
            data = ids.tobytes()
            for item, begin, end in zip(group, [0, *ends], ends, strict=False):
                self.words[item] = data[4 * begin : 4 * end]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of whole texts: key, ``piece`` (from 0), ``start``, ``length``, ``ids`` (little-endian 32-bit).

    Each document's ids are those of its text and then ``end``; only longer ones are cut, after every ``capacity`` ids.
    """
    closing, width = np.array([end], "<u4").tobytes(), 4 * capacity

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            out: dict[str, list] = {"key": [], "piece": [], "start": [], "length": [], "ids": []}
            keys, texts = part.column("key").to_pylist(), [t or "" for t in part.column("text").to_pylist()]
            for k, ids in zip(keys, encoder(tokenizer).encode(texts), strict=True):
                ids += closing
                for n, at in enumerate(range(0, len(ids), width)):
                    one = ids[at : at + width]
                    for column, value in zip(out.values(), (k, n, at // 4, len(one) // 4, one), strict=True):
                        column.append(value)
            yield out

    narrow = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    cut_up = map_batches(narrow, cut, f"key {kind}, piece int, start bigint, length bigint, ids binary")
    return cut_up.withColumnRenamed("key", key)


class Plan:
    """Groups of equal sequences for the numbers of pieces of each length.

    Pieces above a third of the capacity stand at most twice in a sequence: from the longest down, each is matched with
    the longest one that still fits. The smaller ones, from the longest down, go where the gap left is smallest.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: first rank, first sequence, offset
        self.used: dict[int, int] = {}
        self.left = {n: c for n, c in counts.items() if c}
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: first sequence, number of sequences
        self.open: list[int] = []  # gaps in use, in ascending order
        self._match()
        self._fit()

    def _put(self, length: int, sequence: int, times: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.slots.setdefault(length, []).append((rank, sequence, offset))
        self.used[length] = rank + times
        self.left[length] -= times

    def _leave(self, gap: int, sequence: int, times: int) -> None:
        if gap and times:
            if gap not in self.gaps:
                bisect.insort(self.open, gap)
                self.gaps[gap] = []
            self.gaps[gap].append((sequence, times))

    def _new(self, times: int) -> int:
        self.sequences += times
        return self.sequences - times

    def _match(self) -> None:
        large = sorted(n for n in self.left if 3 * n > self.capacity)
        while large:
            longest = large[-1]
            if not self.left[longest]:
                large.pop()
                continue
            at = bisect.bisect_right(large, self.capacity - longest)
            while at and not self.left[large[at - 1]]:
                large.pop(at - 1)
                at -= 1
            partner = large[at - 1] if at else 0
            if partner == longest and self.left[longest] == 1:
                partner = large[at - 2] if at > 1 else 0
                if partner and not self.left[partner]:
                    large.pop(at - 2)
                    continue
            if not partner:
                times = self.left[longest]
            elif partner == longest:
                times = self.left[longest] // 2
            else:
                times = min(self.left[longest], self.left[partner])
            first = self._new(times)
            self._put(longest, first, times, 0)
            if partner:
                self._put(partner, first, times, longest)
            self._leave(self.capacity - longest - partner, first, times)

    def _fit(self) -> None:
        for length in sorted((n for n in self.left if 3 * n <= self.capacity), reverse=True):
            while count := self.left[length]:
                at = bisect.bisect_left(self.open, length)
                if at < len(self.open):
                    gap = self.open[at]
                    first, times = self.gaps[gap].pop()
                    if not self.gaps[gap]:
                        del self.gaps[gap], self.open[at]
                else:
                    gap = self.capacity
                    times = -(-count // (gap // length))
                    first = self._new(times)
                each = gap // length
                full = min(times, count // each)
                for i in range(each if full else 0):
                    self._put(length, first, full, self.capacity - gap + i * length)
                self._leave(gap - each * length, first, full)
                if full < times:  # fewer pieces left than one sequence takes
                    rest = count - full * each
                    for i in range(rest):
                        self._put(length, first + full, 1, self.capacity - gap + i * length)
                    self._leave(gap - rest * length, first + full, bool(rest))
                    self._leave(gap, first + full + bool(rest), times - full - bool(rest))


def pack(table: DataFrame, capacity: int = 2048) -> DataFrame:
    """Every row of ``table`` (a piece each, ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    ``table`` is read three times (number, counts, places); write it first where that is dear.
    """
    for name in ("_salt", "_rank", "_before", "_place"):
        if name in table.columns:
            raise ValueError(f"column {name} is reserved")
    salts = 1 + table.count() // RANKED
    others = [c for c in table.columns if c not in ("sequence_id", "offset")]
    salted = table.select(others).withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    if salts > 1:
        counts = written(counts)
    before = counts.select(
        "length", "_salt",
        F.coalesce(F.sum("_rows").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    histogram = {int(r["length"]): r["n"] for r in counts.groupBy("length").agg(F.sum("_rows").alias("n")).collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("length must be from 1 to the capacity")
    slots = {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in Plan(histogram, capacity).slots.items()}

    @F.pandas_udf("struct<sequence_id bigint, offset bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), np.int64)
        for n, where in length.groupby(length).indices.items():
            first_rank, first_sequence, offset = slots[int(n)]
            ranks = rank.to_numpy()[where]
            at = np.searchsorted(first_rank, ranks, "right") - 1
            out[where, 0], out[where, 1] = first_sequence[at] + ranks - first_rank[at], offset[at]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    order = Window.partitionBy("length", "_salt").orderBy(*[c for c in others if c != "length"] or [F.lit(0)])
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"])
    placed = ranked.withColumn("_place", place("length", (F.col("_rank") + F.col("_before")).cast("long")))
    return placed.select(*others, "_place.sequence_id", "_place.offset")
