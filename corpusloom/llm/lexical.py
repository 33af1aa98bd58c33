"""Ranked lexical search: exact inner products of sparse vectors through ball trees.

A document's vector has one coordinate for each term of the items that it holds, the term's integer share of the score; an
item's vector has a one at each of its terms. Their inner product is the document's score for the item. Tasks take up
documents ``CHUNK`` at a time and build a ball tree over them: a node holds the centroid and radius of its documents and the
terms that occur in them. With a node's centroid c, radius r and terms S, no document below it scores more than
``q.c + |q on S| r`` for an item q, since both are zero outside S. Nodes wait in a queue, best bound first, each with the
items that still want it; an item leaves a node whose bound, rounded up, is strictly below its score of rank ``top``. Leaves
are scored in integers. Each task keeps its best ``top`` documents of each item, and Spark merges these short lists.

Items are searched in blocks of about ``BLOCK`` (item, term) pairs, so what is sent to the workers is bounded; a block reads
the documents once. Document frequencies and lengths are counted by Spark over all documents.

Nulls: a null text has no terms, such documents count nowhere and such items give no rows. Rows that share an item id are one
item with the terms of all of them, a null id included. Documents are ranked row by row: repeated rows have ranks of their
own, rows without id (or with the id 2^63-1, which is returned as null) come last among equal scores. Empty tables give no
rows. Very long texts are read whole. Other columns are ignored, so their names may clash.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.llm.common import map_batches, slices, words, written

#: Results an item, documents of one tree, documents of a leaf, (item, term) pairs searched at once.
TOP, CHUNK, LEAF, BLOCK = 50, 4096, 32, 1 << 17
#: What computed bounds may lose by rounding: sums of fewer than 2^20 terms in doubles stay far below this share.
SLACK = 1e-9
#: Stands for a missing id, behind all others.
NO_KEY = np.iinfo(np.int64).max


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item`` and ``term`` (UTF-8), each pair once."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            found = [set(words(t)) for t in part.column("text").to_pylist()]
            number = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield {"item": part.column("item").take(pa.array(number)), "term": [t for f in found for t in f]}

    narrow = items.select(F.col(item).alias("item"), F.col(text).alias("text"))
    return map_batches(narrow, run, f"item {narrow.schema['item'].dataType.simpleString()}, term binary").distinct()


def vectors(documents: DataFrame, terms: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n`` (terms with repeats), and the numbers in ``terms`` of those that occur with their counts."""
    shared = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        number = shared.value.get
        for part in slices(batch, "text"):
            lengths, ids, tfs = [], [], []
            for one in part.column("text").to_pylist():
                found = words(one)
                counts = Counter(map(number, found))
                counts.pop(None, None)
                lengths.append(len(found))
                ids.append(list(counts))
                tfs.append(list(counts.values()))
            yield {"key": part.column("key"), "n": lengths, "ids": ids, "tfs": tfs}

    narrow = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return map_batches(narrow, run, "key bigint, n bigint, ids array<int>, tfs array<bigint>")


def term_weights(frequencies: np.ndarray, total: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in frequencies.tolist()], np.int64)


class Items:
    """The items of a block as sparse ones: ``ids`` of item i lie at ``begins[i]`` and after."""

    def __init__(self, numbers: np.ndarray, terms: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((terms, numbers))
        self.ids, self.n_terms = terms[order], n_terms
        self.count = int(numbers.max()) + 1
        self.lengths = np.bincount(numbers, minlength=self.count)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def dense(self, chosen: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Ones where a chosen item (row) holds one of the sorted terms (column)."""
        lengths = self.lengths[chosen]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(self.begins[chosen] - (ends - lengths), lengths)
        ids, row = self.ids[at], np.repeat(np.arange(len(chosen)), lengths)
        place = np.minimum(np.searchsorted(terms, ids), len(terms) - 1)
        held = terms[place] == ids
        out = np.zeros((len(chosen), len(terms)), np.int64)
        out[row[held], place[held]] = 1
        return out


class Ball:
    """A node: centroid and terms of its documents (sparse), radius rounded up, and either children or rows."""

    __slots__ = ("terms", "centre", "radius", "children", "rows", "lens", "ids", "vals")

    def __init__(self, rows: np.ndarray, lens: np.ndarray, ids: np.ndarray, vals: np.ndarray, n_terms: int) -> None:
        begins = np.concatenate(([0], np.cumsum(lens)[:-1]))
        mean = np.bincount(ids, vals, n_terms) / len(rows)
        self.terms = np.unique(ids)
        self.centre = mean[self.terms]
        # distances by their differences, not by expanded squares, which cancel
        inside = np.add.reduceat((vals - mean[ids]) ** 2, begins)
        outside = np.maximum(self.centre @ self.centre - np.add.reduceat(mean[ids] ** 2, begins), 0)
        around = self.centre @ self.centre
        self.radius = math.sqrt(float((inside + outside).max()) * (1 + SLACK) + SLACK * around) * (1 + SLACK)
        self.children, self.rows, self.lens, self.ids, self.vals = (), rows, lens, ids, vals
        if len(rows) <= LEAF:
            return
        first = self._far(rows, begins, int(np.argmax(inside + outside)), n_terms)
        second = self._far(rows, begins, first, n_terms)
        axis = np.zeros(n_terms)
        for place, sign in ((first, -1.0), (second, 1.0)):
            span = slice(begins[place], begins[place] + lens[place])
            axis[ids[span]] += sign * vals[span]
        along = np.add.reduceat(vals * axis[ids], begins)
        left = np.zeros(len(rows), bool)
        left[np.argsort(along, kind="stable")[: len(rows) // 2]] = True
        held = np.repeat(left, lens)
        self.children = tuple(Ball(rows[side], lens[side], ids[part], vals[part], n_terms) for side, part in ((left, held), (~left, ~held)))
        self.rows = self.lens = self.ids = self.vals = None

    def _far(self, rows: np.ndarray, begins: np.ndarray, place: int, n_terms: int) -> int:
        """The document farthest from the one at ``place``."""
        point = np.zeros(n_terms)
        span = slice(begins[place], begins[place] + self.lens[place])
        point[self.ids[span]] = self.vals[span]
        return int(np.argmax(np.add.reduceat(self.vals * (self.vals - 2 * point[self.ids]), begins)))

    def bounds(self, items: Items, centre: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Most that a document of this node can score, for each item; ``centre`` and ``held`` are zeros to work with."""
        centre[self.terms], held[self.terms] = self.centre, 1.0
        middle = np.add.reduceat(centre[items.ids], items.begins)
        share = np.add.reduceat(held[items.ids], items.begins)
        centre[self.terms], held[self.terms] = 0.0, 0.0
        return np.where(share > 0, (middle + np.sqrt(share) * self.radius) * (1 + SLACK) + 1, 0.0)

    def scores(self, items: Items, chosen: np.ndarray) -> np.ndarray:
        """Exact scores of this leaf's documents (columns) for the chosen items (rows)."""
        dense = np.zeros((len(self.rows), len(self.terms)), np.int64)
        dense[np.repeat(np.arange(len(self.rows)), self.lens), np.searchsorted(self.terms, self.ids)] = self.vals.astype(np.int64)
        ones = items.dense(chosen, self.terms)
        if int(dense.max(initial=0)) * len(self.terms) < 1 << 53:  # all sums are whole numbers that doubles hold
            return (ones.astype(np.float64) @ dense.T.astype(np.float64)).astype(np.int64)
        return ones @ dense.T


class Best:
    """The best ``top`` documents of each item so far: higher scores first, ties by smaller key; a score of 0 is a free place."""

    def __init__(self, count: int, top: int) -> None:
        self.scores, self.keys, self.top = np.zeros((count, top), np.int64), np.full((count, top), NO_KEY), top

    def least(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], 1)

    def add(self, chosen: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        new = (scores >= self.least()[chosen][:, None]).any(axis=1)
        chosen, scores = chosen[new], scores[new]
        if not len(chosen):
            return
        scores = np.concatenate((self.scores[chosen], scores), axis=1)
        keys = np.concatenate((self.keys[chosen], np.broadcast_to(keys, (len(chosen), len(keys)))), axis=1)
        order = np.lexsort((keys, -scores), axis=1)[:, : self.top]
        self.scores[chosen], self.keys[chosen] = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)


def search(root: Ball, items: Items, keys: np.ndarray, best: Best) -> int:
    """Puts the documents below ``root`` into ``best``; the number of leaves scored."""
    centre, held = np.zeros(items.n_terms), np.zeros(items.n_terms)
    everyone = np.arange(items.count)
    tick, opened = 0, 0
    queue = [(-math.inf, tick, root, everyone, root.bounds(items, centre, held))]
    while queue:
        _, _, node, chosen, bound = heapq.heappop(queue)
        wanted = bound >= best.least()[chosen]
        chosen = chosen[wanted]
        if not len(chosen):
            continue
        if node.rows is not None:
            best.add(chosen, node.scores(items, chosen), keys[node.rows])
            opened += 1
            continue
        for child in node.children:
            bound = child.bounds(items, centre, held)[chosen]
            wanted = bound >= best.least()[chosen]
            if wanted.any():
                tick += 1
                heapq.heappush(queue, (-float(bound[wanted].max()), tick, child, chosen[wanted], bound[wanted]))
    return opened


def shares(weights: np.ndarray, ids: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, n: np.ndarray, total: int, tokens: int) -> np.ndarray:
    """A document's integer share of the score for each of its terms."""
    m = np.repeat(100 - 50 + (50 * n * total) // tokens, lengths)
    return weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


def rank(documents: DataFrame, benchmark: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``top`` documents of highest score above 0: ``item``, ``rank`` (from 1), ``key``, ``score``."""
    spark = documents.sparkSession
    pairs = written(item_terms(benchmark, item, item_text))
    blocks = 1 + pairs.count() // BLOCK
    kind = pairs.schema["item"].dataType
    out = []
    for block in range(blocks):
        # of the order of BLOCK pairs, as items are dealt by hash; one item is never divided
        held = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if not held:
            continue
        names, terms = list(dict.fromkeys(r["item"] for r in held)), sorted({bytes(r["term"]) for r in held})
        named, at = {n: i for i, n in enumerate(names)}, {t: i for i, t in enumerate(terms)}
        items = Items(np.array([named[r["item"]] for r in held]), np.array([at[bytes(r["term"])] for r in held]), len(terms))
        found = best_documents(written(vectors(documents, terms, key, text)), items, top)
        numbers = spark.createDataFrame(list(enumerate(names)), StructType([StructField("number", IntegerType()), StructField(item, kind)]))
        out.append(found.join(F.broadcast(numbers), "number").select(F.col(item).alias("item"), "rank", "key", "score"))
    if not out:
        return spark.createDataFrame([], StructType([StructField("item", kind)])).selectExpr(
            "item", "0 AS rank", "0L AS key", "0L AS score").toDF(item, "rank", key, "score")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole.toDF(item, "rank", key, "score")


def best_documents(table: DataFrame, items: Items, top: int) -> DataFrame:
    """``number`` (of the item), ``rank``, ``key``, ``score`` over the vectors of a written ``table``."""
    sc = table.sparkSession.sparkContext
    counted = table.where("n > 0").agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("tokens")).first()
    total, tokens = counted["total"], counted["tokens"]
    frequencies = np.zeros(items.n_terms, np.int64)
    for r in table.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row for each term of the block
        frequencies[r["id"]] = r["count"]
    shared = sc.broadcast((items, term_weights(frequencies, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        best = Best(block.count, top)
        waiting: list[tuple] = []

        def settle() -> None:
            keys, n, lens, ids, tfs = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            vals = shares(weights, ids, tfs, lens, n, total, tokens)
            kept = vals > 0
            row = np.repeat(np.arange(len(lens)), lens)[kept]
            lens = np.bincount(row, minlength=len(lens))
            rows = np.flatnonzero(lens)
            if len(rows):
                search(Ball(rows, lens[rows], ids[kept], vals[kept].astype(np.float64), block.n_terms), block, keys, best)

        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                ids, tfs = part.column("ids"), part.column("tfs")
                keys = part.column("key").fill_null(int(NO_KEY)).to_numpy()
                waiting.append((keys, part.column("n").to_numpy(), ids.value_lengths().to_numpy(),
                                ids.flatten().to_numpy(), tfs.flatten().to_numpy()))
                if sum(len(w[0]) for w in waiting) >= CHUNK:
                    settle()
        if waiting:
            settle()
        number, place = np.nonzero(best.scores)
        keys = best.keys[number, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), pa.array(keys, pa.int64(), mask=keys == NO_KEY), pa.array(best.scores[number, place])],
            ["number", "key", "score"],
        )

    lists = table.where("n > 0 AND size(ids) > 0").mapInArrow(run, "number int, key bigint, score bigint")
    # as many rows of an item as tasks times top
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("number", "rank", "key", "score")
