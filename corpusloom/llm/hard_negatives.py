"""Hard negatives by R-trees packed with sort-tile-recursive (STR).

Rows are tiled by label and then along the coordinates of largest variance. The cuts come from a sample of at most about
``SAMPLE`` rows, every row is placed; a tile is a run of neighbouring rows in one file. A task packs the rows that it reads,
``TREE`` at a time, into an R-tree by the same sorting and tiling. A node's box gives, coordinate by coordinate, the least
and the most that each product with an anchor can be, and so an interval for the inner product of all rows below it.
Searches keep nodes in a queue, best bound first; a query leaves a node whose interval misses its score window, whose upper
end lies strictly below the query's score of rank k, or whose label is the wrong one. Leaves are scored exactly.

Anchors are searched in blocks of about ``ANCHORS`` against all rows, in two rounds (positives, then negatives in the window of
each anchor and positive). A round takes every ``STRIDE``-th tile first: the scores of rank k found there bound what the other
tiles have to return.

A component x becomes ``floor(scale * x)``. Rows with a null id, label, vector or component, or with one that isn't finite,
take no part. Shorter vectors are filled up with zeros; an empty vector scores 0. Rows that repeat id, label and vector count
once; other rows that share an id are rows of their own and never each other's partner. Ties go to the smaller id. Scores
beyond 2^53 / 100 raise a ValueError before any search. Empty tables and tables without anchors give no rows. Other columns
are ignored, so their names may clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, written

#: Rows a tile and most tiles, sampled rows for the cuts, rows of one tree, rows of a leaf, children of a node.
TILE, TILES, SAMPLE, TREE, LEAF, FAN = 4096, 4096, 16384, 16384, 64, 16
#: Anchors searched at once; every STRIDE-th tile is searched first.
ANCHORS, STRIDE = 2048, 8
#: Stands for a free place in a list of results.
NONE = -(1 << 62)
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(vectors: DataFrame, anchor: Column, scale: int, key: str, label: str, vector: str) -> DataFrame:
    """``id``, ``label``, ``vec`` (whole numbers as doubles), ``anchor`` of the rows that take part, each once."""
    numbers = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    chosen = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
    return chosen.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), numbers.alias("vec"),
                         F.coalesce(anchor, F.lit(False)).alias("anchor")).distinct()


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
    return out


def by_variance(vecs: np.ndarray, pages: int) -> list[int]:
    """The coordinates to tile along: those of largest variance, as many as two-way cuts would need."""
    return np.argsort(-vecs.var(axis=0), kind="stable")[: max(1, int(pages - 1).bit_length())].tolist()


def slabs(pages: int, dims: int) -> int:
    return int(np.ceil(pages ** (1 / dims)))


def str_order(vecs: np.ndarray, rows: np.ndarray, dims: list[int], page: int) -> Iterator[np.ndarray]:
    """The pages of STR: sort by a coordinate, cut into slabs of whole pages, tile each slab along the next one."""
    if len(rows) <= page or not dims:
        yield from (rows[i : i + page] for i in range(0, len(rows), page))
        return
    pages = -(-len(rows) // page)
    rows = rows[np.argsort(vecs[rows, dims[0]], kind="stable")]
    width = -(-pages // slabs(pages, len(dims))) * page
    for begin in range(0, len(rows), width):
        yield from str_order(vecs, rows[begin : begin + width], dims[1:], page)


class Tiling:
    """Places rows in tiles: by label, then by cuts along coordinates, all from a sample."""

    def __init__(self, labels: np.ndarray, vecs: np.ndarray, tiles: int) -> None:
        self.cuts: dict[int, tuple] = {}
        self.count = 1  # tile 0 takes labels that the sample lacks
        for one in np.unique(labels).tolist():
            inside = vecs[labels == one]
            pages = max(1, round(tiles * len(inside) / len(labels)))
            self.cuts[one] = self._cut(inside, by_variance(inside, pages), pages)

    def _cut(self, vecs: np.ndarray, dims: list[int], pages: int) -> tuple:
        if pages <= 1 or not dims or len(vecs) < 2:
            self.count += 1
            return (self.count - 1,)
        n = slabs(pages, len(dims))
        along = np.sort(vecs[:, dims[0]])
        bounds = np.unique(along[[len(along) * i // n for i in range(1, n)]])
        slab = np.searchsorted(bounds, vecs[:, dims[0]], "right")
        return dims[0], bounds, [self._cut(vecs[slab == i], dims[1:], -(-pages // n)) for i in range(len(bounds) + 1)]

    def place(self, labels: np.ndarray, vecs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(labels), np.int64)

        def walk(rows: np.ndarray, cut: tuple) -> None:
            if len(cut) == 1:
                out[rows] = cut[0]
            elif len(rows):
                dim, bounds, parts = cut
                slab = np.searchsorted(bounds, vecs[rows, dim], "right")
                for i, part in enumerate(parts):
                    walk(rows[slab == i], part)

        for one in np.unique(labels).tolist():
            if one in self.cuts:
                walk(np.flatnonzero(labels == one), self.cuts[one])
        return out


class RTree:
    """Packed boxes over rows; ``levels[0]`` is the top. A box holds lower and upper corner, and its label if it has one only."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        pages = []
        for one in np.unique(labels):
            rows = np.flatnonzero(labels == one)
            pages += str_order(vecs, rows, by_variance(vecs[rows], -(-len(rows) // LEAF)), LEAF)
        order = np.concatenate(pages)
        self.ids, self.labels, self.vecs = ids[order], labels[order], vecs[order]
        self.ends = np.cumsum([len(p) for p in pages])
        begins = np.concatenate(([0], self.ends[:-1]))
        low, high = (f.reduceat(self.vecs, begins, axis=0) for f in (np.minimum, np.maximum))
        least, most = (f.reduceat(self.labels, begins) for f in (np.minimum, np.maximum))
        levels = [(low, high, least, most)]
        while len(levels[-1][0]) > FAN:
            cuts = np.arange(0, len(levels[-1][0]), FAN)
            low, high, least, most = levels[-1]
            levels.append((np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0),
                           np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))
        self.levels = levels[::-1]

    def rows(self, leaf: int) -> slice:
        return slice(int(self.ends[leaf - 1]) if leaf else 0, int(self.ends[leaf]))


class Wants:
    """What is looked for: ``k`` rows for each query, a query being an anchor (by place) and a score window."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray,
                 floor: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.vecs, self.at, self.low, self.high = ids, labels, vecs, at, low, high
        self.floor, self.k, self.same = floor, k, same
        self.up, self.down = np.maximum(vecs, 0), np.minimum(vecs, 0)


class Found:
    """The best rows of each query so far, by falling score, then by id."""

    def __init__(self, wants: Wants) -> None:
        self.wants, n = wants, len(wants.at)
        self.scores, self.ids = np.full((n, wants.k), NONE, np.int64), np.full((n, wants.k), np.iinfo(np.int64).max)

    def least(self, chosen: np.ndarray) -> np.ndarray:
        """A row has to score as much as this to be taken."""
        return np.maximum(np.maximum(self.scores[chosen, -1], self.wants.floor[chosen]), self.wants.low[chosen])

    def add(self, tree: RTree, leaf: int, chosen: np.ndarray) -> None:
        w, rows = self.wants, tree.rows(leaf)
        ids, labels = tree.ids[rows], tree.labels[rows]
        anchors, back = np.unique(w.at[chosen], return_inverse=True)
        scores = (w.vecs[anchors] @ tree.vecs[rows].T).astype(np.int64)  # whole numbers below 2^53, so exact
        fit = (labels == w.labels[anchors][:, None]) == w.same
        fit &= ids != w.ids[anchors][:, None]
        scores = np.where(fit, scores, NONE)[back]
        new = (scores >= self.least(chosen)[:, None]) & (scores <= w.high[chosen][:, None])
        some = new.any(axis=1)
        chosen, scores = chosen[some], np.where(new, scores, NONE)[some]
        if not len(chosen):
            return
        scores = np.concatenate((self.scores[chosen], scores), axis=1)
        ids = np.concatenate((self.ids[chosen], np.broadcast_to(ids, (len(chosen), len(ids)))), axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : w.k]
        self.scores[chosen], self.ids[chosen] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(tree: RTree, found: Found) -> int:
    """Puts the rows of a tree into ``found``; the number of leaves scored."""
    w, tick, opened = found.wants, 0, 0
    queue: list[tuple] = []

    def push(level: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        nonlocal tick
        low, high, least, most = (x[nodes] for x in tree.levels[level])
        anchors, back = np.unique(w.at[chosen], return_inverse=True)
        upper = w.up[anchors] @ high.T + w.down[anchors] @ low.T
        lower = w.up[anchors] @ low.T + w.down[anchors] @ high.T
        own = w.labels[anchors][:, None]
        right = (least <= own) & (own <= most) if w.same else (least != own) | (most != own)
        upper = np.minimum(upper[back], w.high[chosen][:, None])
        fits = right[back] & (lower[back] <= w.high[chosen][:, None]) & (upper >= found.least(chosen)[:, None])
        for i in np.flatnonzero(fits.any(axis=0)):
            inside = fits[:, i]
            tick += 1
            heapq.heappush(queue, (-float(upper[inside, i].max()), tick, level, int(nodes[i]), chosen[inside], upper[inside, i]))

    push(0, np.arange(len(tree.levels[0][0])), np.arange(len(w.at)))
    while queue:
        _, _, level, node, chosen, upper = heapq.heappop(queue)
        chosen = chosen[upper >= found.least(chosen)]
        if not len(chosen):
            continue
        if level == len(tree.levels) - 1:
            found.add(tree, node, chosen)
            opened += 1
        else:
            below = np.arange(node * FAN, min((node + 1) * FAN, len(tree.levels[level + 1][0])))
            push(level + 1, below, chosen)
    return opened


def lists(tiles: DataFrame, wants: Wants, dims: int) -> DataFrame:
    """``query``, ``score``, ``id``: the best rows of each query in each task."""
    shared = tiles.sparkSession.sparkContext.broadcast(wants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = Found(shared.value), []

        def settle() -> None:
            ids, labels, vecs = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            search(RTree(ids, labels, vecs), found)

        for batch in batches:
            for begin in range(0, batch.num_rows, TREE):
                part = batch.slice(begin, TREE)
                waiting.append((part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("vec"), dims)))
                if sum(len(p[0]) for p in waiting) >= TREE:
                    settle()
        if waiting:
            settle()
        query, place = np.nonzero(found.scores > NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(found.scores[query, place]), pa.array(found.ids[query, place])], ["query", "score", "id"])

    return tiles.select("id", "label", "vec").mapInArrow(run, "query bigint, score bigint, id bigint")


def best(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query with their ``rank``; a query has as many rows as tasks times k at most."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def found_rows(tiles: DataFrame, dims: int, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, at: np.ndarray,
               low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """``query``, ``score``, ``id``, ``rank`` over all tiles, in two phases."""

    def wants(floor: np.ndarray) -> Wants:
        return Wants(ids, labels, vecs, at, low, high, floor, k, same)

    floor = np.full(len(at), NONE, np.int64)
    early = written(best(lists(tiles.where(F.col("tile") % STRIDE == 0), wants(floor), dims), k).select("query", "score", "id"))
    full = early.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    for r in full.collect():  # a row for each query of the block
        floor[r["query"]] = r["least"]
    late = lists(tiles.where(F.col("tile") % STRIDE != 0), wants(floor), dims)
    return best(early.unionByName(late), k)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """For each row that fulfils ``anchor``, a condition on the columns of ``vectors``, and each of its ``positives`` best rows of its label, the ``negatives`` best rows
    of other labels that score from ``low`` to ``high`` per cent of the positive: columns as in ``RESULT``."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, anchor, scale, key, label, vector))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"), F.count_if("anchor").alias("anchors"),
                    F.max(F.array_max(F.transform("vec", F.abs))).alias("most")).first()
    n, dims, anchors = size["n"], size["dims"] or 1, size["anchors"]
    if (size["most"] or 0.0) ** 2 * dims * 100 >= 1 << 53:
        raise ValueError("components are too large for exact scores")
    sample = rows.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 + n // SAMPLE)) == 0).select("label", "vec").toArrow()  # about SAMPLE rows
    sampled = sample.column("label").to_numpy(), matrix(sample.column("vec").combine_chunks(), dims)
    tiling = Tiling(*sampled, min(TILES, 1 + n // TILE))
    # equal vectors can't be told apart by cuts, so a tile that many rows share is dealt to several tasks
    share = np.bincount(tiling.place(*sampled), minlength=tiling.count) / max(1, sample.num_rows)
    salts = 1 + (share * min(n, TILES * TILE) / (2 * TILE)).astype(np.int64)

    def place(batch: pa.RecordBatch) -> Iterator[dict]:
        tile = tiling.place(batch.column("label").to_numpy(), matrix(batch.column("vec"), dims))
        yield {c: batch.column(c) for c in ("id", "label", "vec")} | {"tile": tile, "salt": batch.column("id").to_numpy() // 7 % salts[tile]}

    placed = map_batches(rows.select("id", "label", "vec"), place, "id bigint, label bigint, vec array<double>, tile bigint, salt bigint")
    tiles = written(placed.repartition(int(salts.sum()), "tile", "salt").sortWithinPartitions("tile", "salt"))

    blocks, results = 1 + anchors // ANCHORS, []
    for block in range(blocks if anchors else 0):
        chosen = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("id", "label", "vec"), F.lit(blocks)) == block)).orderBy("id", "label", "vec")
        held = chosen.select("id", "label", "vec").toArrow()  # about ANCHORS rows
        if held.num_rows:
            results.append(block_negatives(tiles, held, dims, positives, negatives, low, high))
    whole = spark.createDataFrame([], RESULT)
    for one in results:
        whole = whole.unionAll(one)
    return whole


def block_negatives(tiles: DataFrame, held: pa.Table, dims: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result's rows for one block of anchors."""
    spark = tiles.sparkSession
    ids, labels = held.column("id").to_numpy(), held.column("label").to_numpy()
    vecs = matrix(held.column("vec").combine_chunks(), dims)
    everyone, any_score = np.arange(len(ids)), np.full(len(ids), 1 << 60)
    first = found_rows(tiles, dims, ids, labels, vecs, everyone, -any_score, any_score, positives, True)
    # a window of whole scores: low * positive <= 100 * negative <= high * positive
    pairs = [(r["query"], r["id"], r["score"], -(-low * r["score"] // 100), high * r["score"] // 100)
             for r in first.select("query", "id", "score").collect()]  # `positives` rows an anchor
    pairs = [p for p in pairs if p[3] <= p[4]]
    if not pairs:
        return spark.createDataFrame([], RESULT)
    at, least, most = (np.array([p[i] for p in pairs], np.int64) for i in (0, 3, 4))
    second = found_rows(tiles, dims, ids, labels, vecs, at, least, most, negatives, False)
    names = spark.createDataFrame([(i, int(ids[q]), k, s) for i, (q, k, s, _, _) in enumerate(pairs)],
                                  "query bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
    return written(second.join(F.broadcast(names), "query").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")))
