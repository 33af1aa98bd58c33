"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Neighbours in Gray order share long bit patterns. A node of the index stands for a run of fingerprints in that order and
holds the bits on which all of them agree (mask and value), less those that its parent holds already. A search walks down
and adds up the differences to the query; a node is left, with all that hangs below it, once the sum passes the limit.

The distinct fingerprints are cut by Gray rank into ``RUNS`` runs at least, then runs of about ``NODE``, at most ``NODES``. The index over these
runs (two numbers each, so its size is bounded) sends every fingerprint to the runs that it cannot be ruled out of; each
run builds the index over its own members in one task and streams the fingerprints sent to it. A task emits a spanning
forest of the links that it finds, not the links, so a dense cloud of fingerprints costs rows in proportion to its members.
Components of the links follow by star contraction.

Nulls: a null text has no words and fingerprint zero, linked like any other; rows without ``doc_id`` get a fingerprint,
and a component only through rows that have one. Texts of one or two words are one shingle. Repeated rows keep their
number. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.common import map_batches, slices, utf8, written

#: Fewest runs, fingerprints in a run beyond that, most runs, and children of an index node.
RUNS, NODE, NODES, FAN = 64, 8192, 4096, 8
#: Queries searched at once, and hashes whose bits are counted at once.
SEARCHED, COUNTED = 1024, 8192


def simhash(text: str | None, width: int = 3) -> int:
    """Fingerprint: each bit is set if it is set in over half of the shingles' hashes."""
    found = utf8(text).lower().split()
    if not found:
        return 0
    shingles = zip(*(found[i:] for i in range(width)), strict=False) if len(found) >= width else [found]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), 42) for s in shingles], "<u8")
    counts = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[begin : begin + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint's 64 bits as a signed number) of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            fps = np.array([simhash(t, width) for t in part.column("text").to_pylist()], np.uint64)
            yield {"key": part.column("key"), "fp": fps.view(np.int64)}

    narrow = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return map_batches(narrow, run, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(fp: Column) -> Column:
    """Place of the fingerprint in Gray order, shifted so that signed comparison keeps the order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def gray_order(fps: np.ndarray) -> np.ndarray:
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return np.argsort(rank, kind="stable")


class GrayIndex:
    """The hierarchy over nodes given by ``mask`` and ``value`` in Gray order (fingerprints: all bits)."""

    def __init__(self, value: np.ndarray, mask: np.ndarray) -> None:
        levels = [(value & mask, mask)]
        while len(levels[-1][0]) > FAN:
            value, mask = levels[-1]
            cuts = np.arange(0, len(value), FAN)
            ones = np.bitwise_and.reduceat(value & mask, cuts)
            zeros = np.bitwise_and.reduceat(~value & mask, cuts)
            levels.append((ones, ones | zeros))
        for (_, below), (_, above) in zip(levels, levels[1:], strict=False):
            below &= ~np.repeat(above, FAN)[: len(below)]  # what the parent has settled
        self.levels = levels[::-1]

    def search(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (query, leaf) that differ in at most ``most`` bits, for blocks of queries in turn."""
        for begin in range(0, len(queries), SEARCHED):
            block = queries[begin : begin + SEARCHED]
            top = len(self.levels[0][0])
            at, node = np.repeat(np.arange(len(block)), top), np.tile(np.arange(top), len(block))
            spent = np.zeros(len(at), np.uint8)
            for depth, (value, mask) in enumerate(self.levels):
                if depth:
                    at, spent = np.repeat(at, FAN), np.repeat(spent, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < len(value)
                    at, node, spent = at[real], node[real], spent[real]
                spent = spent + np.bitwise_count((block[at] ^ value[node]) & mask[node])
                near = spent <= most
                at, node, spent = at[near], node[near], spent[near]
            yield at + begin, node


class Forest:
    """Merged sets of the numbers below ``size``; all steps work on arrays."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """Spanning links ``a``, ``b`` between fingerprints ``fp`` (each once): the same components as all pairs that differ
    in at most ``most`` bits. ``distinct`` is read several times."""
    spark = distinct.sparkSession
    ranked = distinct.select("fp", gray_rank(F.col("fp")).alias("rank"))
    total = distinct.count()
    runs = min(NODES, max(RUNS, 1 + total // NODE))
    # a sixteenth of the ranks at most, about 64 a run, balances the runs; the result doesn't depend on it
    every = max(16, total // (64 * runs))
    sample = sorted(r["rank"] for r in ranked.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("rank").collect())
    cuts = [sample[len(sample) * i // runs] for i in range(1, runs)] if sample else []
    bounds = np.array(sorted(set(cuts)), np.int64)

    def home(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"fp": batch.column("fp"), "run": np.searchsorted(bounds, batch.column("rank").to_numpy(), "right")}

    homes = map_batches(ranked, home, "fp bigint, run bigint")
    patterns = homes.groupBy("run").agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")).orderBy("run").collect()
    if not patterns:
        return spark.createDataFrame([], "a bigint, b bigint")
    ones, zeros, numbers = (np.array([r[c] for r in patterns], np.int64) for c in ("ones", "zeros", "run"))
    top = GrayIndex(ones.view(np.uint64), (ones | zeros).view(np.uint64))

    def send(batch: pa.RecordBatch) -> Iterator[dict]:
        fps, own = batch.column("fp").to_numpy(), batch.column("run").to_numpy()
        for at, node in top.search(fps.view(np.uint64), most):
            goal = numbers[node]
            lower = goal <= own[at]  # of two runs, the one that comes first in Gray order looks
            at, goal = at[lower], goal[lower]
            yield {"run": goal, "guest": (goal != own[at]).astype(np.int8), "fp": fps[at]}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, index, forest = None, [], None, None

        def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def build() -> None:
            nonlocal members, index, forest
            members = np.concatenate(members)
            members = members[gray_order(members)]
            index, forest = GrayIndex(members, np.full(len(members), ~np.uint64(0))), Forest(len(members))
            for at, leaf in index.search(members, most):
                forest.merge(at, leaf)

        def close() -> Iterator[pa.RecordBatch]:
            if current is not None:
                if index is None:
                    build()
                child = np.flatnonzero(forest.parent != np.arange(len(members)))
                yield pairs(members[child], members[forest.parent[child]])

        for batch in batches:
            run, guest = batch.column("run").to_numpy(), batch.column("guest").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            edges = np.flatnonzero(np.diff(run * 2 + guest)) + 1
            for part in np.split(np.arange(len(run)), edges):
                if not len(part):
                    continue
                if run[part[0]] != current:
                    yield from close()
                    current, members, index, forest = run[part[0]], [], None, None
                if not guest[part[0]]:
                    members.append(fps[part])
                    continue
                if index is None:
                    build()
                guests = fps[part]
                for at, leaf in index.search(guests, most):
                    order = np.argsort(at, kind="stable")
                    at, leaf = at[order], leaf[order]
                    first = np.flatnonzero(np.diff(at, prepend=-1))
                    counts = np.diff(np.append(first, len(at)))
                    forest.merge(leaf, np.repeat(leaf[first], counts))
                    yield pairs(guests[at[first]], members[leaf[first]])
        yield from close()

    sent = map_batches(homes, send, "run bigint, guest tinyint, fp bigint")
    return sent.repartition(len(numbers), "run").sortWithinPartitions("run", "guest").mapInArrow(search, "a bigint, b bigint")


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of the links ``a``, ``b``.

    Alternates large-star and small-star contraction; each round writes its links to the shared folder. Hubs are only
    ever minimised and joined, never gathered.
    """
    edges = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        lowest = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(lowest, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = written(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        digest = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if digest == before:
            break
        before = digest
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots)


def classes(prints: DataFrame, key: str, most: int = 2) -> DataFrame:
    """``fp``, ``root`` (a fingerprint that names the component) and ``component_id`` (its smallest key) of every distinct ``fp``."""
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("least")))
    rooted = components(links(distinct, most)).withColumnRenamed("node", "fp")
    joined = written(distinct.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    return joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` (smallest key reachable over links) of every row."""
    prints = written(fingerprints(documents, key, text, width))
    return prints.join(classes(prints, key, most), "fp").select(key, "fp", "component_id")


def representatives(documents: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest key (rows without key last), of repeated ones
    any. Components of rows without key keep one, too."""
    marks = documents.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[documents[f"`{c}`"] for c in documents.columns]).alias("_all"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch.column("_all").field(place)  # no copy of the texts
        for part in slices(pa.RecordBatch.from_arrays([*batch.columns, texts], ["_row", "_all", "_text"]), "_text"):
            fps = np.array([simhash(t, width) for t in part.column("_text").to_pylist()], np.uint64)
            yield {"_row": part.column("_row"), "_all": part.column("_all"), "fp": fps.view(np.int64)}

    kinds = StructType([*marks.schema.fields, StructField("fp", LongType())])
    place = documents.columns.index(text)
    marked = written(map_batches(marks, run, kinds))
    narrow = marked.select("_row", "fp", F.col("_all")[key].alias("key"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("_row"))).alias("first")
    chosen = narrow.join(classes(narrow, "key", most).select("fp", "root"), "fp").groupBy("root").agg(first).select("first._row")
    return marked.join(chosen, "_row", "left_semi").select("_all.*")
