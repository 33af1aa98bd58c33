"""Benchmark decontamination: a prefix-filtered set join of document passages with item windows.

A window is ``size`` consecutive words of an item (a shorter item is one window) and a set of word shingles. To contain a
window a document must hold its rarest shingle, so that one (the prefix of a containment join) is what is joined on;
rarity is counted over all documents. Length and position of the candidate must leave room for the window, and its words
are then compared one by one.

One pass over the texts keeps, by a bit table of fixed size, only runs of shingles that occur in the benchmark and are
long enough for the shortest window. The bit table lets through more as the benchmark grows, but loses nothing; what
it lets through is joined exactly.

Nulls: a null text has no words; a window of an item without id counts as hit, but the item isn't listed. Repeated
document rows are judged one by one; items that share an id count once. Empty tables and items without words hit nothing.
Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import map_batches, slices, words, written

SHINGLE = 3
#: Bits of the table that thins out the documents' shingles: 2 MiB.
TABLE_BITS = 24
#: Shingle counts that a task holds before it hands them on.
COUNTED = 500_000


def windows(benchmark: DataFrame, size: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``window`` (its words, blank-separated), ``width`` (words) and ``shingles`` of every item window."""

    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"item": [], "window": [], "width": []}
        for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = words(t)
            for at in range(max(1, len(found) - size + 1) if found else 0):
                some = found[at : at + size]
                for column, value in zip(out.values(), (i, b" ".join(some).decode(), len(some)), strict=True):
                    column.append(value)
        yield out

    narrow = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    kind = narrow.schema["item"].dataType.simpleString()
    return map_batches(narrow, cut, f"item {kind}, window string, width int").distinct()


def shingles(text: str, width: str) -> str:
    """SQL for the shingles (of ``width`` words) of a blank-separated text, in order; the text is split once."""
    cut = f"transform(sequence(0, size(w) - {width}), i -> array_join(slice(w, i + 1, {width}), ' '))"
    return f"flatten(transform(array(split({text}, ' ')), w -> {cut}))"


def scan(documents: DataFrame, table: bytes, least: dict[int, int], key: str, text: str) -> DataFrame:
    """One row per document (``kind`` 0), per run of shingles in the table (1), and shingle counts (2)."""
    bits = np.frombuffer(table, np.uint8)
    schema = "kind tinyint, row bigint, key {}, n bigint, width int, start int, passage string"

    def hits(found: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        grams = found if width == 1 else map(join, zip(*(found[i:] for i in range(width)), strict=False))
        hashes = np.array([digest(g, 42) for g in grams], np.uint64)
        place = (hashes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
        at = np.flatnonzero(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        return at, hashes[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()

        def rows(kind, row, key, n, width, start, passage) -> pa.RecordBatch:
            size = len(n)
            fill = lambda values, t: pa.nulls(size, t) if values is None else pa.array(values, t)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * size, pa.int8()), fill(row, pa.int64()), fill(key, kinds), pa.array(n, pa.int64()),
                 fill(width, pa.int32()), fill(start, pa.int32()), fill(passage, pa.string())],
                ["kind", "row", "key", "n", "width", "start", "passage"],
            )

        def rarity() -> pa.RecordBatch:
            found = np.array(list(counts), np.uint64).view(np.int64)
            out = rows(2, found, None, list(counts.values()), None, None, None)
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                numbers, ids = part.column("row").to_pylist(), part.column("key")
                sizes, runs = [], ([], [], [], [], [])
                for number, t in zip(numbers, part.column("text").to_pylist(), strict=True):
                    found = words(t)
                    sizes.append(len(found))
                    for width, shortest in least.items():
                        if len(found) < width:
                            continue
                        at, hashes = hits(found, width)
                        if not len(at):
                            continue
                        counts.update(hashes.tolist())
                        for piece in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                            if len(piece) >= shortest:
                                begin, end = int(piece[0]), int(piece[-1]) + width
                                values = (number, len(found), width, begin, b" ".join(found[begin:end]).decode())
                                for column, value in zip(runs, values, strict=True):
                                    column.append(value)
                yield rows(0, numbers, ids, sizes, None, None, None)
                yield rows(1, runs[0], None, *runs[1:])
                if len(counts) > COUNTED:
                    yield rarity()
        yield rarity()

    narrow = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(narrow.schema["key"].dataType)
    return narrow.mapInArrow(run, schema.format(narrow.schema["key"].dataType.simpleString()))


def hit_windows(documents: DataFrame, cut: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (``row``, key, ``n_words``) and the windows that occur in them (``row``, ``start``, ``width``, ``window``)."""
    distinct = cut.select("window", "width", F.least("width", F.lit(SHINGLE)).alias("k")).distinct()
    parts = written(distinct.selectExpr("*", f"posexplode({shingles('window', 'k')}) AS (offset, shingle)").withColumn("hash", F.xxhash64("shingle")))
    place = F.col("hash").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    # at most 2^TABLE_BITS / 32768 rows of 4 KiB reach the driver
    buckets = parts.groupBy(F.bitmap_bucket_number(place + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits")).collect()
    table = bytearray((1 << TABLE_BITS) // 8)
    for r in buckets:
        table[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    least = {r["k"]: r["least"] for r in distinct.groupBy("k").agg((F.min("width") - F.col("k") + 1).alias("least")).collect()}
    found = written(scan(documents, bytes(table), least, key, text))

    counted = found.where("kind = 2").groupBy(F.col("row").alias("hash")).agg(F.sum("n").alias("times"))
    known = parts.join(counted, "hash", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    rarest = F.min(F.struct("times", "hash", "offset", "shingle")).alias("prefix")
    prefixes = known.groupBy("window", "width", "k").agg(rarest).where("prefix.times > 0").select("window", "width", "k", "prefix.*")

    runs = found.where("kind = 1").select("row", "n", "start", "passage", F.col("width").alias("k"))
    tokens = runs.selectExpr("*", f"posexplode({shingles('passage', 'k')}) AS (at, shingle)")
    candidates = tokens.join(prefixes, ["k", "shingle"]).withColumn("at", F.col("at") - F.col("offset"))
    fitting = candidates.where("at >= 0 AND start + at + width <= n")
    same = fitting.where("array_join(slice(split(passage, ' '), at + 1, width), ' ') = window")
    hits = same.select("row", (F.col("start") + F.col("at")).alias("start"), "width", "window").distinct()
    return found.where("kind = 0").select("row", F.col("key").alias(key), F.col("n").alias("n_words")), hits


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Key, ``n_words``, ``n_hit`` (words inside occurring windows), ``items`` (ids as strings, sorted) of every document."""
    cut = written(windows(benchmark, size, item, item_text))
    rows, hits = hit_windows(documents, cut, key, text)
    hits = written(hits)
    before = Window.partitionBy("row").orderBy("start", "width").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("width")
    fresh = hits.select("row", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))).alias("fresh"))
    covered = fresh.groupBy("row").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("row", "window").distinct().join(cut.select("window", F.col("item").cast("string")), "window")
    listed = named.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = covered.join(listed, "row", "left")
    return rows.join(found, "row", "left").select(
        key, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
