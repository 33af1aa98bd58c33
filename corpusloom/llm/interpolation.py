"""Language-model scores by deleted interpolation of word trigrams.

A token's probability is a mixture of its relative frequencies after the two words before it, after the word before it and
anywhere, and of one share of the vocabulary. Each pair of context frequencies (of two words, of one word; by powers of two)
has mixture weights of its own, learned by expectation-maximisation on training texts that are left out of the counts: a
sixteenth of the texts, copies together. Weights lean on those of all buckets together where a bucket has seen little.

Counting and looking up go through one exchange. Documents are encoded into parts of about ``PART`` tokens, each with its own
vocabulary. A part asks for the counts of its distinct n-grams and tells how often it holds them itself: sorted 64-bit hashes,
cut into ranges, packed. A range's task adds up what all parts tell and answers each part in the order of its question. So an
n-gram costs a part one entry, however often it occurs there, and a frequent one has at most one entry from each part. Parts
then score their documents, and held-out parts pack the counts that the weights are learned from. All of this grows with the
input; only totals and the weights (at most 64 x 64 x 4) pass through the driver.

Words are known by their XXH64, longer n-grams by 56 bits: of 10^9 distinct n-grams about seven pairs share a hash and add up.

Nulls: a null text is empty and has one token, the end. Texts of any length are read whole. Repeated rows and ties are rows of
their own, rows without key are scored like others. An empty table gives no rows; without training rows every count is 0 and
the vocabulary's share is all. Other columns are ignored, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from corpusloom.llm.common import map_batches, slices, utf8, written

#: Tokens of a part, and about as many n-grams of one order in a range.
PART = RANGE = 1 << 21
#: Tokens whose estimates are computed at once.
STEP = 1 << 17
#: Most rounds of expectation-maximisation; it ends earlier once a round gains less than this share of the log-likelihood.
ROUNDS, GAIN = 20, 1e-5
#: Weight of the pooled mixture in each bucket, in tokens.
LEAN = 4.0
#: Ends each document; no word holds a line break. START stands before the first word and is never predicted.
END, START = xxhash.xxh64_intdigest(b"\n"), np.uint64(xxhash.xxh64_intdigest(b"\n\n"))
LEVELS = 64


def tokens(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, without the end."""
    return utf8(text).lower().split()


# numbers as bytes: one plane for each byte of the numbers, so that equal and zero bytes stand together


def packed(numbers: np.ndarray) -> bytes:
    numbers = np.ascontiguousarray(numbers, np.uint64)
    width = (int(numbers.max(initial=0)).bit_length() + 7) // 8
    planes = numbers.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(numbers).to_bytes(8, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(blob: bytes) -> np.ndarray:
    count, width = int.from_bytes(blob[:8], "little"), blob[8]
    out = np.zeros((count, 8), np.uint8)
    if count and width:
        planes = zstandard.ZstdDecompressor().decompress(blob[9:], max_output_size=count * width)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, count).T
    return out.reshape(-1).view(np.uint64)


def packed_sorted(numbers: np.ndarray) -> bytes:
    return packed(np.diff(numbers, prepend=np.uint64(0)))


def unpacked_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


# parts


class Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def part_type(key: StructField) -> StructType:
    return StructType([StructField("part", LongType()), StructField("deleted", BooleanType()), StructField("n", LongType()),
                       StructField("keys", ArrayType(key.dataType)), StructField("train", ArrayType(BooleanType())),
                       *[StructField(c, BinaryType()) for c in ("lengths", "words", "ids")]])


def parts(documents: DataFrame, train: Column, deleted: Column, key: str, text: str) -> DataFrame:
    """Documents encoded part by part; those left out of the counts to learn the weights (``deleted``) in parts of their own."""
    narrow = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
                              F.coalesce(train & deleted, F.lit(False)).alias("deleted"))
    kind = part_type(narrow.schema["key"])

    class Part:
        def __init__(self) -> None:
            self.keys, self.train, self.lengths, self.ids, self.words, self.n = [], [], [], [], Numbers(), 0

        def add(self, key: object, train: bool, text: str | None) -> None:
            found = tokens(text)
            self.keys.append(key)
            self.train.append(train)
            self.lengths.append(len(found) + 1)
            self.ids.append(np.fromiter(map(self.words.__getitem__, found), np.uint32, len(found)))
            self.ids.append(np.array([self.words[b"\n"]], np.uint32))
            self.n += len(found) + 1

        def row(self, number: int, deleted: bool) -> dict:
            ids = np.concatenate(self.ids)
            common = np.argsort(-np.bincount(ids, minlength=len(self.words)), kind="stable")  # small numbers for common words
            rank = np.empty(len(common), np.uint32)
            rank[common] = np.arange(len(common), dtype=np.uint32)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)[common]
            return {"part": [number], "deleted": [deleted], "n": [self.n], "keys": [self.keys], "train": [self.train],
                    "lengths": [packed(np.array(self.lengths))], "words": [packed(hashes)], "ids": [packed(rank[ids])]}

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_parts = TaskContext.get().partitionId() << 32, {}

        def close(deleted: bool) -> pa.RecordBatch:
            nonlocal number
            number += 1
            row = open_parts.pop(deleted).row(number, deleted)
            return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for some in slices(batch, "text"):
                for one in zip(*(some.column(c).to_pylist() for c in ("key", "train", "text", "deleted")), strict=True):
                    part = open_parts.setdefault(one[3], Part())
                    part.add(*one[:3])
                    if part.n >= PART:
                        yield close(one[3])
        for deleted in sorted(open_parts):
            yield close(deleted)

    return narrow.mapInArrow(run, kind)


class Grams:
    """The n-grams of a part: hashes of all tokens by order, first places of its documents, and their lengths."""

    def __init__(self, lengths: bytes, words: bytes, ids: bytes) -> None:
        self.lengths = unpacked(lengths).astype(np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        one = unpacked(words)[unpacked(ids).astype(np.int64)]
        two = mixed(self.before(one, START), one)
        three = mixed(self.before(two, mixed(START, START)), one)
        self.orders = (one, two, three)

    def before(self, values: np.ndarray, first: object) -> np.ndarray:
        """What each token's predecessor has; ``first`` where a document begins."""
        out = np.roll(values, 1)
        out[self.begins] = first
        return out


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = context * np.uint64(0x9E3779B97F4A7C15) + word
        for _ in range(2):
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFFFFFFFF00)


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, first places of equal hashes in it, and the distinct hashes."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return order, first, ordered[first]


# counting


QUESTION = "range int, order int, part bigint, deleted boolean, grams binary, kept binary, every binary"
ANSWER = "part bigint, deleted boolean, order int, range int, kept binary, every binary, n_kept bigint, n_every bigint, n_distinct bigint"


def questions(table: DataFrame, ranges: int) -> DataFrame:
    """For each part, order and range: the distinct n-grams, how often they are counted, and how often training texts hold them."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in batch.to_pylist():
            grams = Grams(row["lengths"], row["words"], row["ids"])
            train = np.repeat(np.array(row["train"], bool), grams.lengths).astype(np.int64)
            out: dict[str, list] = {c: [] for c in ("range", "order", "part", "deleted", "grams", "kept", "every")}
            for order, hashes in enumerate(grams.orders, 1):
                sort, first, distinct = grouped(hashes)
                every = np.add.reduceat(train[sort], first)
                kept = np.zeros_like(every) if row["deleted"] else every
                cuts = [0, *np.searchsorted(distinct, edges).tolist(), len(distinct)]
                for i in range(ranges):
                    span = slice(cuts[i], cuts[i + 1])
                    if cuts[i] < cuts[i + 1]:
                        out["range"].append(i)
                        out["order"].append(order)
                        out["part"].append(row["part"])
                        out["deleted"].append(row["deleted"])
                        out["grams"].append(packed_sorted(distinct[span]))
                        out["kept"].append(packed(kept[span]))
                        out["every"].append(packed(every[span]) if order == 1 and row["deleted"] else None)
            yield out

    # one part at a time: an Arrow batch may hold many
    return map_batches(table.select("part", "deleted", "train", "lengths", "words", "ids"), _singly(run), QUESTION)


def _singly(fn):
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            yield from fn(batch.slice(i, 1))

    return run


def answers(asked: DataFrame, ranges: int) -> DataFrame:
    """For each question the counts over all parts, in its order; one row more for each range, with totals."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(ANSWER))

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["part", "deleted", "kept", "every"]).to_pylist()
        order, place = group.column("order")[0].as_py(), group.column("range")[0].as_py()
        hashes = [unpacked_sorted(g.as_buffer().to_pybytes()) for g in group.column("grams")]
        sort, first, distinct = grouped(np.concatenate(hashes))
        width = np.diff(np.append(first, len(sort)))
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        counts = [unpacked(r["kept"]) for r in rows]
        out, totals = {}, {}
        for name in ("kept", "every") if order == 1 else ("kept",):
            held = counts if name == "kept" else [c if r["every"] is None else unpacked(r["every"]) for r, c in zip(rows, counts, strict=True)]
            sums = np.add.reduceat(np.concatenate(held)[sort], first)
            totals[name] = sums
            back = np.empty(len(sort), np.uint64)
            back[sort] = np.repeat(sums, width)
            out[name] = [packed(b) for b in np.split(back, ends)]
        n = len(rows)
        every = totals.get("every")
        columns = {
            "part": [*(r["part"] for r in rows), -1], "deleted": [*(r["deleted"] for r in rows), None], "order": [order] * (n + 1), "range": [place] * (n + 1),
            "kept": [*out["kept"], None], "every": [*out.get("every", [None] * n), None], "n_kept": [None] * n + [int(totals["kept"].sum())],
            "n_every": [None] * n + [None if every is None else int(every.sum())],
            "n_distinct": [None] * n + [None if every is None else int(np.count_nonzero(every))],
        }
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return asked.repartition(2 * ranges, "range", "order").groupBy("range", "order").applyInArrow(run, ANSWER)


class Totals:
    """Counted tokens and documents, and tokens and distinct ones of all training texts."""

    def __init__(self, kept: int, documents: int, every: int, distinct: int) -> None:
        self.kept, self.documents, self.every, self.distinct = kept, documents, every, distinct


def looked_up(part: dict, found: list[dict], totals: Totals) -> tuple[Grams, np.ndarray, list[np.ndarray]]:
    """A part's grams, each token's count in all training texts, and its counted frequencies: of the word, of the pair, of its
    context, of the triple, of its context."""
    grams = Grams(part["lengths"], part["words"], part["ids"])
    counts, every = [], None
    for order, hashes in enumerate(grams.orders, 1):
        sort, first, _ = grouped(hashes)
        blobs = sorted((r for r in found if r["order"] == order), key=lambda r: r["range"])
        width = np.diff(np.append(first, len(sort)))

        def spread(name: str) -> np.ndarray:
            sums = np.concatenate([unpacked(r[name]) for r in blobs]).astype(np.int64)
            out = np.empty(len(sort), np.int64)
            out[sort] = np.repeat(sums, width)
            return out

        counts.append(spread("kept"))
        if order == 1:
            every = spread("every")
    grams.orders = ()
    one, two, three = counts
    return grams, every, [one, two, grams.before(one, totals.documents), three, grams.before(two, totals.documents)]


# mixture


def level(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 if it never occurs, else by powers of two."""
    return np.frexp(counts.astype(np.float64))[1]


def estimates(counts: list[np.ndarray], totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and its probability by each of the four estimates."""
    one, two, context_two, three, context_three = counts
    floor = np.full(len(one), 1 / (totals.distinct + 1))
    shares = [floor, one / max(1, totals.kept), two / np.maximum(1, context_two), three / np.maximum(1, context_three)]
    return level(context_three) * LEVELS + level(context_two), np.stack(shares, axis=1)


def starting_weights(totals: Totals) -> np.ndarray:
    """Equal weights of the estimates that a bucket has."""
    return leaning(np.zeros((LEVELS * LEVELS, 4)), np.ones(4), totals)


def leaning(expected: np.ndarray, pooled: np.ndarray, totals: Totals) -> np.ndarray:
    """Weights from expected counts: each bucket with ``LEAN`` tokens of the pooled mixture, of those estimates that it has."""
    bucket = np.arange(LEVELS * LEVELS)
    has = np.ones((len(bucket), 4), bool)
    has[:, 3], has[:, 2], has[:, 1] = bucket // LEVELS > 0, bucket % LEVELS > 0, totals.kept > 0
    prior = np.where(has, (pooled + 1) / (pooled + 1).sum(), 0)
    weights = np.where(has, expected, 0) + LEAN * prior / prior.sum(axis=1, keepdims=True)
    return weights / weights.sum(axis=1, keepdims=True)


def expectation(bucket: np.ndarray, shares: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, the expected number of their tokens that each estimate gave, and the log-likelihood."""
    parts = weights[bucket] * shares
    total = parts.sum(axis=1)
    found, back = np.unique(bucket, return_inverse=True)
    expected = np.stack([np.bincount(back, parts[:, i] / total, len(found)) for i in range(4)], axis=1)
    return found, expected, float(np.log(total).sum())


def learned_weights(table: DataFrame, found: DataFrame, totals: Totals) -> np.ndarray:
    """Mixture weights by expectation-maximisation over the tokens of the parts left out of the counts."""

    def pack(own: pa.Table, replies: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        blobs = [[packed(c) for c in looked_up(r, replies.to_pylist(), totals)[2]] for r in rows]
        return pa.table({"counts": pa.array(blobs, pa.list_(pa.binary()))})

    narrow = table.where("deleted").select("part", "lengths", "words", "ids")
    replies = found.where("deleted").select("part", "order", "range", "kept", "every")
    counts = written(narrow.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(pack, "counts array<binary>"))
    weights, before = starting_weights(totals), None
    for _ in range(ROUNDS):

        def run(batch: pa.RecordBatch, weights: np.ndarray = weights) -> Iterator[dict]:
            for one in batch.column("counts"):
                bucket, shares = estimates([unpacked(b).astype(np.int64) for b in one.as_py()], totals)
                found, expected, gain = expectation(bucket, shares, weights)
                yield {"bucket": found, "e0": expected[:, 0], "e1": expected[:, 1], "e2": expected[:, 2], "e3": expected[:, 3],
                       "gain": np.concatenate(([gain], np.zeros(len(found) - 1)))}

        sums = map_batches(counts, run, "bucket bigint, e0 double, e1 double, e2 double, e3 double, gain double")
        rows = sums.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("e0", "e1", "e2", "e3", "gain")]).collect()  # a row a bucket
        if not rows:
            break
        expected = np.zeros((LEVELS * LEVELS, 4))
        for r in sorted(rows):
            expected[r["bucket"]] = r["e0"], r["e1"], r["e2"], r["e3"]
        weights = leaning(expected, expected.sum(axis=0), totals)
        gain = sum(r["gain"] for r in rows)
        if before is not None and gain - before < GAIN * abs(gain):
            break
        before = gain
    return weights


class Model:
    """Everything that scores need beside the counts: totals and mixture weights."""

    def __init__(self, totals: Totals, weights: np.ndarray) -> None:
        self.totals, self.weights = totals, weights


def token_scores(counts: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 of each token's probability."""
    out = np.empty(len(counts[0]))
    for begin in range(0, len(out), STEP):  # bounds what the four estimates take
        bucket, shares = estimates([c[begin : begin + STEP] for c in counts], model.totals)
        out[begin : begin + STEP] = np.log10((model.weights[bucket] * shares).sum(axis=1))
    return out


def score(documents: DataFrame, train: Column, key: str = "doc_id", text: str = "text", deleted: Column | None = None) -> DataFrame:
    """Of every row: ``key``, ``train`` (whether it was learned from), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``train`` chooses the rows to learn from; ``deleted`` those of them that set the weights, by default a sixteenth of the texts.
    """
    if deleted is None:
        deleted = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(16)) == 0
    table = written(parts(documents, train, deleted, key, text))
    size = table.agg(F.count(F.lit(1)).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                     F.coalesce(F.sum(F.when(~F.col("deleted"), F.size(F.filter("train", lambda t: t)))), F.lit(0)).alias("kept")).first()
    ranges = 1 + size["n"] // RANGE
    found = written(answers(questions(table, ranges), ranges))
    sums = found.where("part < 0 AND order = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_kept", "n_every", "n_distinct")]).first()
    totals = Totals(sums["n_kept"], size["kept"], sums["n_every"], sums["n_distinct"])
    found = found.where("part >= 0")
    model = Model(totals, learned_weights(table, found, totals))

    kind = StructType([StructField(key, documents.schema[key].dataType), StructField("train", BooleanType()), StructField("n_tokens", LongType()),
                       StructField("n_known", LongType()), StructField("train_tokens", LongType()), StructField("base_score", DoubleType()),
                       StructField("score", DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(own: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        answered = replies.to_pylist()
        for row in own.to_pylist():
            grams, every, counts = looked_up(row, answered, totals)
            base = np.log10((every + 1) / (totals.every + 1 * (totals.distinct + 1)))
            columns = (row["keys"], row["train"], grams.lengths, np.add.reduceat((every > 0).astype(np.int64), grams.begins),
                       np.full(len(grams.lengths), totals.every), np.add.reduceat(base, grams.begins), np.add.reduceat(token_scores(counts, model), grams.begins))
            out.append(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    tasks = max(1, size["parts"])  # a part each, more or less, at any size of the table
    narrow = table.select("part", "keys", "train", "lengths", "words", "ids").repartition(tasks, "part")
    replies = found.select("part", "order", "range", "kept", "every").repartition(tasks, "part")
    return narrow.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(run, kind)
