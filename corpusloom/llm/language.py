"""Language identification by interpolated Kneser-Ney character models.

A gram is four characters (lower-case letters; anything else is one blank), 16 bits each. Spark counts the grams of each
language over all training texts and derives the continuation counts of the lower orders; grams and contexts are then
hashed to ``HASH_BITS`` bits, which bounds the model whatever the corpus. The driver turns the counts into sorted hash
arrays, one for grams and one for contexts of each order, with a column per language. A text gets the language of the
lowest cross-entropy per character; it is rejected if that is far above what labelled texts of the language have that the
model hasn't seen.

Nulls: a null text, like one without letters, is ``und`` with score 0 and rejected; rows whose language is null are not
learned from. With no training rows all texts are ``und``. Ties go to the language that sorts first. Repeated rows count
each. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keep_rows, map_batches, slices, written

ORDER, HASH_BITS = 4, 24
#: Characters scored at once, and distinct grams that a task holds before it hands them on.
SLICE, HELD = 1 << 18, 1_000_000
#: Characters of evidence that a score counts at most.
EVIDENCE = 30
BLANK = 32


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: the letter folded to 16 bits, 0 for 0, a blank for all else."""
    out = np.full(0x110000, BLANK, np.uint64)
    known = [c for c in range(0x110000) if chr(c).isalpha()]
    out[known] = np.maximum(np.array(known) & 0xFFFF, BLANK + 1)
    out[0] = 0
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character and the place of its text. Texts are padded, runs of non-letters are one blank."""
    joined = "".join("\0\0\0" + (t or "").lower().replace("\0", " ") for t in texts)
    points = letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    row = np.cumsum(points == 0) // 3 - 1
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != BLANK) | ((points[:-1] != BLANK) & (points[:-1] != 0))
    points, row = points[keep], row[keep]
    codes = points.copy()
    for back in range(1, ORDER):
        codes[back:] |= points[:-back] << np.uint64(16 * back)
    real = points != 0
    return codes[real], row[real]


def fold(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the last ``order`` characters of each gram."""
    if order < 4:
        codes = codes & np.uint64((1 << (16 * order)) - 1)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


def gram_counts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``lang``, ``gram``, ``n`` over all rows whose language is known; each task adds up before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                by: dict[str, list[str]] = {}
                for lang, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, texts in by.items():
                    codes, counts = np.unique(grams(texts)[0], return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((codes, counts))
                    if len(parts) > 16:
                        held[lang] = [merge(parts)]
                if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                    yield from out()
        yield from out()

    narrow = documents.select(F.col(key).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = narrow.mapInArrow(run, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    #: By order: sorted hashes, and for each hash and language the log-probability of the gram.
    known: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    #: By order: sorted hashes, and for each the log of the weight of the next lower order after that context.
    context: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    floor: float = 0.0
    limit: np.ndarray | None = None

    def log_probabilities(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        if not order:
            return np.full((len(codes), len(self.langs)), self.floor, np.float32)
        at, there = find(self.known[order][0], fold(codes, order))
        out = self.known[order][1][at]
        if not there.all():
            new = np.flatnonzero(~there)
            out[new] = self.weights(codes[new], order) + self.log_probabilities(codes[new], order - 1)
        return out

    def weights(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Log weights of order - 1 after the contexts; 0 where a language doesn't know the context."""
        hashes, values = self.context[order]
        at, there = find(hashes, fold(codes >> np.uint64(16), order - 1))
        return np.where(there[:, None], values[at], np.float32(0))

    def rejected(self, letters: np.ndarray, best: np.ndarray, entropy: np.ndarray) -> np.ndarray:
        """Whether a text has no letters or too high a cross-entropy; a short one's mean strays further and has more room."""
        limit = self.limit if self.limit is not None else np.full(len(self.langs), np.inf)
        return (letters == 0) | (entropy > limit[best] * (1 + 10 / np.maximum(letters, 1)))

    def entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its number of letters and, for each language, the cross-entropy per character in nats."""
        codes, row = grams(texts)
        n = np.bincount(row, minlength=len(texts))
        lettered = np.bincount(row[(codes & np.uint64(0xFFFF)) != BLANK], minlength=len(texts))
        sums = np.zeros((len(texts), len(self.langs)))
        if len(row):
            found = self.log_probabilities(codes)
            begins = np.flatnonzero(np.diff(row, prepend=-1))
            sums[row[begins]] = np.add.reduceat(found, begins, axis=0, dtype=np.float64)
        return lettered, -sums / np.maximum(n, 1)[:, None]


def find(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == hashes


def train(documents: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Models of all languages in ``documents``, which are the rows to learn from."""
    counts = written(gram_counts(documents, lang, text))
    fold_udf = {o: F.pandas_udf(lambda s, o=o: fold_series(s, o), "int") for o in range(1, ORDER + 1)}
    levels = {}
    frame = counts
    for order in range(ORDER, 0, -1):  # below the highest order, n is the number of distinct characters before
        if order < ORDER:
            frame = frame.select("lang", F.col("gram").bitwiseAND((1 << (16 * order)) - 1).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
        levels[order] = written(frame) if order < ORDER else frame
        frame = levels[order]
    langs = sorted(r["lang"] for r in levels[1].select("lang").distinct().collect())
    model = Model(langs)
    if not langs:
        return model
    # code points in use decide the floor: a uniform choice among them and one unseen
    seen = levels[1].select("gram").distinct().count()
    model.floor = -float(np.log(seen + 1))
    place = {name: i for i, name in enumerate(langs)}
    for order in range(1, ORDER + 1):
        level = levels[order]
        of = {r["lang"]: (r["one"], r["two"]) for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
        discount = np.array([(o / (o + 2 * t) if o else 0.5) for o, t in (of.get(name, (0, 0)) for name in langs)])
        before = F.shiftrightunsigned("gram", 16)
        above = level.groupBy("lang", before.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        ctx = above.withColumn("hash", fold_udf[order - 1]("context") if order > 1 else F.lit(0)).groupBy("lang", "hash").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).toPandas()
        # one row per language and hash: at most 2^HASH_BITS of them a language, however large the corpus
        seen_grams = level.select("lang", "n", "gram", fold_udf[order]("gram").alias("hash"), (fold_udf[order - 1](before) if order > 1 else F.lit(0)).alias("before"))
        table = seen_grams.groupBy("lang", "hash").agg(F.sum("n").alias("n"), F.min_by("gram", "gram").alias("gram"), F.min_by("before", "gram").alias("before")).toPandas()
        hashes, at = np.unique(ctx["hash"].to_numpy(np.int32), return_inverse=True)
        column = ctx["lang"].map(place).to_numpy()
        total, kinds = np.zeros((2, len(hashes), len(langs)))
        total[at, column], kinds[at, column] = ctx["total"], ctx["kinds"]
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        model.context[order] = hashes, np.log(np.maximum(weight, 1e-12)).astype(np.float32)
        known, at = np.unique(table["hash"].to_numpy(np.int32), return_inverse=True)
        number = np.zeros((len(known), len(langs)))
        number[at, table["lang"].map(place).to_numpy()] = table["n"]
        codes, contexts = np.zeros(len(known), np.uint64), np.zeros(len(known), np.int32)
        codes[at], contexts[at] = table["gram"].to_numpy(np.int64).view(np.uint64), table["before"]
        ctx_at, _ = find(hashes, contexts)
        lower = model.log_probabilities(codes, order - 1)
        p = np.maximum(number - discount, 0) / np.maximum(total[ctx_at], 1) + weight[ctx_at] * np.exp(lower)
        model.known[order] = known, np.log(np.maximum(p, 1e-12)).astype(np.float32)
    return model


def fold_series(codes, order: int):
    import pandas as pd

    return pd.Series(fold(codes.to_numpy(np.int64).view(np.uint64), order))


def calibrate(model: Model, documents: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Sets the rejection limits from all labelled texts of 100 letters or more; these rows should not be in the model. For each
    language: the median of the cross-entropy plus eight deviations, a deviation being that of a normal distribution with
    the same distance from median to 5 % quantile, and at least a twentieth of the median. Neither moves with texts far above
    the others while these are the minority. A language with fewer than 20 such texts gets the limit of all together."""
    if not model.langs:
        return model
    labelled = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL")
    held = entropies(labelled, model, "lang", "text").where("letters >= 100")
    quantiles = F.percentile_approx("entropy", [0.05, 0.5], 10000).alias("q")
    found = {r["lang"]: r for r in held.rollup("lang").agg(quantiles, F.count(F.lit(1)).alias("n")).collect()}  # null: all
    limits = []
    for name in model.langs:
        own = found[name] if name in found and found[name]["n"] >= 20 else found.get(None)
        if own is None or not own["n"]:
            limits.append(np.inf)
            continue
        low, median = own["q"]
        limits.append(median + 8 * max((median - low) / 1.645, median / 20))
    model.limit = np.array(limits)
    return model


def entropies(documents: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """Key, ``letters``, ``best`` (place of the language), its ``entropy`` and ``score`` for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        fitted = shared.value
        for part in slices(batch, "text", SLICE):
            n = part.num_rows
            if not fitted.langs:
                yield {"key": part.column("key"), "letters": np.zeros(n, int), "best": np.zeros(n, int), "entropy": np.zeros(n), "score": np.zeros(n), "rejected": np.ones(n, bool)}
                continue
            lettered, each = fitted.entropy(part.column("text").to_pylist())
            best = each.argmin(axis=1)
            least = each[np.arange(n), best]
            share = 1 / np.exp(np.minimum(lettered, EVIDENCE)[:, None] * (least[:, None] - each)).sum(axis=1)
            yield {"key": part.column("key"), "letters": lettered, "best": best, "entropy": least, "score": np.where(lettered > 0, share, 0.0),
                   "rejected": fitted.rejected(lettered, best, least)}

    narrow = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return map_batches(narrow, run, f"key {kind}, letters bigint, best int, entropy double, score double, rejected boolean").withColumnRenamed("key", key)


def identify(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred`` (``und`` without letters), ``score``, ``entropy`` and ``rejected`` of every row's whole text."""
    found = entropies(documents, model, key, text)
    if not model.langs:
        return found.select(key, F.lit("und").alias("lang_pred"), "score", "entropy", "rejected")
    names = F.array(*[F.lit(x) for x in model.langs])
    return found.select(
        key, F.when(F.col("letters") > 0, F.element_at(names, F.col("best") + 1)).otherwise("und").alias("lang_pred"), "score", "entropy", "rejected"
    )


def accepted(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text isn't rejected, with all their columns; none without any model."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def decide(texts: list[str | None]) -> list[bool]:
        fitted = shared.value
        if not fitted.langs:
            return [False] * len(texts)
        letters, each = fitted.entropy(texts)
        best = each.argmin(axis=1)
        return (~fitted.rejected(letters, best, each[np.arange(len(texts)), best])).tolist()

    return keep_rows(documents, text, decide, SLICE)
