"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled texts, one from good and one from bad ones. A text is compressed with
each, block by block, and the difference of the two sizes over their sum says which dictionary knows it better; logistic
regression on that difference and on the compressed share of the text makes it a probability.

Fitting uses a bounded sample of labelled rows in hash order: ``dictionary_rows`` of each class for the dictionaries (at
most ``BLOCKS`` blocks of a text, spread over it) and ``calibration_rows`` others for the regression. Scores use whole texts.

Nulls: a null text is empty; labels that are null or neither 0 nor 1 and labels of unknown documents are left out. With
labels of one class only, or none, all rows get one score, the share of good labels (0.5 without any). Repeated labels count
each. Repeated rows are scored alike. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keep_rows, map_batches, slices, utf8, written

BLOCK, BLOCKS, LEVEL, DICTIONARY = 1024, 8, 3, 1 << 16


@functools.lru_cache(maxsize=4)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


def cut(text: str | None) -> list[bytes]:
    data = utf8(text)
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def sizes(text: str | None, good: bytes, bad: bytes) -> tuple[int, int, int]:
    """Bytes of the text, and of its compressed blocks with either dictionary."""
    blocks = cut(text)
    one, two = compressor(good).compress, compressor(bad).compress
    return sum(map(len, blocks)), sum(len(one(b)) for b in blocks), sum(len(two(b)) for b in blocks)


def features(measured: np.ndarray) -> np.ndarray:
    """Normalised size difference and log compressed share for rows of :func:`sizes`."""
    size, good, bad = measured.astype(float).T
    return np.stack([(good - bad) / np.maximum(good + bad, 1), np.log((good + bad + 2) / (2 * size + 2) + 1e-3)], axis=1)


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None
    prior: float

    def terms(self, measured: np.ndarray) -> np.ndarray:
        d, r = np.clip((features(measured) - self.centre) / self.spread, -4, 4).T  # no extrapolation of the squares
        return np.stack([np.ones_like(d), d, r, d * r, d * d, r * r], axis=1)

    def score(self, measured: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(measured), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.terms(measured) @ self.weights, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Penalised logistic regression by Newton steps, each halved until the loss falls (classes may be separable)."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        size = 1.0
        while (then := loss(w + size * step)) > now and size > 1e-8:
            size /= 2
        if then >= now - 1e-9:
            break
        w, now = w + size * step, then
    return w


def measure(texts: DataFrame, good: bytes, bad: bytes, schema: str) -> DataFrame:
    """All columns but ``text`` and ``size``, ``good``, ``bad`` of :func:`sizes`; ``schema`` is that of the others."""
    others = [c for c in texts.columns if c != "text"]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            found = [sizes(t, good, bad) for t in part.column("text").to_pylist()]
            size, one, two = zip(*found, strict=True)
            yield {c: part.column(c) for c in others} | {"size": size, "good": one, "bad": two}

    return map_batches(texts, run, f"{schema}, size bigint, good bigint, bad bigint")


def train(documents: DataFrame, labels: DataFrame, dictionary_rows: int = 1000, calibration_rows: int = 8000,
          key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """``labels`` are the rows to learn from."""
    spark = documents.sparkSession
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    # one half of the ids is for the dictionaries, the other for the regression, so that it sees unknown texts
    half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))
    order = [F.xxhash64("id"), F.col("id")]
    picked = known.where((half == 1)).orderBy(*order).limit(calibration_rows).withColumn("use", F.lit(1))
    for y in (0, 1):
        some = known.where((half == 0) & (F.col("label") == y)).orderBy(*order).limit(dictionary_rows)
        picked = picked.unionByName(some.withColumn("use", F.lit(0)))
    rows = picked.collect()  # 2 * dictionary_rows + calibration_rows ids at most
    sample = spark.createDataFrame(rows, picked.schema)
    texts = documents.select(F.col(key).alias("id"), F.col(text).alias("text"))
    labelled = written(texts.join(F.broadcast(sample), "id").select("text", "label", "use"))

    def pick(batch: pa.RecordBatch) -> Iterator[dict]:
        out: dict[str, list] = {"label": [], "block": []}
        for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            blocks = cut(t)
            for i in sorted({len(blocks) * k // BLOCKS for k in range(BLOCKS)} if blocks else ()):
                out["label"].append(y)
                out["block"].append(blocks[i])
        yield out

    if labelled.where("use = 0").select("label").distinct().count() < 2:  # too few rows for two halves
        labelled = labelled.withColumn("use", F.lit(0)).unionByName(labelled.withColumn("use", F.lit(1)))
    blocks = map_batches(labelled.where("use = 0").select("label", "text"), pick, "label int, block binary").collect()
    by_label = {y: sorted(bytes(r["block"]) for r in blocks if r["label"] == y) for y in (0, 1)}
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    zero, one = np.zeros(2), np.ones(2)
    if not (by_label[0] and by_label[1]):
        return Model(b"", b"", zero, one, None, prior)
    good, bad = (dictionary(by_label[y]) for y in (1, 0))
    held = measure(labelled.where("use = 1").select("label", "text"), good, bad, "label int").collect()
    if len({r["label"] for r in held}) < 2:
        held = measure(labelled.select("label", "text"), good, bad, "label int").collect()
    measured = np.array([(r["size"], r["good"], r["bad"]) for r in held])
    x = features(measured)
    model = Model(good, bad, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6), None, prior)
    y = np.array([r["label"] for r in held], float)
    return Model(good, bad, model.centre, model.spread, logistic(model.terms(measured), y), prior)


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; the blocks themselves where they are too few to train on."""
    whole = b"".join(blocks)
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, len(whole) // 8)), blocks).as_bytes()
    except zstandard.ZstdError:
        return whole[-DICTIONARY:]


def judge(texts: list[str | None], model: Model) -> np.ndarray:
    """Scores of whole texts."""
    found = np.array([sizes(t, model.good, model.bad) for t in texts]) if model.weights is not None else np.zeros((len(texts), 3))
    return model.score(found)


def accepted(documents: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores ``least`` or more, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return keep_rows(documents, text, lambda texts: (judge(texts, shared.value) >= least).tolist())


def scores(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` (0 to 1, higher is better) of every row's whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for part in slices(batch, "text"):
            yield {"key": part.column("key"), "score": judge(part.column("text").to_pylist(), shared.value)}

    narrow = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return map_batches(narrow, run, f"key {kind}, score double").withColumnRenamed("key", key)
