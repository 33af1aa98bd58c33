"""Deleted interpolation against a plain version, and its quality on held-out documents."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import interpolation, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, part string, n int, train string"


def plain_scores(rows, rounds=interpolation.ROUNDS):
    """``rows``: key, text, train, deleted. Dictionaries of tuples, one token at a time."""
    docs = []
    for key, text, train, deleted in rows:
        words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
        docs.append((key, ["<", "<", *words, ">"], train, deleted and train))
    every, grams = Counter(), Counter()
    for _, w, train, deleted in docs:
        if train:
            every.update(w[2:])
            if not deleted:
                grams.update(g for i in range(2, len(w)) for g in ((w[i],), (w[i - 1], w[i]), (w[i - 2], w[i - 1], w[i])))
    kept_docs = sum(t and not d for *_, t, d in docs)
    total, kept, distinct = sum(every.values()), sum(c for g, c in grams.items() if len(g) == 1), len(every)

    def context(g):
        return kept_docs if g in (("<",), ("<", "<")) else grams[g]

    def evidence(w, i):
        c3, c2 = context((w[i - 2], w[i - 1])), context((w[i - 1],))
        return (c3.bit_length(), c2.bit_length()), [
            1 / (distinct + 1), grams[(w[i],)] / max(1, kept), grams[(w[i - 1], w[i])] / max(1, c2), grams[(w[i - 2], w[i - 1], w[i])] / max(1, c3)]

    def mixture(sums, pooled):
        def of(bucket):
            has = [1, kept > 0, bucket[1] > 0, bucket[0] > 0]
            prior = [h * (p + 1) for h, p in zip(has, pooled, strict=True)]
            raw = [h * s + interpolation.LEAN * p / sum(prior) for h, s, p in zip(has, sums[bucket], prior, strict=True)]
            return [r / sum(raw) for r in raw]
        return of

    weights, before = mixture(defaultdict(lambda: [0.0] * 4), [1.0] * 4), None
    held = [evidence(w, i) for _, w, _, deleted in docs if deleted for i in range(2, len(w))]
    for _ in range(rounds if held else 0):
        sums, gain = defaultdict(lambda: [0.0] * 4), 0.0
        for bucket, shares in held:
            parts = [a * b for a, b in zip(weights(bucket), shares, strict=True)]
            gain += math.log(sum(parts))
            sums[bucket] = [s + p / sum(parts) for s, p in zip(sums[bucket], parts, strict=True)]
        weights = mixture(sums, [sum(s[i] for s in sums.values()) for i in range(4)])
        if before is not None and gain - before < interpolation.GAIN * abs(gain):
            break
        before = gain
    out = []
    for key, w, train, _ in docs:
        found = [evidence(w, i) for i in range(2, len(w))]
        score = sum(math.log10(sum(a * b for a, b in zip(weights(k), s, strict=True))) for k, s in found)
        base = sum(math.log10((every[t] + 1) / (total + 1 * (distinct + 1))) for t in w[2:])
        out.append((key, train, len(w) - 2, sum(every[t] > 0 for t in w[2:]), total, base, score))
    return sorted(out, key=repr)


def same(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def scored(spark, rows):
    """Rows of key, text, train, deleted; the last two travel in columns whose names clash with the operator's own."""
    frame = spark.createDataFrame([(k, t, str(d), 1, str(tr)) for k, t, tr, d in rows], DOCS)
    found = interpolation.score(frame, F.col("train") == "True", deleted=F.col("part") == "True")
    assert found.columns == ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("size", [1 << 21, 200])
def test_scores(spark, monkeypatch, size):
    """Prose over a skewed vocabulary with copies of one text for a third of the rows; one part, then many parts and ranges."""
    monkeypatch.setattr(interpolation, "PART", size)
    monkeypatch.setattr(interpolation, "RANGE", size)
    draw = np.random.default_rng(2)
    words = [f"w{i}" if i % 4 else f"Wört{i}" for i in range(60)]
    texts = [" ".join(words[int(i)] for i in np.minimum(draw.zipf(1.5, int(draw.integers(0, 40))), 59)) for _ in range(150)]
    rows = [(k, texts[3] if k % 3 == 0 else t, k % 7 != 2, k % 5 == 1) for k, t in enumerate(texts)]
    same(scored(spark, rows), plain_scores(rows))


def test_scores_of_odd_rows(spark):
    rows = [(1, None, True, False), (2, "", True, True), (3, "one two", True, False), (3, "one two", True, False), (None, "one three", False, False),
            (5, "One " * 40_000, True, False), (6, "\t\n", False, False), (7, "one two three", True, True)]
    same(scored(spark, rows), plain_scores(rows))
    same(scored(spark, rows[2:4]), plain_scores(rows[2:4]))  # nothing to learn weights from
    nothing = [(k, t, False, d) for k, t, _, d in rows]
    same(scored(spark, nothing), plain_scores(nothing))
    assert scored(spark, []) == []


@pytest.mark.parametrize("numbers", [[], [0], [0, 0], [1, 255, 256], [2**64 - 1, 5], list(range(1000))])
def test_packing_is_exact(numbers):
    values = np.array(numbers, np.uint64)
    assert interpolation.unpacked(interpolation.packed(values)).tolist() == numbers
    assert interpolation.unpacked_sorted(interpolation.packed_sorted(np.sort(values))).tolist() == sorted(numbers)


def test_mixture_is_a_distribution():
    """Over all words and the unknown one, every context's probabilities add up to one."""
    text = "a b a c a b b a c d".split()
    totals = interpolation.Totals(len(text), 1, len(text), len(set(text)))
    weights = interpolation.leaning(np.random.default_rng(1).random((interpolation.LEVELS**2, 4)), np.array([1.0, 2, 3, 4]), totals)
    one, two = Counter(text), Counter(zip(text, text[1:], strict=False))
    for v in "abc":
        context = sum(c for (a, _), c in two.items() if a == v)
        counts = [np.array(x) for x in zip(*[(one[w], two[v, w], context, two[v, w], context) for w in sorted(one)] + [(0, 0, context, 0, context)], strict=True)]
        bucket, shares = interpolation.estimates(counts, totals)
        assert (weights[bucket] * shares).sum() == pytest.approx(1)


def test_held_out_documents_gain(spark):
    """Held-out documents are likelier under the model than under the base's unigrams."""
    rows = [r for r in queries.QUERIES["op13_lm_scores"](spark, SF).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert len({r["train_tokens"] for r in rows}) == 1
