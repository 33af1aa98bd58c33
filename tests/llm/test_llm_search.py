"""Hard-negative mining and ranked lexical search against plain versions."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import hard_negatives, lexical
from pyspark.sql import functions as F

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, tile int"
DOCS = "doc_id bigint, text string, key string, n int, score int"
ITEMS = "item_id string, text string, term string"


# hard negatives


def plain_negatives(rows, every=10, positives=5, negatives=10):
    """``rows``: id, label, whole-number vector, each once."""
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w, strict=True)), k, other) for k, other, w in rows if k != a)
        for s, p, other in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, i, k, -s, -t) for i, (t, k, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=10):
    frame = spark.createDataFrame([(k, v, label, "x", 1) for k, label, v in rows], VECTORS)
    return sorted(map(tuple, hard_negatives.hard_negatives(frame, F.col("vec_id") % every == 0).collect()))


@pytest.fixture
def small_nodes(monkeypatch):
    """Small tiles, trees and blocks, so that a few hundred rows take every path (module values reach workers by closure)."""
    for name, value in (("TILE", 64), ("SAMPLE", 128), ("ANCHORS", 8)):
        monkeypatch.setattr(hard_negatives, name, value)


@pytest.mark.parametrize("spread", [0.02, 0.6])
def test_hard_negatives(spark, small_nodes, spread):
    """Clustered and loose vectors, many ties, repeated rows and one vector that a third of the rows share."""
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(6, 8))
    rows = []
    for k in range(600):
        vec = centres[0] if k % 3 == 0 else centres[k % 6] + spread * draw.normal(size=8)
        rows.append((k, int(draw.integers(0, 4)), [float(np.float32(x)) for x in vec]))
    plain = [(k, label, [math.floor(256 * x) for x in v]) for k, label, v in rows]
    want = plain_negatives(plain)
    assert want and mined(spark, rows + rows[:50]) == want


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, 2, [0.5]), (4, 2, []), (0, 1, [1.0, 0.5])]
    odd = [(10, 1, None), (20, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (30, 1, [nan, 1.0]), (40, 2, [inf, 1.0]), (50, 2, [None, 1.0])]
    # the shorter vector is filled up with zeros; the empty one scores 0, below every window
    assert mined(spark, good + odd) == [(0, 1, 1, 2, 256 * 256 + 128 * 64, 256 * 128 + 128 * 128), (0, 1, 2, 3, 256 * 256 + 128 * 64, 256 * 128)]
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0])]) == []
    with pytest.raises(ValueError, match="too large"):
        mined(spark, [(0, 1, [1e30])])


def test_r_tree_prunes():
    """Clusters that lie apart: a search opens few leaves and finds what a scan finds."""
    draw = np.random.default_rng(1)
    vecs = np.floor(40 * draw.normal(size=(64, 4)))[np.repeat(np.arange(64), 128)] + draw.integers(0, 3, size=(8192, 4))
    labels = np.zeros(8192, np.int64)
    tree = hard_negatives.RTree(np.arange(8192), labels, vecs)
    at, wide = np.arange(20), np.full(20, 1 << 60)
    anchors = np.arange(20) * 400
    wants = hard_negatives.Wants(anchors, labels[anchors], vecs[anchors], at, -wide, wide, np.full(20, hard_negatives.NONE), 5, True)
    found = hard_negatives.Found(wants)
    opened = hard_negatives.search(tree, found)
    assert opened < len(tree.ends) // 2
    for i, a in enumerate(anchors):
        scores = (vecs @ vecs[a]).astype(int)
        want = sorted((-s, k) for k, s in enumerate(scores.tolist()) if k != a)[:5]
        assert [(-s, k) for s, k in zip(found.scores[i].tolist(), found.ids[i].tolist(), strict=True)] == want


# lexical search


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranks(docs, items, top):
    counts = [(k, Counter(terms(t)), len(terms(t))) for k, t in docs]
    total, length = sum(n > 0 for *_, n in counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for k, t in items:
        asked.setdefault(k, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for k, c, n in counts:
            if n:
                m = 50 + (50 * n * total) // length
                w = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in wanted if t in c}
                score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in w)
                if score:
                    scored.append((-score, k is None, k or 0, k))
        out += [(item, i, k, -s) for i, (s, _, _, k) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1)]
    return out


def ranked(spark, docs, items, top):
    found = lexical.rank(spark.createDataFrame([(k, t, "x", 1, 2) for k, t in docs], DOCS),
                         spark.createDataFrame([(k, t, "x") for k, t in items], ITEMS), top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return list(map(tuple, found.collect()))


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_lexical_search(spark, monkeypatch, block):
    """A skewed vocabulary, copies of one text for a third of the rows, several blocks of items."""
    monkeypatch.setattr(lexical, "BLOCK", block)
    draw = np.random.default_rng(3)
    word = [f"w{i}" if i % 3 else f"Été{i}" for i in range(400)]
    texts = [" ".join(word[int(i)] for i in np.minimum(draw.zipf(1.3, int(draw.integers(1, 60))), 399)) for _ in range(500)]
    docs = [(k, texts[0] if k % 3 == 0 else t) for k, t in enumerate(texts)]
    items = [(f"i{k}", " ".join(draw.choice(word, 12))) for k in range(12)] + [("i0", "w1 W2, w2"), ("i3", None)]
    assert order(ranked(spark, docs, items, 20)) == order(plain_ranks(docs, items, 20))


def test_lexical_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "..."), (4, "One two"), (None, "one two"), (4, "One two"), (5, "one " * 50_000), (6, "été　one")]
    items = [("a", "ONE"), (None, "two"), (None, "one"), ("b", None), ("c", ""), ("d", "nowhere"), ("e", "été　")]
    want = plain_ranks(docs, items, 50)
    assert order(ranked(spark, docs, items, 50)) == order(want) and {r[0] for r in want} == {"a", None}
    assert ranked(spark, [], items, 50) == [] and ranked(spark, docs, [], 50) == [] and ranked(spark, [(1, None)], items, 50) == []


def test_ball_tree_prunes():
    """Topics without common words: a search opens the leaves of its own topic and few others."""
    draw = np.random.default_rng(5)
    rows = 2048
    ids = [np.unique(draw.integers(0, 20, 8)) + 20 * (r % 32) for r in range(rows)]
    lens = np.array([len(i) for i in ids])
    vals = draw.integers(1, 1000, lens.sum()).astype(np.float64)
    flat = np.concatenate(ids)
    root = lexical.Ball(np.arange(rows), lens, flat, vals, 640)
    items = lexical.Items(np.repeat(np.arange(4), 3), np.array([0, 1, 2, 25, 26, 27, 300, 301, 302, 5, 400, 639]), 640)
    best = lexical.Best(4, 10)
    assert lexical.search(root, items, np.arange(rows), best) < rows // lexical.LEAF
    dense = np.zeros((rows, 640), np.int64)
    dense[np.repeat(np.arange(rows), lens), flat] = vals
    for i, wanted in enumerate(([0, 1, 2], [25, 26, 27], [300, 301, 302], [5, 400, 639])):
        want = sorted((-s, k) for k, s in enumerate(dense[:, wanted].sum(axis=1).tolist()) if s)[:10]
        assert list(zip((-best.scores[i]).tolist(), best.keys[i].tolist(), strict=True)) == want
