"""The language models and the quality score against plain versions without hashes, arrays or batches."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
import zstandard

from corpusloom.llm import language, quality

SF = "/root/testdata/sf0.001"


def characters(text):
    """Lower-case letters, one blank for a run of anything else, none at the beginning."""
    out = []
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or out and out[-1] != " ":
            out.append(c)
    return out


def plain_grams(text):
    padded = ["^"] * 3 + characters(text)
    return [tuple(padded[i - 3 : i + 1]) for i in range(3, len(padded))]


class PlainModel:
    """Interpolated Kneser-Ney over dictionaries of tuples for one language."""

    def __init__(self, texts, floor):
        self.floor, self.levels, self.discount = floor, {4: Counter(g for t in texts for g in plain_grams(t))}, {}
        for order in (3, 2, 1):
            self.levels[order] = Counter(g[1:] for g in self.levels[order + 1])
        for order, level in self.levels.items():
            one, two = (sum(n == k for n in level.values()) for k in (1, 2))
            self.discount[order] = one / (one + 2 * two) if one else 0.5
        self.total, self.kinds = defaultdict(int), defaultdict(int)
        for level in self.levels.values():
            for g, n in level.items():
                self.total[len(g), g[:-1]] += n
                self.kinds[len(g), g[:-1]] += 1

    def probability(self, gram):
        if not gram:
            return self.floor
        total, lower = self.total[len(gram), gram[:-1]], self.probability(gram[1:])
        if not total:
            return lower
        d = self.discount[len(gram)]
        return max(self.levels[len(gram)][gram] - d, 0) / total + d * self.kinds[len(gram), gram[:-1]] / total * lower

    def entropy(self, text):
        grams = plain_grams(text)
        return -sum(math.log(self.probability(g)) for g in grams) / max(1, len(grams))


def test_language_models_equal_plain_kneser_ney(spark):
    """Cross-entropies and predictions over a few letters, of which so few grams arise that no two share a hash."""
    draw = random.Random(8)
    letters = {"aa": "abcé ", "bb": "abde. ", "cc": "bcdA9 "}
    rows = [(lang, "".join(draw.choice(some) for _ in range(draw.randint(0, 60)))) for lang, some in letters.items() for _ in range(30)]
    rows += [("aa", rows[0][1])] * 40 + [(None, "zzzz"), ("bb", None), ("cc", "")]
    model = language.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.langs == ["aa", "bb", "cc"]
    texts = {lang: [t for name, t in rows if name == lang and t] for lang in model.langs}
    seen = {g[-1] for some in texts.values() for t in some for g in plain_grams(t)}
    plain = {lang: PlainModel(some, 1 / (len(seen) + 1)) for lang, some in texts.items()}
    asked = [t for some in texts.values() for t in some[:10]] + ["abc abc", "xyz", "Éa, b", "  a", "abé" * 300, "e d.", "q"]
    got = model.entropy(asked)[1]
    for i, text in enumerate(asked):
        assert got[i].tolist() == pytest.approx([plain[lang].entropy(text) for lang in model.langs], rel=1e-4), text
    found = language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string"), model).collect()
    for r in found:
        each = [plain[lang].entropy(asked[r["doc_id"]]) for lang in model.langs]
        n = min(sum(c.isalpha() for c in characters(asked[r["doc_id"]])), language.EVIDENCE)
        assert r["lang_pred"] == model.langs[each.index(min(each))]
        assert r["score"] == pytest.approx(1 / sum(math.exp(n * (min(each) - e)) for e in each), rel=1e-2)


def test_quality_scores_equal_plain_compression(spark):
    """Every document: sizes by a fresh compressor for each block, and the score by the formula, one document at a time."""
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(documents, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scores(documents, model).collect()}

    def size(block, dictionary):
        known = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))

    rows = documents.collect()
    for r in rows:
        data = (r["text"] or "").encode()
        blocks = [data[i : i + 1024] for i in range(0, len(data), 1024)]
        good, bad = (sum(size(b, d) for b in blocks) for d in (model.good, model.bad))
        raw = ((good - bad) / max(good + bad, 1), math.log((good + bad + 2) / (2 * len(data) + 2) + 1e-3))
        d, s = (max(-4.0, min(4.0, (x - c) / w)) for x, c, w in zip(raw, model.centre, model.spread, strict=True))
        z = sum(w * x for w, x in zip(model.weights, (1, d, s, d * s, d * d, s * s), strict=True))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert len(got) == len(rows)
