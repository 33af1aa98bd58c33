"""Near-duplicates, decontamination, classifiers, extraction, license scans and the pipeline against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, html, language, licenses, quality, queries, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, key string, row int, item string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, one word, repeated rows, a very long text, and columns whose names clash."""
    rows = [(1, None, None, None, "x", 1, "i"), (2, "", "en", "a", None, 2, None), (3, "word", "en", "a", "y", 3, "i"), (3, "word", "en", "a", "y", 3, "i"),
            (None, "No id here.", None, None, None, None, None), (5, "Under the MIT license; apache LICENSE, version 2. \n" * 3000, "en", "b", "z", 5, "i"), (6, "x" * 5000, "de", "b", "z", 6, "i")]
    return spark.createDataFrame(rows, DOCS)


# near-duplicates


def plain_simhash(text):
    found = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not found:
        return 0
    grams = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys_and_prints):
    rows = list(keys_and_prints)
    fps = np.array([f for _, f in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 2).tolist():
            parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], 1 << 62 if key is None else key)
    return [least[find(i)] for i in range(len(rows))]


def test_near_duplicates(documents, odd):
    for frame in (documents, odd):
        rows = frame.select("doc_id", "text").collect()
        prints = [plain_simhash(r["text"]) for r in rows]
        classes = plain_components((r["doc_id"], f) for r, f in zip(rows, prints, strict=True))
        want = sorted((r["doc_id"] or -1, f"{f:016x}", c) for r, f, c in zip(rows, prints, classes, strict=True))
        found = simhash.near_duplicates(frame).select("doc_id", simhash.hexadecimal(F.col("fp")), "component_id").collect()
        assert sorted((r[0] or -1, r[1], r[2] if r[2] is not None else 1 << 62) for r in found) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_across_runs_in_dense_clouds(spark, monkeypatch):
    """Many runs, fingerprints that differ in few bits, chains, and singles."""
    monkeypatch.setattr(simhash, "NODE", 64)
    draw = random.Random(5)
    fps = {draw.getrandbits(64) for _ in range(400)} | {0, (1 << 64) - 1, 1 << 63}
    for base in list(fps)[:5]:
        fps |= {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for _ in range(80)}
    fps |= {0xABCDEF << 40 | m for m in range(300)}
    chain = draw.getrandbits(64)
    for b in range(0, 60, 2):
        fps.add(chain := chain ^ (3 << b))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    found = defaultdict(set)
    for f in signed:
        found[roots.get(f, f)].add(f)
    want = defaultdict(set)
    for f, c in zip(signed, plain_components((i, f & (1 << 64) - 1) for i, f in enumerate(signed)), strict=True):
        want[c].add(f)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1) | st.integers(0, 63).map(lambda b: 1 << b), min_size=1, max_size=90, unique=True))
def test_gray_index_finds_all(fps):
    values = np.array(fps, np.uint64)
    values = values[simhash.gray_order(values)]
    index = simhash.GrayIndex(values.copy(), np.full(len(values), ~np.uint64(0)))
    found = {(int(a), int(b)) for at, leaf in index.search(values, 2) for a, b in zip(at, leaf, strict=True)}
    assert found == {(i, j) for i in range(len(values)) for j in range(len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}


# decontamination


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(docs, items, size=10):
    known = defaultdict(set)
    for i, t in items:
        found = tokens(t)
        for at in range(max(1, len(found) - size + 1) if found else 0):
            known[tuple(found[at : at + size])].add(i)
    widths = {len(w) for w in known}
    for key, t in docs:
        found = tokens(t)
        hit, seen = set(), set()
        for width in widths:
            for at in range(len(found) - width + 1):
                if (w := tuple(found[at : at + width])) in known:
                    hit |= set(range(at, at + width))
                    seen |= known[w]
        listed = sorted(str(i) for i in seen if i is not None)
        yield key if key is not None else -1, len(found), len(hit), listed


def test_contamination(spark, documents, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    short = spark.createDataFrame([(7, "word"), (7, "MIT license"), (8, None), (9, "..."), (None, "no id here"), (10, "license apache license version 2 under the mit license apache license version 2"), (10, "word")], items.schema)
    for docs, some in ((documents, items), (odd, short), (documents, short), (odd, items), (odd, items.limit(0)), (odd.limit(0), items)):
        found = decontaminate.contamination(docs, some).collect()
        want = plain_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in some.collect()])
        assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in found) == sorted(want)


# classifiers


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.document_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert {r["held_out"] for r in held} == {True} and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([np.mean(np.array(good) > b) for b in bad]) > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93


def test_logistic_on_separable_and_odd_data():
    draw = np.random.default_rng(3)
    for scale in (1, 5, 20):
        d, r = draw.normal(size=(2, 3000)) * scale
        x = np.stack([np.ones_like(d), d, r, d * r, d * d, r * r], axis=1)
        y = (d + 0.5 * r < 1.5 * scale).astype(float)
        w = quality.logistic(x, y)
        p = 1 / (1 + np.exp(-x @ w))
        assert np.abs(x.T @ (y - p) - w).max() < 1e-2 * len(y)  # the slope of the penalised loss is flat
        assert ((p >= 0.5) == y).mean() > 0.97


def test_quality_odd_inputs(spark, odd):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in quality.scores(odd, quality.train(odd, labels([]))).collect()} == {0.5}
    assert {r["score"] for r in quality.scores(odd, quality.train(odd, labels([(3, 1, 0), (5, 1, 0), (99, 0, 0), (6, None, 0)]))).collect()} == {1.0}
    found = quality.scores(odd, quality.train(odd, labels([(3, 1, 0), (3, 0, 0), (5, 1, 0), (6, 0, 1), (1, 0, 0)]))).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality.scores(odd.limit(0), quality.train(odd.limit(0), labels([(3, 1, 0)]))).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.document_languages(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 2


def test_language_model_is_a_distribution(spark, documents):
    model = language.train(documents)
    letters = np.array(sorted({int(c) & 0xFFFF for c in language.grams([r["text"] for r in documents.collect()])[0]}), np.uint64)
    for context in ("", "t", "th", "the", "zqx", " de"):
        codes = np.array([sum((ord(c) if c != " " else 32) << 16 * (n + 1) for n, c in enumerate(reversed(context))) | int(x) for x in letters], np.uint64)
        assert np.exp(model.log_probabilities(codes)).sum(axis=0) == pytest.approx(1, abs=0.1)  # a gram in 2^24 hashes may meet another


def test_language_odd_inputs(spark, odd, documents):
    model = language.calibrate(language.train(documents), documents)
    rows = {r["doc_id"] or -1: r for r in language.identify(odd, model).collect()}
    assert [rows[k]["lang_pred"] for k in (1, 2)] == ["und", "und"] and rows[1]["rejected"] and rows[2]["score"] == 0
    assert rows[3]["lang_pred"] in model.langs and rows[6]["rejected"]
    assert {r["lang_pred"] for r in language.identify(odd, language.train(odd.limit(0))).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("kind", ["unlearned", "junk", "labelled"])
def test_language_stage_rejects_what_is_common(spark, kind):
    """A third of the rows in languages without labels or of random letters, or some junk with a label."""
    draw = random.Random(4)
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = lambda n: [(10000 + i, "".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(900))) for i in range(n)]
    if kind == "unlearned":
        good = known.where("lang = 'de' OR lang = 'en' AND doc_id % 2 = 0")
        bad = known.where("lang IN ('es', 'fr') AND n_chars > 300").withColumn("lang", F.lit(None).cast("string"))
    else:
        good = known
        bad = spark.createDataFrame(junk(500 if kind == "junk" else 30), "doc_id bigint, text string").withColumns(
            {"lang": F.lit("en" if kind == "labelled" else None).cast("string"), "source": F.lit("junk"), "n_chars": F.lit(900).cast("bigint")})
    good = good.where("n_chars > 0")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["language"](spark, good.unionByName(bad), SF).select("doc_id").collect()}
    goods, bads = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (good, bad))
    assert len(kept & bads) <= 0.02 * len(bads)
    assert len(kept & goods) >= 0.99 * len(goods)


# extraction


def test_pages_of_the_table(spark):
    for r in queries.page_texts(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(html.entities.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("<nav>Menu</nav>", ""), ("<script>var x = '<p>no</p>';", ""), ("<article><p>a &lt;b&gt; &amp;c\n\t d<p>e<br>f</article>", "a <b> &c d\n\ne f"),
    ("<main><h1>T</h1><p>One <b>two</b> three.</p><aside><p>Other stories you may like to read today</p></aside></main></div></div>", "T\n\nOne two three."),
    ("<body><div class='cookie notice'><p>We use cookies on this page for you.</p></div><article><p>This is what the page has to say about it.</p>"
     "<section id=comments><div class=comment><p>Great text, I liked it very much, thank you for that!</p></div></section></article></body>", "This is what the page has to say about it."),
    ("<article><p>Some words.</p><form><label>Name</label><textarea>text</textarea></form><style>p{}</style><!-- <p>x</p> --></article><footer>Foot</footer>", "Some words."),
])
def test_main_text(source, want):
    assert html.main_text(source) == want


def plain_layouts(chain):
    """Unlabelled pages of a chain with the texts that are marked in them."""
    for around in html.SURROUNDINGS:
        for opening in html.OPENINGS:
            for body in html.bodies():
                source = html.laid_out(chain, opening, around, body)
                page = html.Page(source)
                yield source.replace(" data-main", ""), "\n\n".join(t for node, t in page.texts if page.marked[node])


@pytest.mark.parametrize("chain", [c for c in html.CHAINS if c], ids=repr)
def test_layouts_that_were_left_out(chain):
    """Every page of a layout that the model has not seen, with and without menus, adverts, footers and comments, exactly."""
    model = html.Model([html.Page(p) for p in html.training_pages(tuple(c for c in html.CHAINS if c != chain))])
    pages = list(plain_layouts(chain))
    assert len(pages) > 150 and all(html.main_text(source, model) == want for source, want in pages)


def test_text_right_inside_the_body():
    """Most of these pages exactly; all of those without lists that have paragraphs of more than a few words."""
    pages = list(plain_layouts(()))
    assert sum(html.main_text(source) == want for source, want in pages) > 0.8 * len(pages)
    sentence = "A sentence of some twenty words stands in this paragraph so that it is long enough for any rule that counts them."
    for source in (f"<html><body><p>{sentence}</p><p>{sentence}</p></body></html>", f"<html><body><h1>Title</h1><p>{sentence}</p><p>{sentence}</p></body></html>",
                   f"<body><div><p>{sentence}</p></div></body>", f"<html><body><div class='page'>{f'<p>{sentence}</p>' * 20}</div></body></html>"):
        assert html.main_text(source).count(sentence) == source.count(sentence)
    page = f"<html><body><div class='sponsor-box'><p>{sentence}</p></div><article><p>{sentence}</p><ul><li><a href=x>One link</a></li></ul></article></body></html>"
    assert html.main_text(page) == f"{sentence}\n\nOne link"


STORY = "<article><h1>Title</h1><p>One two three words of the story.</p>%s<p>Four five six words more of it.</p></article>"
STORY_TEXT = "Title\n\nOne two three words of the story.%s\n\nFour five six words more of it."


@pytest.mark.parametrize("source, want", [
    ("<html><head><title>t</title><meta charset=utf-8><body>" + STORY % "" + "</body></html>", STORY_TEXT % ""),
    ("<head><title>t</title><script>x</script><noscript><link rel=x></noscript>" + STORY % "", STORY_TEXT % ""),
    ("<head><style>p{}</style></head><body>" + STORY % "", STORY_TEXT % ""),
    *((STORY % f"<{x}>", STORY_TEXT % "") for x in ("svg", "object", "video", "audio", "canvas", "math")),
    (STORY % "<video src=a><div></div><video>no</video>", STORY_TEXT % ""),
    (STORY % "<svg><text>no</text><foreignObject><div>no</div></foreignObject></svg><video><p>no</p></video>", STORY_TEXT % ""),
    (STORY % "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p>", STORY_TEXT % "\n\nLet x = 2."),
    *((STORY % f"<{x}><p>Seven eight nine words inside of it.</p></{x}>", STORY_TEXT % "\n\nSeven eight nine words inside of it.") for x in ("noscript", "object")),
    *((STORY % f"<{x}>Seven eight nine words inside of it.</{x}>", STORY_TEXT % "\n\nSeven eight nine words inside of it.") for x in ("noscript", "object")),
])
def test_main_text_of_open_heads_and_embedded_elements(source, want):
    assert html.main_text(source) == want


def test_bare_text_ends_a_head():
    page = html.Page("<head><title>t</title> <link> Words of the page")
    assert [(page.names[n], t) for n, t in page.texts] == [("#page", "Words of the page")]


def test_marginals_equal_enumeration():
    model, page = html.trained(), html.Page("<div><p>one two three</p><ul><li>a</li><li>b</li></ul></div><footer>end</footer>")
    size = len(page.names)
    own = [model.prior + sum(model.evidence.get(f, 0) for f in page.features(n)) for n in range(size)]
    weights = np.zeros((1 << size - 1, size + 1))
    for number in range(1 << size - 1):
        y = [0] + [number >> n & 1 for n in range(size - 1)]
        w = np.prod([np.exp(own[n] * y[n]) * model.pair[y[page.parents[n]]][y[n]] for n in range(1, size)])
        weights[number] = [w, *(w * v for v in y)]
    assert model.marginals(page) == pytest.approx((weights.sum(axis=0) / weights[:, 0].sum())[1:])


def test_extract_odd_inputs(spark):
    frame = spark.createDataFrame([(1, None, "u", "t"), (1, "<p>" * 20000 + "deep", "u", "t"), (None, "<div>" * 20000 + "x", None, None)], "page_id int, html string, url string, text string")
    assert html.extract(frame).count() == 3 and html.extract(frame.limit(0)).count() == 0


# license scans


def test_license_base(spark, documents, odd):
    for frame in (documents, odd):
        want = []
        for r in frame.collect():
            found, starts, labels = tokens(r["text"]), [], set()
            for phrase, label in licenses.PHRASES:
                w = phrase.split()
                at = [i for i in range(len(found)) if found[i : i + len(w)] == w]
                starts += at
                labels |= {label} if at else set()
            want.append((r["doc_id"] or -1, len(found), len(starts), min(starts, default=-1), max(starts, default=-1), ",".join(sorted(labels))))
        rows = licenses.license_labels(frame).collect()
        none = lambda v: -1 if v is None else v
        assert sorted((r[0] or -1, r[1], r[2], none(r[3]), none(r[4]), r[5]) for r in rows) == sorted(want)
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)
    assert licenses.license_labels(odd.limit(0)).count() == 0


def test_license_notices(spark):
    gpl = licenses.NOTICES[5][0]
    rows = [(1, f"intro {gpl} outro"), (2, gpl.replace("redistribute it", "share and redistribute it freely").replace("option", "choice")), (3, " ".join(reversed(gpl.split()))),
            (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    found = {r["doc_id"]: r["labels"] for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert found == {1: "gpl-3", 2: "gpl-3", 3: "", 4: "gpl-3", 5: "cc-by-nc,mit"}


# pipeline


def test_stages_take_odd_rows(spark, odd):
    """Rows without id and repeated rows: nothing is lost or doubled by a join."""
    odd = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.lit("a").alias("odd: name."))
    rows = lambda df: sorted((r["doc_id"] or -1, r["text"] or "") for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    once = rows(odd.dropDuplicates(["doc_id", "text"]))
    assert rows(stages["near_duplicates"](spark, odd, SF)) == [r for r in once if r[0] != 2]  # 1 and 2 have no words
    assert rows(stages["decontamination"](spark, odd, SF)) == rows(odd)
    for name in ("quality", "language"):
        assert set(rows(stages[name](spark, odd, SF))) <= set(rows(odd))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_pipeline_stages(spark, documents):
    """Each stage against a plain version of its decision, on its own input."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        ids, before = {r["doc_id"] for r in kept.collect()}, docs.collect()
        if name == "near_duplicates":
            want = set(plain_components((r["doc_id"], plain_simhash(r["text"])) for r in before))
            assert ids == want and kept.count() == len(want)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert ids == {k for k, _, hit, _ in plain_contamination([(r["doc_id"], r["text"]) for r in before], items) if not hit}
        if name == "language":
            assert len(ids) >= len(before) - 1
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert np.mean([(i in ids) == bool(labels[i]) for i in labels]) > 0.85
        docs = kept
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == ids
    digest = hashlib.sha256(repr(sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect()))).encode()).hexdigest()
    again = hashlib.sha256(repr(sorted(map(tuple, queries.pack_all(docs).select("doc_id", "piece", "ids_crc32").collect()))).encode()).hexdigest()
    assert digest == again
