"""Chat formatting, token counts, packing and fingerprints against plain versions on small inputs."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat, fingerprints, packing, queries, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, key string, row int"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, one word, repeated rows, a very long text, and columns whose names clash."""
    rows = [(1, None, None, None, "x", 1), (2, "", "en", "a", None, 2), (3, "word", "en", "a", "y", 3), (3, "word", "en", "a", "y", 3),
            (None, "No id here.", None, None, None, None), (5, "long text <|endoftext|> été\u3000ǅ 12.5\n" * 3000, "en", "b", "z", 5), (6, "x" * 5000, "de", "b", "z", 6)]
    return spark.createDataFrame(rows, DOCS)


# chat


@given(st.text(alphabet="\\#</turn>: a\né", max_size=30))
def test_escape_is_reversible(text):
    hidden = chat.escape(text)
    assert "###" not in hidden and "</turn>" not in hidden
    assert chat.unescape(hidden) == text
    assert chat.unescape(chat.escape_role(text)) == text


def expected_chats(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        whole = "".join(f"### {chat.escape_role(r)}: {chat.escape(t)}</turn>\n" for *_, r, t in turns)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    return out


def test_chat_digests(spark):
    rows = [(1, 0, "user", "### hi"), (1, 1, "assistant", "a\\b</turn>\n### user: c"), (1, 1, "assistant", "a\\b</turn>\n### user: c"), (1, 2, "assistant", None),
            (2, 0, None, None), (3, None, "assistant", "<|endoftext|> 𝄞é"), (3, 0, "as: x", "t"), (None, 0, "assistant", ""), (4, 0, "assistant", "long " * 5000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("ids", F.lit(1))
    found = chat.digests(chat.read_back(chat.format_turns(frame, BYTE), BYTE)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == expected_chats(rows)
    assert chat.digests(chat.read_back(chat.format_turns(frame.limit(0), BYTE), BYTE)).count() == 0


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]
    assert {r[0]: tuple(r[1:]) for r in queries.formatted_conversations(spark, SF).collect()} == expected_chats(rows)


def test_mask_covers_only_trained_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", "question"), (1, 1, "assistant", "answer")], "conv_id int, turn int, role string, text string")
    known = chat.loaded(BYTE)
    for r in chat.format_turns(rows, BYTE).collect():
        ids, mask = np.array(r["ids"]), np.array(r["loss_mask"])
        assert known.decode(ids[mask == 1].tolist()) == ("answer" if r["turn"] else "")
        assert chat.render(ids, known) == r["formatted"]


# token counts


def plain_count(word: str, costs: dict[str, int]) -> int:
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        found = [(best[b][0] + costs[word[b:end]], best[b][1] + 1) for b in range(end) if word[b:end] in costs]
        if word[end - 1] not in costs:
            size = len(word[end - 1].encode())
            found.append((best[end - 1][0] + size * token_counts.BYTE_COST, best[end - 1][1] + size))
        best.append(min(found))
    return best[-1][1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="thaeinré𝄞z", min_size=1, max_size=12), max_size=8))
def test_trie_equals_plain_program(words):
    costs = token_counts.vocabulary(PIECE)
    trie = token_counts.trie(PIECE)
    assert [trie.insert(w) for w in words] == [plain_count("▁" + w, costs) for w in words]


def test_token_counts(spark, odd):
    costs = token_counts.vocabulary(PIECE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for frame in (docs, odd.where("doc_id IS NULL OR doc_id < 6")):
        found = sorted((r["doc_id"] or -1, r["n_pretokens"], r["n_tokens"]) for r in token_counts.count_tokens(frame, PIECE).collect())
        known: dict[str, int] = {}
        want = []
        for r in frame.collect():
            chunks = (r["text"] or "").split()
            for c in set(chunks) - known.keys():
                known[c] = plain_count("▁" + c, costs)
            want.append((r["doc_id"] or -1, len(chunks), sum(known[c] for c in chunks)))
        assert found == sorted(want)
    assert token_counts.count_tokens(odd.limit(0), PIECE).count() == 0


def test_trie_starts_anew_when_full(spark, monkeypatch):
    trie = token_counts.Trie(token_counts.vocabulary(PIECE))
    first = trie.insert("thing")
    assert trie.counts == {"thing": first}
    trie.clear()
    assert trie.insert("thing") == first and len(trie.cost) == len("▁thing") + 1


# packing


def packed_ids(text, tokenizer):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_of_odd_letters():
    """Random texts over letters of all cases, combining marks and signs against the tokenizer itself."""
    from tokenizers import Tokenizer

    alphabet = list("abzAZ09 .,;:!?|*#$%&'-_\n\t") + list("\u0130\u0131\u015e\u011e\u00c7\u00dc\u00df\u1e9e\u01c5\u01f0\u0149\u03a3\u03c3\u03c2\u0391\u0390\u0301\u0307\u0327\u0308"
        "\u00c5\u212b\ufb01\ufb03\u2167\u0587\u10a0\u13a0\uab70\u0531\u0410\u0451\u05d0\u0627\u0915\u093e\u4e00\u3042\uac00\u1100\u1161\u2126\u00aa\u00ba\u02b0\u1d2c\u24b6\U0001d400\U00010400\U0001f600\u200d\u3000\u00a0")
    tokenizer, draw = Tokenizer.from_file(WORD), np.random.default_rng(11)
    texts = ["".join(alphabet[i] for i in draw.integers(0, len(alphabet), int(draw.integers(1, 14)))) for _ in range(50_000)]
    texts += ["\u015eEHR\u0130.", "K\u0130ML\u0130\u011e\u0130,", "DEN\u0130Z\u0130:", "\u0130", "\u0130\u0130!", "a\u0130? \u0130b|"]
    for begin in range(0, len(texts), 1000):
        some = texts[begin : begin + 1000]
        got = packing.encoder(WORD).encode(some)
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
        assert got == want


def test_pieces_and_places(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        rows = queries.pack_all(frame).collect()
        want = []
        for r in frame.collect():
            ids = packed_ids(r["text"], tokenizer)
            want += [(r["doc_id"] or -1, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
        assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
        assert check_packing(rows, 2048) <= -(-sum(w[3] for w in want) // 2048) * 1.02 + 1
    assert queries.pack_all(odd.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plan_is_gapless_and_no_worse_than_first_fit_decreasing(case):
    capacity, lengths = case
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.Plan(counts, capacity)
    used = defaultdict(list)
    for n, slots in plan.slots.items():
        ends = [s[0] for s in slots[1:]] + [counts[n]]
        for (rank, sequence, offset), end in zip(slots, ends, strict=True):
            for i in range(end - rank):
                used[sequence + i].append((offset, n))
    assert sorted(n for places in used.values() for _, n in places) == sorted(lengths)
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        for i, room in enumerate(bins):
            if room >= n:
                bins[i] -= n
                break
        else:
            bins.append(capacity - n)
    assert len(used) == plan.sequences <= len(bins) * 1.1 + 1


def test_packing_ranks_across_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    table = spark.range(700).select("id", (F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 10 + 1)).cast("long").alias("length"), F.lit("x").alias("offset"))
    rows = packing.pack(table, 10).collect()
    assert sorted(r["id"] for r in rows) == list(range(700))
    check_packing(rows, 10)


# fingerprints


def plain_likeness(one: str, two: str) -> float:
    a, b = ({*fingerprints.digests([t])[0].tolist()} for t in (one, two))
    return 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))


def test_version_fingerprints(spark, odd):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet").repartition(5), odd):
        rows = fingerprints.version_fingerprints(frame).collect()
        docs = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
        docs.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
        want = []
        for i, (key, text) in enumerate(docs):
            after = docs[(i + 1) % len(docs)][1]
            version = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
            want.append((key or -1, len(text), hashlib.sha256(version.encode()).hexdigest(), round(plain_likeness(text, version), 9), round(plain_likeness(text, after), 9)))
        assert sorted((r[0] or -1, r[1], r[2], round(r[5], 9), round(r[6], 9)) for r in rows) == sorted(want)
        prints = defaultdict(set)
        for r in rows:
            prints[dict(docs)[r[0]]].add(r["fingerprint"])
        assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.version_fingerprints(odd.limit(0)).count() == 0
    single = fingerprints.version_fingerprints(odd.where("doc_id = 5")).first()
    assert single["near_next"] == 1.0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60))), min_size=1, max_size=5))
def test_peeling_recovers_what_differs(pairs):
    def digests(n):
        keys = [(fingerprints.mixed(np.array(sorted(p[n]), np.uint64), 5), np.full(len(p[n]), i)) for i, p in enumerate(pairs)]
        return tuple(np.concatenate(x) for x in zip(*keys, strict=True))

    one, two = digests(0), digests(1)
    size = len(pairs)
    found = fingerprints.differences(one, two, fingerprints.stored(one, size), fingerprints.stored(two, size))
    assert found.tolist() == [len(a ^ b) for a, b in pairs]
    texts = [fingerprints.stored(d, size).texts() for d in (one, two)]
    for i, pair in enumerate(pairs):
        a, b = ({*fingerprints.mixed(np.array(sorted(p), np.uint64), 5).tolist()} for p in pair)
        only_one, only_two, complete = fingerprints.decode(texts[0][i], texts[1][i])
        assert {*only_one} <= a - b and {*only_two} <= b - a
        assert complete == (({*only_one}, {*only_two}) == (a - b, b - a))


def test_versions_follow_each_other_across_many_ranges(spark):
    """More ranges than fit, and one document that is a third of all rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(7)
    docs = docs.unionByName(docs.where("doc_id % 9 = 0")).unionByName(docs.where("doc_id = 5").select(F.explode(F.array_repeat(F.struct("doc_id", "text"), 100)).alias("r")).select("r.*"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: -r[0])
    want = [(k, hashlib.sha256(fingerprints.edited(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(rows)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        got = [(r["doc_id"], r["edited_sha256"]) for r in fingerprints.version_fingerprints(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == sorted(want)


def test_stored_fingerprints_decode(spark):
    """What two stored fingerprints differ in, without the texts: nearly all of small edits, of edits of half a text
    about four fifths (80 % of 3,000 documents at sf0.1)."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = fingerprints.version_fingerprints(docs)
    found = {r["doc_id"]: r for r in fingerprints.decoded(made, "doc_id").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    keys = sorted(texts, reverse=True)
    complete = 0
    for i, key in enumerate(keys):
        version = fingerprints.edited(texts[key], texts[keys[(i + 1) % len(keys)]])
        a, b = ({*fingerprints.digests([t])[0].view(np.int64).tolist()} for t in (texts[key], version))
        r = found[key]
        assert {*r["only_one"]} <= a - b and {*r["only_two"]} <= b - a
        if r["complete"]:
            assert ({*r["only_one"]}, {*r["only_two"]}) == (a - b, b - a)
        complete += r["complete"]
    assert complete > 0.7 * len(keys)
    small = [(t, t.replace(" ", " added ", 1)) for t in texts.values() if len(t.split()) > 60]
    prints = [fingerprints.stored(fingerprints.digests(side), len(small)).texts() for side in map(list, zip(*small))]
    done = [fingerprints.decode(a, b)[2] for a, b in zip(*prints)]
    assert sum(done) > 0.99 * len(done)
    nothing = spark.createDataFrame([(1, None, None)], "k int, fingerprint string, edited_fingerprint string")
    assert fingerprints.decoded(nothing, "k").first()[1:] == ([], [], True)


def test_paragraphs_are_lines_and_sentences():
    found, row = fingerprints.paragraphs(["One two. Three\nfour five!\n\n six", "", "\u4e00\u3002 \u4e8c"])
    assert found == [b"One two.", b"Three", b"four five!", b"six", "\u4e00\u3002".encode(), "\u4e8c".encode()]
    assert row.tolist() == [0, 0, 0, 0, 2, 2]
    long, _ = fingerprints.paragraphs([" ".join(f"w{i}" for i in range(1000))])
    assert max(len(p.split()) for p in long) <= fingerprints.WORDS and b" ".join(long).count(b"w") == 1000
