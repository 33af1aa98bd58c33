"""Order statistics, slicing and sampling against brute force, including hot keys and ties."""

from __future__ import annotations

import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import compare, ordering, relatedness, sampling, slicing


def hot_rows(n=600, seed=3):
    """A hot source with most rows, a small one and a single row; values with heavy ties."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if i % 10 < 7 else "warm" if i < n - 1 else "one"
        value = rng.choice([0.5, 0.5, 0.5, round(rng.random(), 3), -rng.random()])
        rows.append((source, i * 3, value))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(hot_rows(), "source string, ord long, x double").repartition(4).cache()


@pytest.fixture(scope="module")
def by_source():
    out = {}
    for source, _, x in hot_rows():
        out.setdefault(source, []).append(x)
    return out


@pytest.mark.parametrize("block_rows", [1, 7, 100, 10_000])
def test_running_index(frame, block_rows):
    got = ordering.running_index(frame, ["source"], "ord", block_rows=block_rows).orderBy("source", "ord").collect()
    seen = {}
    for r in got:
        assert r["idx"] == seen.get(r["source"], -1) + 1
        seen[r["source"]] = r["idx"]
    assert len(got) == 600


@pytest.mark.parametrize("blocks", [2, 5, 64, 1024])
def test_exact_quantiles(frame, by_source, blocks):
    qs = {"lo": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "hi": 1.0}
    for r in ordering.exact_quantiles(frame, ["source"], "x", qs, blocks).collect():
        for name, q in qs.items():
            assert r[name] == pytest.approx(np.quantile(by_source[r["source"]], q), abs=1e-12)


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)], "source string, x double")
    assert ordering.exact_quantiles(df, ["source"], "x", {"m": 0.5}).first()["m"] == 2.0


def test_average_ranks_and_spearman(spark):
    rng = random.Random(5)
    xs = [rng.choice([1.0, 2.0, rng.random()]) for _ in range(200)]
    ys = [rng.choice([0.0, rng.random()]) for _ in xs]

    def rank(values):
        order = sorted(values)
        return {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(values)}

    rx, ry = rank(xs), rank(ys)
    df = spark.createDataFrame(list(zip(xs, ys)), "score_a double, score_b double")
    got = {r[0]: r[1] for r in ordering.average_ranks(df, "score_a", "r", 8).collect()}
    assert got == rx
    want = np.corrcoef([rx[x] for x in xs], [ry[y] for y in ys])[0, 1]
    assert compare.spearman(df).first()[0] == pytest.approx(want, abs=1e-9)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "score_a double, score_b double")
    assert compare.spearman(flat).first()[0] is None


def test_box_stats(frame, by_source):
    for r in relatedness.box_stats(frame, x="x").collect():
        values = np.array(by_source[r["source"]])
        q1, q3 = np.quantile(values, [0.25, 0.75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        assert r["whisker_low"] == pytest.approx(min(inside.min(), q1))
        assert r["whisker_high"] == pytest.approx(max(inside.max(), q3))
        assert r["outliers"] == len(values) - len(inside)


def test_score_summary(frame, by_source):
    everything = [x for xs in by_source.values() for x in xs]
    for r in relatedness.score_summary(frame, x="x").collect():
        values = everything if r["source"] == "ALL_FILES" else by_source[r["source"]]
        assert r["count"] == len(values)
        assert r["mean"] == pytest.approx(np.mean(values))
        assert r["median"] == pytest.approx(np.median(values))
        if len(values) > 1:
            assert r["std"] == pytest.approx(np.std(values, ddof=1))
        else:
            assert r["std"] is None


def greedy(sizes, limit):
    parts, fill, part = [], 0, 0
    for i, size in enumerate(sizes):
        if i == 0 or fill + size > limit:
            fill, part = 0, part + 1
        fill += size
        parts.append(part)
    return parts


def test_greedy_fixture():
    assert greedy([5, 6, 9, 20, 1], 12) == [1, 1, 2, 3, 4]


@pytest.mark.parametrize("block_rows", [1, 5, 37, 1000])
@pytest.mark.parametrize("kind", ["mixed", "equal", "large", "tiny", "zeros"])
def test_slice_by_size(spark, block_rows, kind):
    rng = random.Random(block_rows)
    pick = {
        "mixed": lambda: rng.choice([1, 3, 7, 12, 20]), "equal": lambda: 5, "large": lambda: rng.choice([13, 50]),
        "tiny": lambda: 1, "zeros": lambda: rng.choice([0, 0, 12, 13]),
    }[kind]
    sizes = {"a": [pick() for _ in range(211)], "b": [pick() for _ in range(9)], "c": [30]}
    rows = [(s, i * 2, n) for s, ns in sizes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "source string, ord long, n long").repartition(3)
    got = slicing.slice_by_size(df, F.col("n"), 12, block_rows=block_rows, group_blocks=1 + block_rows % 4).orderBy("source", "ord").collect()
    for source, ns in sizes.items():
        assert [r["part"] for r in got if r["source"] == source] == greedy(ns, 12)


def test_slices_respect_limit_or_hold_one_row(spark):
    df = spark.range(500).select(
        F.lit("s").alias("source"), F.col("id").alias("ord"), (F.hash("id") % 20 + 21).cast("long").alias("n")
    )
    parts = slicing.slice_by_size(df, F.col("n"), 100, block_rows=64).groupBy("part").agg(
        F.sum("n").alias("b"), F.count("*").alias("k")
    ).collect()
    assert all(p["b"] <= 100 or p["k"] == 1 for p in parts)
    assert sum(p["k"] for p in parts) == 500


def test_slicing_of_single_row_parts_finds_every_part(spark):
    df = spark.range(5000).select(F.lit("s").alias("source"), F.col("id").alias("ord"))
    got = slicing.slice_by_size(df, F.lit(20), 12, block_rows=4096)
    assert got.where("part = ord + 1").count() == 5000


def test_slicing_when_joins_are_broadcast_while_they_run(spark):
    """Many input tasks, and joins that are planned with a shuffle and found to be small: no run of rows comes in pieces."""
    df = spark.range(0, 3_000, 1, 11).select(
        F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.col("id").alias("ord"), (F.xxhash64("id") % 9 + 9).alias("n")
    )
    before = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "32k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    try:
        for key, value in before.items():
            spark.conf.set(key, value)
        got = slicing.slice_by_size(df, F.col("n"), 40, block_rows=200).orderBy("ord").collect()
    finally:
        for key in before:
            spark.conf.unset(key)
    assert [r["ord"] for r in got] == list(range(3_000))
    for i in range(5):
        rows = got[i::5]
        assert [r["part"] for r in rows] == greedy([r["n"] for r in rows], 40)


def order_of(key, seed=42):
    return md5(f"{seed}:{key}".encode()).hexdigest()


def test_sample_n_skips_small_groups(spark):
    df = spark.range(300).select(F.when(F.col("id") < 280, "big").otherwise("small").alias("source"), "id")
    got = sampling.sample_n(df, "id", 30).collect()
    assert sorted(r["id"] for r in got) == sorted(sorted(range(280), key=order_of)[:30])


def test_samples_of_many_salts(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SALTS", 3)
    df = spark.range(300).select(F.lit("s").alias("source"), "id")
    got = sampling.sample_n(df, "id", 40).collect()
    assert sorted(r["id"] for r in got) == sorted(sorted(range(300), key=order_of)[:40])


def quota_reference(groups, quotas, default, total):
    picked, pools = [], []
    for name in sorted(groups):
        keys = sorted(groups[name], key=order_of)
        n = quotas.get(name, default)
        picked += keys[:n]
        pools += keys[n:]
    return (picked + pools)[:total]


@pytest.mark.parametrize("total", [10, 40, 60, 500])
def test_quota_sample(spark, total):
    groups = {"a": range(0, 5), "b": range(5, 60), "c": range(60, 80)}
    rows = [(name, k) for name, keys in groups.items() for k in keys]
    df = spark.createDataFrame(rows, "source string, id long").repartition(3)
    got = sampling.quota_sample(df, "id", {"a": 15, "b": 15}, 14, total)
    assert [r["id"] for r in got.collect()] == quota_reference(groups, {"a": 15, "b": 15}, 14, total)


def test_samples_shuffle_in_proportion_to_groups(spark):
    """Ten rows of each task and group are shuffled, then ten of each salt and group; never the groups."""
    df = spark.range(0, 30_000, 1, 6).select("id", (F.col("id") % 3).cast("string").alias("source"))
    picked = sampling.smallest_per_group(df, "source", [F.md5(F.col("id").cast("string")), F.col("id")], 10)
    sc = spark.sparkContext
    sc.setJobGroup("samples", "samples")
    try:
        got = picked.collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("samples") for s in tracker.getJobInfo(job).stageIds}
    shuffled = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s))
    assert len(got) == 30 and 0 < shuffled <= 2 * 6 * 3 * 10
    want = sorted(range(30_000), key=lambda i: md5(str(i).encode()).hexdigest())
    for name in "012":
        assert [r["id"] for r in sorted(got, key=lambda r: r["_rank"]) if r["source"] == name] == [i for i in want if i % 3 == int(name)][:10]


def test_sampling_trims_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("source"), "id")
    plan = sampling.sample_n(df, "id", 50)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("block_rows", [3, 100, 65_536])
def test_next_value_over_gaps(spark, block_rows):
    draw = np.random.default_rng(2)
    values = sorted({int(x) for x in draw.integers(-5_000, 5_000, 300)} | {10**15})
    frame = spark.createDataFrame([(x,) for x in draw.permutation(values).tolist()], "k bigint")
    got = {r["k"]: r["next"] for r in ordering.next_value(frame, "k", block_rows=block_rows).collect()}
    assert got == dict(zip(values, values[1:] + values[:1]))
    one = spark.createDataFrame([(7,)], "k bigint")
    assert [tuple(r) for r in ordering.next_value(one, "k").collect()] == [(7, 7)]
    assert ordering.next_value(one.limit(0), "k").count() == 0


@pytest.mark.parametrize("blocks", [2, 16, 1024])
def test_numbered_texts(spark, blocks):
    """Texts that share a long beginning, and few of them."""
    texts = [f"{'id ' * 20}{i:05d}" for i in range(700)] + ["a", "zz", ""]
    frame = spark.createDataFrame([(t,) for t in reversed(texts)], "error string")
    got = {r["error"]: r["number"] for r in ordering.numbered(frame, "error", blocks=blocks).collect()}
    assert got == {t: i for i, t in enumerate(sorted(texts), 1)}
    assert ordering.numbered(frame.limit(0), "error", blocks=blocks).count() == 0


@pytest.mark.parametrize("blocks", [1, 3, 64, 1024])
def test_with_next_over_gaps(spark, blocks):
    rng = random.Random(blocks)
    keys = sorted(rng.sample(range(-500, 500), 90) + [rng.randrange(1 << 62) for _ in range(40)])
    frame = spark.createDataFrame([(k, f"t{k}") for k in keys] + [(None, "none")], "k bigint, text string").repartition(7)
    got = {r["k"]: (r["text"], r["next_text"]) for r in ordering.with_next(frame, "k", ["text"], blocks).collect()}
    assert got == {k: (f"t{k}", f"t{n}") for k, n in zip(keys, keys[1:] + keys[:1])}
    one = frame.where(F.col("k") == keys[0])
    assert [tuple(r) for r in ordering.with_next(one, "k", ["text"], blocks).collect()] == [(keys[0], f"t{keys[0]}", f"t{keys[0]}")]
    assert ordering.with_next(frame.limit(0), "k", ["text"], blocks).count() == 0
