"""Interval join, split join and passage scan against plain loops, with hot keys on both sides."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import automaton as au
from scoreloom.operators import intervals as iv


def pairs(spark, points, spans, kind, **how):
    p = spark.createDataFrame(points, f"key string, point_id int, at {kind}").repartition(3)
    s = spark.createDataFrame(spans, f"key string, span_id int, start {kind}, end {kind}, level string").repartition(2)
    got = iv.interval_join(p, s, ["key"], "at", "start", "end", **how)
    assert got.columns == ["key", "point_id", "at", "span_id", "start", "end", "level"]
    return sorted((r["point_id"], r["span_id"]) for r in got.collect())


def plain(points, spans):
    return sorted((i, j) for k, i, at in points for m, j, s, e, _ in spans if k is not None and k == m and None not in (at, s, e) and s <= at <= e)


@pytest.mark.parametrize("limit", [10**6, 5])
def test_whole_numbers_of_all_lengths(spark, limit):
    rng = random.Random(4)
    for low, high in ((0, 40), (-(2**40), 2**40), (5, 5)):
        points = [(rng.choice(["a", "b", None]), i, rng.choice([None, low, high, rng.randint(low, high)])) for i in range(120)]
        spans = []
        for i in range(60):
            s = rng.randint(low, high)
            spans.append((rng.choice(["a", "b", "c", None]), i, s, min(high, s + int((high - low) * rng.random() ** 6)), "x"))
        spans += [("a", 60, low, high, None), ("a", 61, high, low, None), ("a", 62, None, high, None), ("b", 63, low, None, None)]
        assert pairs(spark, points, spans, "long", rows_per_task=limit) == plain(points, spans)


def test_fractions_and_open_ends(spark):
    rng, inf = random.Random(7), float("inf")
    points = [("a", i, rng.choice([0.0, -0.0, 1e-300, rng.random(), rng.random() * 1e9, -inf, inf])) for i in range(150)]
    spans = [("a", i, s, s + rng.choice([0.0, 1e-12, 0.5, 1e8]), "x") for i, s in enumerate(p[2] for p in points[:60])]
    spans += [("a", 100, -inf, 0.5, "x"), ("a", 101, 3.0, inf, "x"), ("a", 102, -inf, inf, "x")]
    assert pairs(spark, points, spans, "double", rows_per_task=20) == plain(points, spans)


def test_times(spark):
    start = datetime.datetime(2024, 3, 1)
    points = [("a", i, start + datetime.timedelta(seconds=37 * i)) for i in range(400)]
    spans = [("a", i, t, t + datetime.timedelta(seconds=1 if i % 9 else 3600), "x") for i, t in enumerate(p[2] for p in points[::5])]
    spans.append(("a", 999, start, start + datetime.timedelta(days=1), "x"))
    want = plain(points, spans)
    assert pairs(spark, points, spans, "timestamp") == want and pairs(spark, points, spans, "timestamp_ntz") == want
    with pytest.raises(ValueError, match="different kinds"):
        iv.interval_join(spark.range(1), spark.sql("select timestamp'2024-01-01' as s, timestamp'2024-01-02' as e"), [], "id", "s", "e")


def test_nothing_and_no_key(spark):
    empty = spark.createDataFrame([], "span_id int, start long, end long")
    points = spark.range(5)
    assert iv.interval_join(points, empty, [], "id", "start", "end").collect() == []
    one = spark.createDataFrame([(1, 1, 3)], "span_id int, start long, end long")
    assert sorted(r["id"] for r in iv.interval_join(points, one, [], "id", "start", "end").collect()) == [1, 2, 3]
    assert iv.interval_join(points.limit(0), one, [], "id", "start", "end").collect() == []


def test_nodes_cover_exactly(spark):
    rows = [(a, b) for a in range(0, 40, 3) for b in range(a, 64, 5)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("nodes", iv.tree_nodes(F.col("a"), F.col("b"), 3))
    for r in df.collect():
        leaves = [x for n in r["nodes"] for x in range(n["node"] << 2 * n["level"], (n["node"] + 1) << 2 * n["level"])]
        assert sorted(leaves) == list(range(r["a"], r["b"] + 1)) and len(r["nodes"]) <= 18


def test_one_long_and_many_short_intervals_stay_in_bounds(spark):
    # A day-long interval over every second, and 20,000 intervals of a second: no node meets more than the limit.
    points = spark.range(86_400).withColumnRenamed("id", "at")
    spans = spark.range(20_000).select(F.col("id").alias("span_id"), F.col("id").alias("start"), (F.col("id") + 1).alias("end")).union(
        spark.createDataFrame([(-1, 0, 86_399)], "span_id long, start long, end long")
    )
    got = iv.interval_join(points, spans, [], "at", "start", "end", rows_per_task=1000)
    by_span = got.groupBy((F.col("span_id") < 0).alias("long")).count().collect()
    assert {r["long"]: r["count"] for r in by_span} == {True: 86_400, False: 40_000}


def test_hot_keys_of_both_sides_are_split(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 5), (None, 6), ("other", 7)], "k string, b int")
    for limit in (10**6, 40, 7):
        got = iv.join_split(left, right, ["k"], limit)
        assert got.columns == ["k", "a", "b"]
        rows = sorted(tuple(r) for r in got.collect())
        assert len(rows) == 60_001 == len(set(rows)) and ("cold", 1, 5) in rows


@pytest.mark.parametrize("shard_chars", [1 << 21, 40])
def test_passages_against_plain_search(spark, shard_chars):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \n", k=rng.randint(0, 200))) for _ in range(60)] + [None, "", "Ünï\U0001f600 end"]
    found = [t[i : i + rng.randint(1, 30)] for t in texts if t and len(t) > 40 for i in (3, 30)]
    passages = [*found, *found[:5], "", None, "x" * 100, "\U0001f600", "a", "aa"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)] + [(5, texts[5])], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, text string").repartition(2)
    got = {tuple(r) for r in au.contained_passages(docs, items, "doc_id", "item_id", shard_chars=shard_chars).collect()}
    assert got == {(i if i else None, k) for i, t in enumerate(texts) for k, p in enumerate(passages) if t and p and p in t}
    assert au.contained_passages(docs, items.limit(0), "doc_id", "item_id").collect() == []
    assert au.contained_passages(docs.limit(0), items, "doc_id", "item_id").collect() == []
