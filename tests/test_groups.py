"""Group helpers: hot keys, ranks and order statistics against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import groups as gr
from scoreloom.operators import sampling as sm
from scoreloom.operators.advantage import adv_grpo


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    # Key 0 holds half of all rows.
    rows = [(i, 0 if i % 2 else rng.randrange(1, 30), float(rng.randrange(0, 40)), rng.randrange(0, 6)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "pos long, uid long, score double, length long")


def test_hot_keys_are_split_without_changing_results(skewed):
    _, df = skewed
    plain = gr.with_group_stats(df, ["uid"], [F.avg("score").alias("m")])
    split = gr.with_group_stats(df, ["uid"], [F.avg("score").alias("m")], rows_per_task=50)
    a = {r["pos"]: round(r["m"], 9) for r in plain.collect()}
    b = {r["pos"]: round(r["m"], 9) for r in split.collect()}
    assert len(a) == 3000 and a == b


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, 5, 7.0)], "pos long, uid long, score double")
    got = {r["pos"]: r["m"] for r in gr.with_group_stats(df, ["uid"], [F.avg("score").alias("m")]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 7.0}


@pytest.mark.parametrize("buckets", [1, 2])
def test_ranked_matches_row_number(skewed, buckets):
    rows, df = skewed
    spec = {"b1": -F.col("length")} if buckets == 1 else {"b1": -F.col("length"), "b2": F.floor(F.col("pos") / 97)}
    got = {r["pos"]: r["rn"] for r in gr.ranked(df, ["uid"], [F.col("length").desc(), F.col("pos")], spec).collect()}
    want = {}
    for uid in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == uid), key=lambda r: (-r[3], r[0]))
        want.update({r[0]: i + 1 for i, r in enumerate(group)})
    assert got == want


def test_running_sum(skewed):
    rows, df = skewed
    got = {r["pos"]: r["run"] for r in gr.running_sum(df, [], [F.col("pos")], F.col("length"), {"b": F.floor(F.col("pos") / 100)}, "run").collect()}
    total, want = 0, {}
    for r in sorted(rows):
        total += r[3]
        want[r[0]] = total
    assert got == want


def test_order_statistics_and_percentiles(skewed):
    rows, df = skewed
    n = F.col("n")
    got = {r["uid"]: (r["mid"], r["hi"]) for r in gr.order_statistics(df, ["uid"], "score", {"mid": F.floor(n / 2), "hi": n - 1}).collect()}
    for uid, (mid, hi) in got.items():
        values = sorted(r[2] for r in rows if r[1] == uid)
        assert (mid, hi) == (values[len(values) // 2], values[-1])
    p = gr.linear_percentiles(df, [], "score", {"q": 0.3}).first()["q"]
    values = sorted(r[2] for r in rows)
    at = 0.3 * (len(values) - 1)
    low = int(at)
    assert p == pytest.approx(values[low] + (values[low + 1] - values[low]) * (at - low))


def test_keep_first_is_exact(skewed):
    rows, df = skewed
    out = sm.draw_exact(df, 0.37, "pos", ["uid"], seed=5)
    sizes = {r["uid"]: r["count"] for r in out.groupBy("uid").count().collect()}
    for uid in {r[1] for r in rows}:
        total = sum(r[1] == uid for r in rows)
        assert sizes.get(uid, 0) == int(total * 0.37)


def test_same_result_on_other_partitionings(skewed):
    _, df = skewed
    results = []
    for parts in (1, 7):
        out = adv_grpo(df.repartition(parts))
        results.append(sorted((r["pos"], round(r["advantage"], 9)) for r in out.collect()))
    assert results[0] == results[1]


def test_draw_does_not_depend_on_partitions(skewed):
    _, df = skewed
    picks = [sorted(r["pos"] for r in sm.draw_exact(df.repartition(p), 0.2, "pos").collect()) for p in (1, 5)]
    assert picks[0] == picks[1]
