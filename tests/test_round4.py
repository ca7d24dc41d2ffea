"""Draws that are not broadcast, row numbers through several files, and other faults of the third review."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scoreloom.functions.hashing import hash_unit, poisson_count, stable_hash
from scoreloom.operators import corpus as cp
from scoreloom.operators import intervals as iv
from scoreloom.operators import metrics as mt
from scoreloom.sources import tables


def test_draws_are_not_broadcast(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("uid"), F.lit("s").alias("data_source"), "id")
    drawn = mt.bootstrap_draws(df, ["data_source", "uid"], "id", F.lit(4), draws=50)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan.split("Generate")[0] and "BroadcastHashJoin" not in plan.split("Generate")[0]
    assert drawn.count() == 20 * 50 * 4


def test_row_numbers_run_through_all_files_of_a_path(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(0, 100, 1, 4).write.parquet(path)
    got = tables.read_tables(spark, [path, path])
    assert got.columns == ["id", "row_no", "source_no"]
    rows = got.collect()
    assert sorted(r["row_no"] for r in rows) == sorted([*range(100)] * 2)
    assert all(r["row_no"] == r["id"] for r in rows)


def test_counts_of_a_bootstrap_are_those_of_the_hashes(spark):
    df = spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    own = F.array(*[poisson_count(hash_unit(stable_hash("id", F.lit(r), seed=3))) for r in range(1, 6)])
    rows = df.select(cp._poisson_draws(5, 3)(F.col("id").cast("string")).alias("a"), own.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and max(max(r["a"]) for r in rows) > 3
    boot = cp.bootstrap_stderr(df, "id", lambda w: F.sum(w), replicates=5, seed=3)
    # No draw may be hashed again for each comparison of the distribution.
    assert boot._jdf.queryExecution().optimizedPlan().toString().count("md5") <= 1


def test_intervals_are_filed_under_few_nodes(spark):
    points = spark.range(1000).withColumnRenamed("id", "at")
    spans = spark.range(1000).select(F.col("id").alias("span_id"), F.col("id").alias("start"), (F.col("id") + 700).alias("end"))
    got = iv.interval_join(points, spans, [], "at", "start", "end")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "ExistenceJoin" not in plan
    assert got.count() == sum(min(i + 700, 999) - i + 1 for i in range(1000))
    nodes = spark.range(1, 5000).select(iv.level_of(F.col("id")).alias("v"), F.col("id").alias("n"))
    assert all((1 << 2 * r["v"]) <= r["n"] < (4 << 2 * r["v"]) for r in nodes.collect())


@pytest.mark.parametrize("characters", [True, False])
def test_matches_of_many_rows_at_once(characters):
    rng = random.Random(2)
    text = lambda: "".join(rng.choice(["a", "b", " ", "\n", "\u00e9", "\U0001f600", chr(rng.randint(97, 60000) % 55000 + 97)]) for _ in range(rng.randint(0, 60)))
    hyps = [rng.choice([None, "", text()]) for _ in range(300)]
    refs = [[rng.choice([None, h, text(), (h or "")[3:]]) for _ in range(rng.randint(0, 3))] for h in hyps]
    got = cp.match_numbers(hyps, refs, 6, characters)
    split = lambda x: list("".join((x or "").split())) if characters else (x or "").split()
    for h, rs, row in zip(hyps, refs, got.tolist()):
        for k in range(1, 7):
            grams = lambda x, k=k: Counter(tuple(split(x)[i : i + k]) for i in range(len(split(x)) - k + 1))
            own, caps = grams(h), [grams(r) for r in rs]
            assert row[3 * k - 3] == sum(own.values()) and row[3 * k - 2] == sum(sum(c.values()) for c in caps)
            assert row[3 * k - 1] == sum(min(n, max((c[g] for c in caps), default=0)) for g, n in own.items())


def test_document_frequency_in_bounded_tasks_counts_an_id_once(spark, monkeypatch):
    monkeypatch.setattr(cp, "TASK_CHARS", 40)
    monkeypatch.setattr(cp, "TALLY", 3)
    rows = [(1, "a b c", ["a b", "b c"]), (2, "a b", ["a b a b", ""]), (1, "x", ["b c", None]), (3, "q " * 60, ["a"])]
    df = spark.createDataFrame(rows, "id long, hyp string, ref_list array<string>").repartition(3)
    assert cp._by_id(df, "id", "hyp", "ref_list")[1] > 4 or spark.conf.get("spark.sql.shuffle.partitions") == "4"
    got = {(r["k"], r["gram"]): r["df"] for r in cp.document_frequency(df, "id", 2).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 2, (1, "c"): 1, (2, "a b"): 2, (2, "b c"): 1, (2, "b a"): 1}
    plan = cp.document_frequency(df, "id", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 0
    assert sorted(r["id"] for r in cp.cider(df, "id").collect()) == [1, 2, 3]


def test_boxes_of_small_groups_are_not_repeated_for_cells(spark):
    from scoreloom.operators import joins as jn

    boxes = spark.range(40).select(
        (F.col("id") % 4).alias("image"), F.col("id").alias("pos"), F.array(F.col("id").cast("double"), *[F.lit(1.0)] * 5).alias("bbox"),
    )
    edges = jn.box_edges(boxes, boxes, ["image"])
    assert "Generate" not in edges._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert sorted((r["p"], r["g"]) for r in edges.collect()) == [(i, i) for i in range(40)]
