"""Operators without a SQL check, against straightforward Python on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions.hashing import hash_unit, stable_hash
from scoreloom.operators import corpus as cp
from scoreloom.operators import automaton as au
from scoreloom.operators import joins as jn
from scoreloom.operators import metrics as mt
from scoreloom.operators import packing as pk
from scoreloom.operators import sampling as sm
from scoreloom.operators import views as vw


def _iou(a, b):
    inter = va = vb = 1.0
    for i in range(3):
        low, high = max(a[i] - a[i + 3] / 2, b[i] - b[i + 3] / 2), min(a[i] + a[i + 3] / 2, b[i] + b[i + 3] / 2)
        inter *= max(high - low, 0.0)
        va *= a[i + 3]
        vb *= b[i + 3]
    return inter / (va + vb - inter)


def test_box_matching_equals_greedy(spark):
    rng = random.Random(11)
    box = lambda: [rng.uniform(0, 6), rng.uniform(0, 2), 0.0, rng.uniform(0.5, 4), rng.uniform(1, 3), 2.0]
    pred = [(img, lab, i, box()) for img in range(4) for lab in "ab" for i in range(25)]
    gold = [(img, lab, i, box()) for img in range(4) for lab in "ab" for i in range(20)]
    ddl = "image int, label string, pos int, bbox array<double>"
    got = {(r["image"], r["label"], r["p"]): r["g"] for r in jn.match_boxes(spark.createDataFrame(pred, ddl), spark.createDataFrame(gold, ddl)).collect()}
    want = {}
    for img in range(4):
        for lab in "ab":
            used = set()
            golds = [g for g in gold if g[:2] == (img, lab)]
            for p in (p for p in pred if p[:2] == (img, lab)):
                best, hit = 0.0, None
                for g in golds:
                    v = _iou(p[3], g[3])
                    if g[2] not in used and v > best:
                        best, hit = v, g[2]
                if best > 0.25:
                    used.add(hit)
                    want[(img, lab, p[2])] = hit
    assert got == want and len(want) > 20


def test_match_counts(spark):
    ddl = "image int, label string, pos int, bbox array<double>"
    one = [0.0, 0.0, 0.0, 1.0, 1.0, 1.0]
    pred = spark.createDataFrame([(1, "a", 0, one), (1, "a", 1, one), (2, "b", 0, one)], ddl)
    gold = spark.createDataFrame([(1, "a", 0, one), (3, "a", 0, one)], ddl)
    rows = {(r["image"], r["label"]): (r["tp"], r["fp"], r["fn"]) for r in jn.match_counts(jn.match_boxes(pred, gold), pred, gold).collect()}
    assert rows == {(1, "a"): (1, 1, 0), (2, "b"): (0, 1, 0), (3, "a"): (0, 0, 1)}


def test_farthest_extras(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        n = rng.randrange(3, 20)
        keys = sorted(rng.sample(range(n), rng.randrange(1, 3)))
        rows.append((i, keys, [v for v in range(n) if v not in keys], rng.randrange(0, 6)))
    df = spark.createDataFrame(rows, "id int, req array<int>, pool array<int>, k int")
    got = {r["id"]: list(r["e"]) for r in df.select("id", vw.farthest_extras(F.col("req"), F.col("pool"), F.col("k")).alias("e")).collect()}
    for i, keys, pool, k in rows:
        chosen, left, extras = list(keys), list(pool), []
        while len(extras) < k and left:
            best = None
            for v in left:
                d = min(abs(v - c) for c in chosen)
                if best is None or d > best[0]:
                    best = (d, v)
            extras.append(best[1])
            chosen.append(best[1])
            left.remove(best[1])
        assert got[i] == extras


@pytest.mark.parametrize("cap,block", [(7, 10), (3, 50), (20, 7)])
def test_budget_chunks(spark, cap, block):
    rng = random.Random(cap)
    costs = [rng.choice([0, 1, 2, 5, 9]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(costs)), "pos long, n_images long")
    got = {r["pos"]: r["chunk"] for r in pk.budget_chunks(df, cap, block=block).collect()}
    chunk, load, size = 0, 0, 0
    for i, c in enumerate(costs):
        if size and load + c > cap:
            chunk, load, size = chunk + 1, 0, 0
        load, size = load + c, size + 1
        assert got[i] == chunk


def test_weighted_draws_fall_into_their_intervals(spark):
    rng = random.Random(4)
    weights = [rng.choice([1e-8, 1e-8, 0.1, 3.0, 40.0]) for _ in range(400)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "pos long, weight double")
    rows = sm.resample_weighted(df, "pos").collect()
    assert sorted(r["draw"] for r in rows) == list(range(400))
    units = {r["pos"]: r["u"] for r in df.select("pos", hash_unit(stable_hash("pos")).alias("u")).collect()}
    edges = np.cumsum(weights)
    for r in rows:
        assert r["pos"] == int(np.searchsorted(edges, units[r["draw"]] * edges[-1], side="right"))


def test_bootstrap_best_approaches_exact(spark):
    rows = [(f"s{u % 2}", u, i, float((u * 7 + i * 13) % 10)) for u in range(6) for i in range(8)]
    df = spark.createDataFrame([(s, u, n, v) for n, (s, u, _, v) in enumerate(rows)], "data_source string, uid int, pos long, score double")
    exact = {r["data_source"]: r for r in mt.best_at_n(df).filter("n = 4").collect()}
    drawn = {r["data_source"]: r for r in mt.bootstrap_best(df, 4, draws=2000).collect()}
    for s, e in exact.items():
        assert drawn[s]["best_mean"] == pytest.approx(e["best_mean"], abs=0.15)
        assert drawn[s]["worst_mean"] == pytest.approx(e["worst_mean"], abs=0.15)
        assert drawn[s]["best_std"] == pytest.approx(e["best_std"], abs=0.15)


def test_bootstrap_stderr_near_formula(spark):
    df = spark.range(4000).select(F.col("id"), (F.col("id") * 37 % 101).cast("double").alias("x"))
    boot = cp.bootstrap_stderr(df, "id", lambda w: F.sum(F.col("x") * w) / F.sum(w), replicates=200).first()["stderr"]
    plain = cp.stderr(df, "x").first()["stderr"]
    assert boot == pytest.approx(plain, rel=0.2)


def test_rouge_l(spark):
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(9)
    text = lambda: " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12)))
    rows = [(i, text(), [text(), text()]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, h string, r array<string>")
    got = {r["id"]: r["s"] for r in df.select("id", cp.rouge_l(F.col("h"), F.col("r")).alias("s")).collect()}
    for i, h, refs in rows:
        c = h.split(" ")
        p = max(lcs(r.split(" "), c) / len(c) for r in refs)
        q = max(lcs(r.split(" "), c) / len(r.split(" ")) for r in refs)
        assert got[i] == pytest.approx(2.44 * p * q / (q + 1.44 * p) if p and q else 0.0)


def test_composition_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.dirichlet([2, 3, 4], size=80)
    y = x @ np.array([1.0, -2.0, 0.5]) + rng.normal(0, 0.01, 80)
    rows = [(i, float(y[i]), [("a", float(x[i, 0])), ("b", float(x[i, 1])), ("c", float(x[i, 2]))]) for i in range(80)]
    df = spark.createDataFrame(rows, "step long, detrended double, shares array<struct<key:string,x:double>>")
    got = {r["key"]: r for r in cp.composition_regression(df, replicates=30).collect()}
    centred = x - x.mean(axis=0)
    coef, *_ = np.linalg.lstsq(centred, y, rcond=None)
    resid = y - centred @ coef
    for i, k in enumerate("abc"):
        assert got[k]["slope"] == pytest.approx(coef[i], abs=1e-6)
        assert got[k]["mean_share"] == pytest.approx(x[:, i].mean())
        assert got[k]["low"] < got[k]["high"]
    assert got["a"]["r2"] == pytest.approx(1 - resid.var() / y.var(), abs=1e-6)


def test_audit_sample_and_random_fewshot(spark):
    ids = spark.range(20000)
    assert 250 < sm.audit_sample(ids, 0.02, "id").count() < 550
    docs = spark.range(50).select(F.col("id").alias("doc_id"))
    pool = docs.select(F.col("doc_id").alias("pool_id"), F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">")).alias("example"))
    rows = vw.fewshot(docs, pool, 3, how="random", sep=" ").collect()
    for r in rows:
        shown = r["context"].split(" ")
        assert len(shown) == len(set(shown)) == 3 and f"<{r['doc_id']}>" not in shown
    fixed = vw.fewshot(docs, pool, 2, how="index", indices=[4, 7], sep=" ").filter("doc_id = 1").first()["context"]
    assert fixed == "<4> <7>"


def test_contained_passages(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "pi"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    passages = []
    for j in range(30):
        text = docs[rng.randrange(40)][1]
        at = rng.randrange(0, len(text) - 60)
        passages.append((j, text[at : at + rng.choice([8, 11, 20, 45, 60])]))
    d, p = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(passages, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in au.contained_passages(d, p, "doc_id", "item_id").collect()}
    assert got == {(i, j) for i, t in docs for j, s in passages if s in t}
