"""Whitening against plain numpy, and odd vectors."""

import math

import numpy as np
import pytest

from scoreloom.llm import queries, whitening

from .conftest import SMALL


def plain(vectors, weights="one", components=4):
    x = np.floor(256 * np.array(vectors, np.float64)).astype(np.int64)
    distinct, counts = np.unique(x, axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(distinct), np.int64)
    n, s = int(w.sum()), w @ distinct
    centred = distinct - s / n
    cov = (centred * w[:, None]).T @ centred / n
    values, vec = np.linalg.eigh(cov)
    values, vec = values[::-1][:components], vec[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vec / np.sqrt(values), values / np.trace(cov)


def test_query_against_numpy(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    n, deviation, white, explained = plain(list(rows.values()))
    place = {v: i for i, v in enumerate(rows)}
    got = queries.op13_whitening(spark, SMALL).collect()
    assert len(got) == 4 * len(rows)
    for k in range(1, 5):
        own = [r for r in got if r["component"] == k]
        sign = np.sign(sum(r["whitened"] * white[place[r["vec_id"]], k - 1] for r in own))
        for r in own:
            i = place[r["vec_id"]]
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert math.isclose(r["whitened"], sign * white[i, k - 1], abs_tol=1e-9) and math.isclose(r["explained"], explained[k - 1], rel_tol=1e-9)
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1


@pytest.mark.parametrize("weights", ["one", "count"])
def test_repeats_and_weights(spark, weights):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 5)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 30
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id int, v array<float>, n int, x string").repartition(4)
    got = whitening.whiten(df, "v", weights)
    assert got.columns[:4] == ["vec_id", "v", "n_", "x_"]
    n, deviation, white, _ = plain(vectors, weights)
    rows = got.collect()
    assert len(rows) == 4 * 70 and {r["n"] for r in rows} == {n} and n == (40 if weights == "one" else 70)
    for k in range(1, 5):
        own = {r["vec_id"]: r for r in rows if r["component"] == k}
        ours = np.array([own[i]["whitened"] for i in range(70)])
        assert np.allclose(np.abs(ours), np.abs(white[:, k - 1]), atol=1e-9) and [own[i]["deviation"] for i in range(70)] == deviation.tolist()
    assert max(r["identity_error"] for r in rows) < 1e-9


def test_odd_vectors(spark):
    good = [[0.5, -0.25], [1.0, 0.125], [-0.0, 2.0]]
    bad = [None, [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, float("-inf")], []]
    rows = list(enumerate(good)) + [(10 + i, v) for i, v in enumerate(bad)] + [(20, [1.0] * 3), (21, [1.0] * 3), (None, [0.5, -0.25])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect()
    # Three equal vectors of length 3 have no variance, the empty vector no component: both have no rows.
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"]) for r in got) == [(i, k) for i in (-1, 0, 1, 2) for k in (1, 2)]
    n, _, white, _ = plain(good)
    assert {r["n"] for r in got} == {n} == {3}
    assert np.allclose(np.abs([r["whitened"] for r in sorted((x for x in got if x["component"] == 1 and x["vec_id"] is not None), key=lambda r: r["vec_id"])]), np.abs(white[:, 0]))
    assert whitening.whiten(spark.createDataFrame([], "vec_id int, embedding array<float>")).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id int, embedding array<float>")).collect() == []


def test_too_large_values_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e12, 0.0]), (2, [0.0, 1e12])], "vec_id int, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(df).collect()
