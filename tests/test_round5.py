"""Regression queries that failed for a lost import, and other faults of the fourth review."""

import builtins
import glob
import math
import os
import random
import symtable
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import corpus as cp
from scoreloom.plans import load_catalog
from scoreloom.plans.corpus_queries import _steps

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
PACKAGE = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scoreloom")


def test_every_global_name_is_defined():
    missing = []

    def walk(table, known):
        for s in table.get_symbols():
            if s.is_global() and s.is_referenced() and s.get_name() not in known and not s.get_name().startswith("__"):
                missing.append((table.get_name(), s.get_name()))
        for below in table.get_children():
            walk(below, known)

    for path in glob.glob(f"{PACKAGE}/**/*.py", recursive=True):
        with open(path) as f:
            top = symtable.symtable(f.read(), path, "exec")
        made = {s.get_name() for s in top.get_symbols() if s.is_assigned() or s.is_imported() or s.is_namespace()}
        walk(top, made | set(dir(builtins)))
    assert not missing


def test_composition_regression_query_is_least_squares(spark):
    rows = _steps(spark, SF_DIR).collect()
    keys = sorted({e["key"] for r in rows for e in r["shares"]})
    x = np.array([[dict((e["key"], e["x"]) for e in r["shares"]).get(k, 0.0) for k in keys] for r in rows])
    y = np.array([r["detrended"] for r in rows])
    c = x - x.mean(axis=0)
    # A cut of 1e-10 on the normal equations is one of 1e-5 on the shares themselves.
    coef, *_ = np.linalg.lstsq(c, y, rcond=1e-5)
    got = {r["key"]: r for r in load_catalog()["g32_composition_regression"].build(spark, SF_DIR).collect()}
    assert sorted(got) == keys
    for k, slope, mean in zip(keys, coef, x.mean(axis=0), strict=True):
        assert got[k]["slope"] == pytest.approx(slope, abs=1e-5)
        assert got[k]["mean_share"] == pytest.approx(mean, abs=1e-6)
        assert got[k]["r2"] == pytest.approx(1 - (y - c @ coef).var() / y.var(), abs=1e-5)


def test_two_share_regression_query_has_opposite_slopes(spark):
    got = {r["key"]: r for r in load_catalog()["g32_two_share_regression"].build(spark, SF_DIR).collect()}
    y = [(r["detrended"], max(e["x"] for e in r["shares"])) for r in _steps(spark, SF_DIR).collect()]
    t, x = (np.array(v) for v in zip(*y, strict=True))
    slope = np.polyfit(x, t, 1)[0]
    assert sorted(got) == ["largest", "rest"]
    assert got["largest"]["slope"] == pytest.approx(slope / 2, abs=1e-5) and got["rest"]["slope"] == pytest.approx(-slope / 2, abs=1e-5)
    assert got["largest"]["r2"] == got["rest"]["r2"] == pytest.approx(np.corrcoef(x, t)[0, 1] ** 2, abs=1e-5)
    assert got["largest"]["mean_share"] == pytest.approx(x.mean(), abs=1e-6)


def _cider_by_hand(rows, n=4, sigma=6.0):
    """CIDEr of rows (id, prediction, references) in plain Python, rows of one id added up text by text."""
    texts = {}
    for i, h, rs in rows:
        own = texts.setdefault(i, [])
        for side, t in enumerate([h, *(rs or [])]):
            if len(own) <= side:
                own.append(Counter())
            words = (t or "").split()
            own[side].update(tuple(words[a : a + k]) for k in range(1, n + 1) for a in range(len(words) - k + 1))
    df = Counter(g for own in texts.values() for g in set().union(*own[1:]))
    out = {}
    for i, own in texts.items():
        times, nr = sum(r[0] == i for r in rows), len(own) - 1
        vec = [{g: c * (math.log(len(rows)) - math.log(max(df[g], 1))) for g, c in t.items()} for t in own]
        size = [sum(c for g, c in t.items() if len(g) == 2) for t in own]
        total = 0.0
        for p in range(1, nr + 1):
            for k in range(1, n + 1):
                h, r = ({g: w for g, w in vec[q].items() if len(g) == k} for q in (0, p))
                dot = sum(min(w, r[g]) * r[g] for g, w in h.items() if g in r)
                norm = math.sqrt(sum(w * w for w in h.values())) * math.sqrt(sum(w * w for w in r.values()))
                total += (dot / norm if norm else dot) * math.exp(-((size[0] - size[p]) ** 2) / (2 * sigma**2))
        out[i] = None if not nr else 0.0 if i is None else total * times / n / nr * 10
    return out


def test_cider_by_parts_is_that_of_plain_python(spark, monkeypatch):
    monkeypatch.setattr(cp, "PART_CHARS", 64)
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " ".join(rng.choice(["a", "b", "cé", "dd", "\U0001f600"]) for _ in range(rng.randint(1, 14)))])
    rows = [(rng.choice([None, *range(40)]), text(), [text(), text()]) for _ in range(80)] + [(99, "a b", []), (98, "a b", None), (97, "a b", ["a b", "x"])]
    df = spark.createDataFrame(rows, "id long, hyp string, ref_list array<string>").repartition(3)
    got = {r["id"]: r["cider"] for r in cp.cider(df, "id").collect()}
    want = _cider_by_hand(rows)
    assert set(got) == set(want) and got[99] is None and got[98] is None and got[97] > 0
    assert all(got[i] == (want[i] if want[i] is None else pytest.approx(want[i], abs=1e-9)) for i in want)
    names = cp.cider(df.withColumnRenamed("id", "part").withColumn("part", F.col("part").cast("string")), "part").collect()
    assert {r["part"]: r["cider"] for r in names} == {None if i is None else str(i): v for i, v in got.items()}
    assert cp.cider(df.filter("false"), "id").collect() == []


def test_cider_sends_no_row_per_id_and_gram(spark):
    words = " ".join(f"w{i}" for i in range(300))
    df = spark.range(400).select("id", F.lit(words).alias("hyp"), F.array(F.lit(words), F.lit(words)).alias("ref_list"))
    plan = cp.cider(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    table = pa.table({"part": pa.array([3] * 400, pa.int32()), "id": list(range(400)), "texts": [[words.split()] * 3] * 400})
    sent = cp._part_grams(table, 4, 8)
    # Each of the 1,194 n-grams once for all ids and texts.
    assert sum(len(x) for x in sent["df"].to_pylist()) == 300 + 299 + 298 + 297
    assert {y for x in sent["df"].to_pylist() for y in x} == {400}
