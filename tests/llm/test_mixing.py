import re

import numpy as np

from scoreloom.llm import mixing


def test_targets_are_capped_and_shared_again():
    sizes = {"a": 10, "b": 100, "c": 1000, None: 50}
    got = mixing.source_targets(sizes)
    # a: 5/13 of 1160 is far above 30; what is cut off goes to the others by weight.
    assert got["a"] == 30
    assert all(got[s] <= 3 * sizes[s] + 1e-9 for s in sizes)
    assert abs(sum(got.values()) - 1160) < 1e-6
    assert mixing.source_targets({}) == {} and mixing.source_targets({"z": 0}) == {"z": 0.0}


def test_pivotal_keeps_the_sum_and_the_expectation():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 200, 60)
    p = rng.random(60)
    total, mean, n = float((p * size).sum()), np.zeros(60), 4000
    for _ in range(n):
        out = np.array(mixing.pivotal(p, size, rng.random(60)))
        open_ = (out > 0) & (out < 1)
        assert open_.sum() <= 1 and abs((out * size).sum() - total) < 1e-6
        mean += out
    assert np.abs(mean / n - p).max() < 0.05


def test_documents(docs, texts):
    rows = mixing.copies(docs, bucket_rows=16, fan_in=3).collect()
    assert len(rows) == len(texts)
    again = {r["doc_id"]: r["copies"] for r in mixing.copies(docs.repartition(7), bucket_rows=16, fan_in=3).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    by_source = {}
    for r in rows:
        assert r["size"] == len(re.findall(mixing.WORD, texts[r["doc_id"]]))
        assert 0 <= r["copies"] <= 3
        by_source.setdefault(r["source"], []).append(r)
    targets = mixing.source_targets({s: sum(r["size"] for r in own) for s, own in by_source.items()})
    for s, own in by_source.items():
        assert own[0]["target"] == targets[s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - targets[s]) <= max(r["size"] for r in own)


def test_odd_rows(odd, nothing):
    rows = mixing.copies(odd).collect()
    assert len(rows) == 11
    assert all(r["copies"] == 0 for r in rows if r["size"] == 0)
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r["copies"] for r in rows)
    assert mixing.copies(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
