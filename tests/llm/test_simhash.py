import re

import numpy as np
import pytest
import xxhash

from scoreloom.llm import simhash


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_documents_against_brute_force(docs, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(simhash.F.col("fingerprint")).alias("h"), "component_id").collect()
    assert {r["doc_id"]: r["h"] for r in found} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in found} == plain_components(prints)


@pytest.mark.parametrize("pieces,tile", [(5, 2048), (6, 7), (8, 3)])
def test_links_of_crowded_fingerprints(spark, pieces, tile):
    """Chains and crowds of near fingerprints, with blocks cut into many tiles."""
    rng = np.random.default_rng(1)
    values = set()
    for _ in range(6):
        v = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            values.add(v)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(b)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.fingerprint_links(classes, "fp", 4, pieces, tile)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    plain = plain_components({v: v & (1 << 64) - 1 for v in signed})
    groups = {}
    for v, r in plain.items():
        groups.setdefault(r, set()).add(v)
    got = {}
    for v in signed:
        got.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_bit_sliced_distances():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    values = np.array([base[0] ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 9, 300)], np.uint64)
    for radius in (0, 1, 3, 4, 7):
        q, v = simhash.within_radius(values[:50], values, radius)
        want = {(i, j) for i in range(50) for j in range(300) if int(values[i] ^ values[j]).bit_count() <= radius}
        assert set(zip(q.tolist(), v.tolist(), strict=True)) == want


def test_odd_rows(odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    # Null, empty and white texts have fingerprint zero and are one component, also the row without an id.
    assert {r["component_id"] for i in (2, 3, 4) for r in by_id[i]} == {2}
    assert sorted((r["fingerprint"] == 0, r["component_id"] == 2) for r in by_id[None]) == [(False, False), (True, True)]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:7]) for r in kept.collect()) == [
        (0, "a row w"), (1, "another"), (1, "the cat"), (2, ""), (5, "lorem i"), (6, "12345 6"), (7, "Ünïcödé"),
    ]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
