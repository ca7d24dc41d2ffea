import random

import corpus_pipeline

import numpy as np

from scoreloom.llm import jaccard, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


def edited(rng, words, edits):
    """``words`` with ``edits`` words replaced, far apart."""
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5, 12), edits):
        out[at] = f"edit{rng.randint(0, 10**9)}"
    return out


def planted(rng):
    """Groups of a text and copies with a few edited words on both sides of 0.8, chains, and a crowd of copies of one text."""
    bodies = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(250)]
        bodies.append(words)
        bodies += [edited(rng, words, k) for k in (1, 3, 5, 5, 6, 8)]
    words = [f"w{rng.randint(0, 5000)}" for _ in range(250)]
    bodies += [edited(rng, words, 4) for _ in range(120)]
    return [" ".join(w) for w in bodies] + ["", None, " \n", "one", "One", "two words"]


def test_stage_against_all_pairs(spark):
    rng = random.Random(3)
    texts = planted(rng)
    rng.shuffle(texts)
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert found == dict(enumerate(root))
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root))


def reach(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return [find(x) for x in range(n)]


def test_tiles_against_plain_sets():
    """Sets near the limit, hashes that few and that many of them have, one tile and two."""
    rng = np.random.default_rng(0)
    base, sets = rng.integers(-(2**60), 2**60, 200), []
    for _ in range(120):
        own, k = base.copy(), rng.integers(0, 60)
        own[rng.choice(200, k, replace=False)] = rng.integers(-(2**60), 2**60, k)
        sets.append(np.unique(own[: rng.integers(150, 201)]))
    sets += [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(50)]
    n = len(sets)
    common = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard.common_counts(sets)
    assert all(got[i, k] == common[i][k] for i in range(n) for k in range(n) if i != k)
    names, roots, sides = np.arange(n) * 10, np.arange(n) // 2, (np.arange(n) % 3 == 0).astype(int)
    for diagonal in (True, False):
        a, b = jaccard.tile_links(names, roots, sides, sets, diagonal, (4, 5))
        linked = [
            (i, k) for i in range(n) for k in range(i)
            if roots[i] != roots[k] and (diagonal or sides[i] != sides[k]) and common[i][k] * 9 >= (len(sets[i]) + len(sets[k])) * 4
        ]
        assert len(a) < n and reach(n, zip((a // 10).tolist(), (b // 10).tolist(), strict=True)) == reach(n, linked)


def test_every_pair_within_the_simhash_radius_is_compared(spark, monkeypatch):
    """The groups handed to the verification hold each two texts whose five-word SimHash differs in at most four bits, and MinHash bands beside them."""
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    texts = [" ".join(edited(rng, words, k)) for k in (0, 1, 1, 2, 2, 2, 6, 20)] + [" ".join(rng.sample(words, 300)), "one two", "", None]
    seen, real = [], jaccard.set_links
    monkeypatch.setattr(jaccard, "set_links", lambda members, *rest: seen.append(members) or real(members, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    jaccard.near_duplicates(docs).collect()
    groups = {}
    for r in seen[0].collect():
        groups.setdefault(r["fingerprint"], set()).add(r["key"])
    bits = [simhash.fingerprint(t, 5) & (2**64 - 1) for t in texts]
    names = [jaccard.set_hash(jaccard.shingle_set(t)) for t in texts]
    close = [(i, j) for i in range(9) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= simhash.RADIUS]
    assert len(close) >= 3
    prints = spark.createDataFrame([(n, 1, b - 2**64 if b >> 63 else b) for n, b in zip(names[:9], bits, strict=False)], "fingerprint long, n long, simhash long")
    keys = {r["fingerprint"]: r["key"] for r in jaccard.simhash_groups(prints).collect()}
    assert all(keys[names[i]] == keys[names[j]] and {keys[names[i]]} <= groups[names[i]] & groups[names[j]] for i, j in close)
    assert max(map(len, groups.values())) > 1


def test_tiles_of_one_large_component_and_a_rest(spark, monkeypatch):
    """One group over several tiles: a large component, and sets that reach it, each other or nothing."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    rng = np.random.default_rng(2)
    base, sets = rng.integers(-(2**60), 2**60, 200), []
    for k in [3] * 60 + [11] * 30 + [20] * 20 + [60] * 10:
        own = base.copy()
        own[rng.choice(200, k, replace=False)] = rng.integers(-(2**60), 2**60, k)
        sets.append(np.unique(own))
    n = len(sets)
    linked = [(i, k) for i in range(n) for k in range(i) if len(np.intersect1d(sets[i], sets[k])) * 9 >= (len(sets[i]) + len(sets[k])) * 4]
    members = spark.createDataFrame([(1, i, len(s)) for i, s in enumerate(sets)], "key long, fingerprint long, n long")
    runs = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "fingerprint long, runs array<long>")
    got = [(r["a"], r["b"]) for r in jaccard.set_links(members, runs).collect()]
    assert reach(n, got) == reach(n, linked)
