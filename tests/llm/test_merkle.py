"""Merkle manifest against plain hashing, and its folding on single blocks."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import merkle, sha256


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return levels


def plain_path(levels, at, h, fanout):
    proof = []
    for nodes in levels[:-1]:
        lo = at - at % fanout
        left, right = nodes[lo:at], nodes[at + 1 : lo + fanout]
        proof += left + right
        h, at = H(*left, h, *right), at // fanout
    return proof, h


def plain_manifest(rows, fanout):
    """``rows`` of (source, id, leaf, changed leaf or None)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[s] = plain_levels([r[2] for r in groups[s]], fanout)
    top = plain_levels([trees[s][-1][0] for s in names], fanout) if names else []
    out = []
    for k, s in enumerate(names):
        for i, (_, doc, leaf, changed) in enumerate(groups[s]):
            proof, h = plain_path(trees[s], i, changed or leaf, fanout)
            more, h = plain_path(top, k, h, fanout)
            out.append((s, doc, leaf, trees[s][-1][0], top[-1][0], H(*proof, *more), h, h == top[-1][0]))
    return out


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def both(df, fanout, levels):
    changed = F.when(F.col("doc_id") % 2 == 0, merkle.leaf_hash([*[F.col(c) for c in COLUMNS[:-1]], F.translate("text", "\n", "")]))
    got = merkle.manifest(df, merkle.leaf_hash([F.col(c) for c in COLUMNS]), changed, fanout=fanout, levels=levels)
    rows = []
    for r in df.collect():
        values = [r[c] for c in COLUMNS]
        later = plain_leaf([*values[:-1], values[-1] and values[-1].replace("\n", "")])
        rows.append((r["source"], r["doc_id"], plain_leaf(values), later if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else None))
    key = lambda r: tuple(map(repr, r))
    return sorted(map(tuple, got.collect()), key=key), sorted(plain_manifest(rows, fanout), key=key)


def test_odd_rows_and_repeats(spark, odd, nothing):
    got, want = both(odd, 3, 1)
    assert got == want and len(got) == 11
    assert {r[7] for r in got if r[1] == 4} == {False}
    empty = merkle.manifest(nothing, merkle.leaf_hash([F.col("text")]))
    assert empty.collect() == []
    one = spark.createDataFrame([(7, "only", "a")], "doc_id long, text string, source string")
    row = merkle.manifest(one, merkle.leaf_hash([F.col("text")])).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == H()


@pytest.mark.parametrize(("fanout", "levels"), [(3, 2), (2, 1), (5, 3)])
def test_against_plain_hashing(spark, fanout, levels):
    rows = [(i % 90, "a" if i % 3 else f"s{i % 7}", "en", i, f"text {i}\nmore" if i % 5 else None) for i in range(260)]
    rows += rows[:4]
    got, want = both(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5), fanout, levels)
    assert got == want


def test_states_resume_like_whole_messages():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 7, 20):
        leaves, other = (rng.integers(0, 256, (size, 32), dtype=np.uint8) for _ in range(2))
        block = merkle.Block.grown(leaves, merkle.levels_above(size))
        again = merkle.Block.read(size, *block.written())
        levels = plain_levels([bytes(x).hex() for x in leaves], 3)
        assert bytes(again.nodes[-1][0]).hex() == levels[-1][0]
        folded = again.folded(other)
        for i in range(size):
            proof, h = plain_path(levels, i, bytes(other[i]).hex(), 3)
            assert bytes(folded[i]).hex() == h and again.siblings()[i].decode() == "".join(proof)
            assert bytes(merkle.folded_over(other[i : i + 1], again.steps()[i])[0]).hex() == h


def test_constants_follow_from_primes():
    state = sha256.absorb(sha256.starts(1), np.frombuffer(b"a" * 64, np.uint8).reshape(1, 64))
    assert sha256.digests(sha256.absorb(state, sha256.closing(1))).tobytes() == hashlib.sha256(b"a" * 64).digest()
