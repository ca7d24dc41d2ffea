import math
import random

import numpy as np
import pytest

from scoreloom.llm import decontam

from .conftest import SMALL


def plain_search(rows, frequency, queries, threshold):
    out = set()
    for number, (_, question, answer, _) in enumerate(rows):
        words = question.split() + answer.split()
        impact = {}
        for t, tf in decontam.Counter(words).items():
            idf = math.log(1 + (len(rows) - frequency[t] + 0.5) / (frequency[t] + 0.5))
            impact[t] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / 18.0))
        total = sum(impact.values())
        for k, query in enumerate(queries):
            score = sum(impact.get(t, 0) for t in query) / total
            if score >= threshold - 1e-9:
                out.add((k, number, round(score, 9)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_wand_finds_what_a_full_scan_finds(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30))), " ".join(rng.choices(words, k=3)), False) for i in range(120)]
    frequency = decontam.Counter(w for _, q, a, _ in rows for w in {*q.split(), *a.split()})
    index = decontam.build_index(rows, frequency, len(rows), 18.0)
    for _ in range(10):
        queries = [rng.sample(sorted(index.terms), rng.randint(0, 40)) for _ in range(30)]
        pairs = sorted((k, index.terms[t]) for k, q in enumerate(queries) for t in q)
        threshold = rng.choice([0.05, 0.3, 0.5, 0.8])
        got = decontam.block_max_wand(index, np.array([p for p, _ in pairs]), np.array([t for _, t in pairs]), threshold)
        assert {(k, n, round(s, 9)) for k, n, s in zip(*(x.tolist() for x in got), strict=True)} == plain_search(rows, frequency, queries, threshold)


def test_documents_against_a_full_search(spark, docs, texts):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    found = {(r["doc_id"], x["item_id"]) for r in decontam.with_leaks(docs, benchmark).collect() for x in r["leaks"]}
    held = {(i, k) for i, t in texts.items() for k, body in items.items() if body in t}
    assert held and held <= found
    for i, k in found:
        own, whole = decontam.shingles(decontam.words_of(items[k])), decontam.shingles(decontam.words_of(texts[i]))
        assert len(own & whole) >= 0.8 * len(own)
    sharded = decontam.with_leaks(docs, benchmark, shard_cells=300)
    assert {(r["doc_id"], x["item_id"]) for r in sharded.collect() for x in r["leaks"]} == found


def test_near_copies_and_answers(spark):
    item = "What colour has the clear sky over the quiet northern sea at noon in summer? It is a deep and even blue."
    bench = spark.createDataFrame(
        [(1, item, None), (2, "Who wrote the long letter from the old harbour town", "Maria Lund"), (3, None, None), (None, "no id here", None), (4, "", None)],
        "item_id long, text string, answer string",
    )
    filler = "nothing to see in this filler sentence at all " * 12
    docs = spark.createDataFrame(
        [
            (1, filler + item.upper() + filler), (2, filler + item.replace("blue", "green") + filler), (3, filler + item[:60] + filler),
            (4, "who wrote the long letter from the old harbour town? It was Maria Lund, of course"),
            (5, "who wrote the long letter from the old harbour town? Nobody knows"), (6, None), (7, ""), (8, filler * 300 + item),
        ],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.with_leaks(docs, bench, answer="answer").collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [2], 5: [], 6: [], 7: [], 8: [1]}


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and then the cat sat again")], "item_id long, text string")
    rows = decontam.with_leaks(odd, bench)
    assert rows.columns == [*odd.columns, "leaks"]
    assert sorted(r["doc_id"] for r in rows.collect() if r["leaks"]) == [1, 1]
    assert decontam.with_leaks(nothing, bench).count() == 0
    assert all(r["leaks"] == [] for r in decontam.with_leaks(odd, bench.limit(0)).collect())
