"""License scan, quality rules, sharding, language ID, co-training and language-model scoring."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import cotrain, langid, licenses, lm, queries, rules, shards

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.execute(queries.SQL[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in queries.QUERIES[name](spark, SMALL).collect()]
    key = "page_id" if name == "op12_warc" else "doc_id"
    by_id = {r[key]: r for r in want}
    assert len(got) == len(want) and all(r == by_id[r[key]] for r in got)


def test_licenses_on_a_fixture(spark, odd, nothing):
    rows = [
        (1, "Licensed under CC-BY. ALL rights\nreserved; cc by"), (2, "the GNU General  Public License, not general public licenses"), (3, None), (4, ""),
        (5, "permission is hereby granted, free of charge"), (6, "permission is hereby granted, free of charge ... the software is provided “as is”"),
        (7, "by cc general license public reserved rights all Kelvin"), (8, "x " * 30000 + "MIT License"),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 2, 7, "cc-by,reserved")
    assert got[2]["labels"] == "gpl" and got[2]["places"] == {"gpl": [2]}
    assert [got[i]["labels"] for i in (3, 4, 5, 7)] == ["", "", "", ""]
    # Curly quotes are words here, so the second phrase is broken and the label is not given.
    assert got[6]["labels"] == ""
    assert got[8]["labels"] == "mit" and got[8]["places"] == {"mit": [30000]} and 0 < got[8]["score"] <= 1
    assert got[3]["n_words"] == 0 and got[3]["score"] == 0 and got[3]["rarest_word"] is None
    assert licenses.scan(odd).count() == 11 and licenses.scan(nothing).count() == 0


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(runs)
    covered = {k for i, r in enumerate(runs) if often[r] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(docs, texts):
    for r in rules.with_rules(docs).select("doc_id", "lang", "rules.*").collect():
        want = plain_rules(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_references_and_distances(docs, texts):
    known = rules.references(docs)
    rows = docs.select("doc_id", "lang").collect()
    for lang, own in known.items():
        words = Counter(w for r in rows if r["lang"] == lang for w in rules.letter_words(texts[r["doc_id"]]))
        total = sum(words.values())
        best = sorted((-n, w) for w, n in words.items() if n >= rules.COMMON_SHARE * total)[: rules.COMMON_WORDS]
        assert [(-int(own.counts[k]), w) for w, k in own.words.items()][: len(best)] == best
        assert own.counts.sum() == total
    a, b = np.array([1.0, 2, 0]), np.array([0.0, 1, 3])
    p, q = a / 3, b / 4
    m = (p + q) / 2
    want = math.sqrt(sum(x * math.log2(x / y) / 2 for s in (p, q) for x, y in zip(s, m, strict=True) if x))
    assert rules.js_distance(a, b) == pytest.approx(want)
    assert rules.js_distance(a, a) == 0 and rules.js_distance(np.array([1, 0]), np.array([0, 1])) == 1


def test_rules_keep_clean_and_find_junk(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = rules.with_rules(docs).join(labels, "doc_id").filter("not rules.base_failed").select("rules.kept", "quality").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert any(not r["kept"] for r in rows if r["quality"] == 0)


def test_rules_odd_rows(odd, nothing):
    rows = rules.with_rules(odd).collect()
    assert len(rows) == 11 and all(r["rules"]["base_failed"] and not r["rules"]["kept"] for r in rows if not (r["text"] or "").strip())
    assert [r["rules"]["n_repeat_words"] for r in rows if r["doc_id"] == 5] == [120000]
    assert rules.with_rules(nothing).count() == 0


def test_shards_match_the_mixture(docs):
    rows = shards.with_shards(docs, 5).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(5) for k in range(40)]
    sources = Counter(r["source"] for r in rows)
    for s, n in sources.items():
        counts = Counter(r["shard"] for r in rows if r["source"] == s)
        assert all(abs(counts[k] - n / 5) < 2 for k in range(5))


def test_shards_odd_rows(odd, nothing):
    rows = shards.with_shards(odd, 8, tie=F.col("text")).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [1] * 5 + [2] * 3
    assert shards.with_shards(nothing, 8).count() == 0
    few = shards.with_shards(odd.filter("doc_id in (5, 6)"), 8).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        shards.with_shards(odd.withColumn("Slot", F.lit(1)), 8)


def test_language_on_held_out_documents(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op2_language(spark, SMALL).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_language_odd_rows(spark, docs, odd, nothing):
    model = langid.fit(docs)
    rows = langid.with_language(odd, model).collect()
    for r in rows:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["language"]["lang"] == "und") == (not has_letter) and (has_letter or r["language"]["rejected"])
    far = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 5)], "doc_id long, text string")
    assert langid.with_language(far, model).first()["language"]["rejected"]
    assert langid.with_language(nothing, model).count() == 0
    assert {r["language"]["lang"] for r in langid.with_language(odd, langid.fit(nothing)).collect()} == {"und"}


def test_trigrams_do_not_depend_on_chunks(monkeypatch):
    text = "Ein kleiner Text, 12 mal geteilt -- und ünïcode." * 3
    whole = langid.trigram_counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 7)
    parts = langid.trigram_counts(text)
    assert (whole[0] == parts[0]).all() and whole[1] == parts[1]


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 2, 3000)
    text = rng.normal(truth[:, None] * 2.5, 1, (3000, 6)).astype(np.float32)
    meta = rng.normal(truth[:, None] * 1.5, 1, (3000, 4)).astype(np.float32)
    calibrate, pool = np.arange(120) < 40, cotrain.ArrayPool(text[120:], meta[120:])
    alone = cotrain.co_train(text[:120], meta[:120], truth[:120], calibrate, pool, rounds=0)
    model = cotrain.co_train(text[:120], meta[:120], truth[:120], calibrate, pool, rounds=5, per_round=200)

    def accuracy(m, k):
        return ((m.calibrated(m.text.log_odds(text), m.meta.log_odds(meta))[k] >= 0.5) == truth)[120:].mean()

    assert accuracy(model, 1) >= accuracy(alone, 1) - 0.005 and accuracy(model, 2) > 0.97
    assert cotrain.co_train(text[:120], meta[:120], np.ones(120, int), calibrate, pool) is None


def test_pool_table_picks_what_a_plain_search_picks(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(0, 1, (400, cotrain.TEXT_WIDTH + cotrain.META_WIDTH)).astype(np.float32)
    rows[100:110] = rows[99]
    table = spark.createDataFrame([(i, i, r.astype("<f4").tobytes()) for i, r in enumerate(rows)], "row long, doc_id long, x binary").repartition(3)
    text, meta = rows[:, : cotrain.TEXT_WIDTH], rows[:, cotrain.TEXT_WIDTH :]
    truth = (text[:, 0] + meta[:, 0] > 0).astype(int)
    models = {"text": cotrain.Logistic.fit(text, truth), "meta": cotrain.Logistic.fit(meta, truth)}
    wanted = {(t, label): n for t in ("text", "meta") for label, n in ((1, 30), (0, 7))}
    taken = {"text": [3, 5, 8], "meta": list(range(50))}
    got, want = cotrain.TablePool(table).surest(models, wanted, taken), cotrain.ArrayPool(text, meta).surest(models, wanted, taken)
    for key in wanted:
        assert got[key][0] == want[key][0] and len(want[key][0]) > 0
        assert np.array_equal(got[key][1], want[key][1])


def test_co_training_scores(spark, docs, odd, nothing):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    pages = cotrain.page_addresses(spark.createDataFrame([(1, "https://x.org/en/3?p=4"), (2, "https://x.org/a/3"), (3, None), (4, "none")], "page_id long, url string"))
    assert [tuple(r) for r in pages.collect()] == [(3, "https://x.org/a/3")]
    # A third of the labels is never shown to the model.
    shown = labels.filter("doc_id % 3 <> 0")
    model = cotrain.fit(docs, shown, pages)
    rows = cotrain.scores(docs, model, pages).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert len(rows) > 20 and np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) > 0.9
    strange = cotrain.scores(odd, model, pages).collect()
    assert len(strange) == 11 and all(0 <= r["score"] <= 1 for r in strange) and cotrain.scores(nothing, model).collect() == []
    # Rows without an id and with odd texts are in the pool.
    mixed = docs.unionByName(odd.drop("fingerprint"))
    assert cotrain.fit(mixed, shown, pages, rounds=1) is not None
    assert cotrain.fit(nothing, labels) is None
    assert all(r["score"] is None for r in cotrain.scores(odd, None).collect())


def test_language_model_against_single_windows():
    rng = np.random.default_rng(5)
    network = lm.Network.fresh(rng.random(lm.N_CLASSES) * 100)
    one_context = rng.integers(0, lm.N_CLASSES, (1, 2 * lm.SIDE)).astype(np.uint8)
    every = np.arange(lm.N_CLASSES, dtype=np.uint8)
    share = np.exp(network.log_probability(np.repeat(one_context, lm.N_CLASSES, axis=0), every))
    assert share.sum() == pytest.approx(1, abs=1e-4)
    text = rng.integers(0, lm.N_CLASSES - 1, 9).astype(np.uint8)
    padded = [lm.PAD] * lm.SIDE + text.tolist() + [lm.PAD] * lm.SIDE
    want = sum(
        float(network.log_probability(np.array([padded[i : i + lm.SIDE] + padded[i + lm.SIDE + 1 : i + 2 * lm.SIDE + 1]], np.uint8), text[i : i + 1])[0])
        for i in range(9)
    )
    n, total = lm.score_classes([np.empty(0, np.uint8), text], network)[1]
    assert (n, total) == (9, pytest.approx(want, rel=1e-4))


def test_language_model_learns(spark, odd, nothing):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{w} {w}end stop" for w in rng.choice(["red", "blue", "green", "white"], 400))) for i in range(200)]
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows[:20]]
    scorer = lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    both = lm.with_score(spark.createDataFrame(rows[:20] + shuffled, "doc_id long, text string"), scorer).toPandas()
    mean = pd.Series([x["mean"] for x in both["lm"]]).groupby(both["doc_id"] >= 1000).mean()
    assert mean[False] > mean[True] + 0.2
    found = lm.corpus_scores(odd).collect()
    assert len(found) == 11 and {(r["doc_id"], r["n_tokens"], r["mean"]) for r in found if r["doc_id"] in (2, 3, 4)} == {(2, 0, None), (3, 0, None), (4, 0, None)}
    assert lm.corpus_scores(nothing).collect() == []


def test_scores_tell_words_from_letters(spark, docs, texts):
    """Real texts against random letters in words of the same lengths, and every score against plain counts."""
    rng = np.random.default_rng(9)
    scorer = lm.train(docs)
    plain = [(i, t) for i, t in sorted(texts.items()) if t and 50 <= len(t.split()) <= 2000 and t.isascii()][:40]
    noise = [(10_000 + i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), len(w))) for w in t.split())) for i, t in plain]
    rows = {r["doc_id"]: r["lm"] for r in lm.with_score(spark.createDataFrame(plain + noise, "doc_id long, text string"), scorer).collect()}
    assert np.mean([rows[i]["mean"] > rows[10_000 + i]["mean"] + 1 for i, _ in plain]) > 0.9
    counts = Counter(w for t in texts.values() for w in lm.lm_words(t))
    listed = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.N_CLASSES - lm.RARE - 1]}
    assert set(scorer.words) == listed and len(scorer.spelling.cells) >= len(counts)
    n_cells, cells, sizes = len(scorer.spelling.cells), Counter(), Counter()
    for w, n in counts.items():
        if w not in listed:
            cells[zlib.crc32(w.encode()) % n_cells] += n
            sizes[min(len(w), lm.RARE)] += n
    classes = lm.Classes(scorer.words)
    for i, t in plain[:10] + noise[:10]:
        words = lm.lm_words(t)
        want = sum(
            math.log(cells[zlib.crc32(w.encode()) % n_cells] + 0.5) - math.log(sizes[min(len(w), lm.RARE)] + 0.5 * n_cells) for w in words if w not in listed
        )
        own = lm.score_classes([classes.of(words)], scorer.network)[0][1]
        assert rows[i]["log_probability"] == pytest.approx(own + want, rel=1e-4) and rows[i]["n_tokens"] == len(words)


def test_word_counts_are_exact(docs, texts):
    counts = Counter(w for t in texts.values() for w in lm.lm_words(t))
    found = lm.word_counts(docs)
    assert {r["word"]: r["n"] for r in found.collect()} == counts
    assert lm.frequent_words(found, n=50) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50]
