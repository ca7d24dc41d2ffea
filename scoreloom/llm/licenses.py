"""License scan with a positional index of rare words. DataFrame functions only.

A template is a label with key phrases; every phrase is mandatory. Only words of some phrase are indexed, with their positions in the
file. Counts over all files give every such word its inverse document frequency. A file is looked up by the rarest word of each phrase:
its places, moved back by the word's offset, are the possible starts, and these are intersected with the moved places of the phrase's
other words. A start that survives for all words is a place of the whole phrase.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import written

#: What a word is, and the phrases and labels of the base scan.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = {"cc-by": ["cc by"], "gpl": ["general public license"], "reserved": ["all rights reserved"]}
#: Key phrases of public license texts and notices.
TEMPLATES = {
    "agpl": ["affero general public license"],
    "apache": ["apache license version"],
    "artistic": ["the artistic license"],
    "boost": ["boost software license"],
    "bsd": ["redistribution and use in source and binary forms"],
    "bsd-notice": ["bsd license"],
    "cc-by-nc": ["cc by nc"],
    "cc-by-nd": ["cc by nd"],
    "cc-by-sa": ["cc by sa"],
    "cc0": ["cc0 1 0"],
    "creative-commons": ["creative commons attribution"],
    "eclipse": ["eclipse public license"],
    "gfdl": ["gnu free documentation license"],
    "gnu-gpl": ["gnu general public license", "licensed under"],
    "isc": ["permission to use copy modify and or distribute this software"],
    "lgpl": ["lesser general public license"],
    "mit": ["mit license"],
    "mit-text": ["permission is hereby granted free of charge", "the software is provided as is"],
    "mozilla": ["mozilla public license"],
    "public-domain": ["released into the public domain"],
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _index(df: DataFrame, doc_id: str, text: str, vocabulary: Sequence[str]) -> DataFrame:
    """``doc_id, n_words, hits``: indexed words of each file with their positions."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LICENSE_WORD), F.lit(0))
    placed = F.filter(
        F.transform(F.col("words"), lambda w, i: F.struct(i.cast("long").alias("i"), w.alias("w"))), lambda s: F.lower(s["w"]).isin(*vocabulary),
    )
    # Only A-Z is folded; the wider folding above merely narrows down.
    folded = F.transform(placed, lambda s: F.struct(s["i"].alias("i"), F.translate(s["w"], _UPPER, _LOWER).alias("w")))
    return df.select(F.col(doc_id).alias("doc_id"), words.alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.filter(folded, lambda s: s["w"].isin(*vocabulary)).alias("hits"),
    )


def word_idf(index: DataFrame, n_files: int, vocabulary: Sequence[str]) -> dict[str, float]:
    """Inverse document frequency of every indexed word over all files; one number per word comes to the driver."""
    counts = index.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counts.collect()}
    return {w: math.log((1 + n_files) / (1 + found.get(w, 0))) + 1 for w in vocabulary}


def phrase_starts(phrase: Sequence[str], idf: Mapping[str, float], hits: str = "hits") -> Column:
    """Starts of a phrase in a file, found through its rarest word."""

    def moved(word: str, offset: int) -> Column:
        return F.transform(F.filter(F.col(hits), lambda s: s["w"] == word), lambda s: s["i"] - offset)

    order = sorted(range(len(phrase)), key=lambda k: (-idf[phrase[k]], k))
    starts = moved(phrase[order[0]], order[0])
    for k in order[1:]:
        starts = F.array_intersect(starts, moved(phrase[k], k))
    return starts


def scan(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", base: Mapping[str, Sequence[str]] = BASE,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, places, rarest_word, score``.

    ``places`` maps every label found to the starts of its phrases. ``score`` is the IDF-weighted share of the file's indexed words that lie in
    a phrase it holds: 1 if all license words are part of license phrases, 0 if none. Null and empty texts have no words and no labels.
    Repeated rows give repeated results; ties for the rarest word go to the first by name.
    """
    named = [(label, [p.split() for p in phrases], label in base) for label, phrases in [*base.items(), *templates.items()]]
    vocabulary = sorted({w for _, phrases, _ in named for p in phrases for w in p})
    index = written(_index(df, doc_id, text, vocabulary), "licenses")
    idf = word_idf(index, index.count(), vocabulary)
    weight = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, idf[w])])
    empty = F.array().cast("array<bigint>")
    some = F.size("hits") > 0
    starts = {f"p{n}_{k}": phrase_starts(p, idf) for n, (_, phrases, _) in enumerate(named) for k, p in enumerate(phrases)}
    found = index.withColumns({name: F.when(some, value).otherwise(empty) for name, value in starts.items()})
    held = [[f"p{n}_{k}" for k in range(len(phrases))] for n, (_, phrases, _) in enumerate(named)]
    all_of = [_all([F.size(c) > 0 for c in cols]) for cols in held]
    base_starts = F.array_sort(F.flatten(F.array(*[F.col(c) for cols, (_, _, b) in zip(held, named, strict=True) if b for c in cols])))

    def labels(only_base: bool) -> Column:
        picked = [F.when(ok, F.lit(label)) for ok, (label, _, b) in zip(all_of, named, strict=True) if b or not only_base]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*picked)))), ",")

    places = F.map_from_entries(F.array_compact(F.array(*[
        F.when(ok, F.struct(F.lit(label).alias("label"), F.array_sort(F.concat(*[F.col(c) for c in cols])).alias("starts")))
        for ok, cols, (label, _, _) in zip(all_of, held, named, strict=True)
    ])))
    # Places covered by phrases of the labels found.
    covered = F.array_distinct(F.concat(empty, *[
        F.when(ok, _span(c, len(p))).otherwise(empty)
        for ok, cols, (_, phrases, _) in zip(all_of, held, named, strict=True) for c, p in zip(cols, phrases, strict=True)
    ]))
    weighed = F.transform(F.col("hits"), lambda s: F.struct(s["i"].alias("i"), weight[s["w"]].alias("x")))
    total = F.aggregate("weighed", F.lit(0.0), lambda a, s: a + s["x"])
    inside = F.aggregate("weighed", F.lit(0.0), lambda a, s: a + F.when(F.array_contains("covered", s["i"]), s["x"]).otherwise(0.0))
    rarest = F.array_min(F.transform(F.array_distinct(F.col("hits.w")), lambda w: F.struct((-weight[w]).alias("x"), w.alias("w"))))["w"]
    out = found.select(
        "doc_id", "n_words", base_starts.alias("base_starts"), labels(True).alias("base_labels"), labels(False).alias("labels"),
        places.alias("places"), F.when(some, rarest).alias("rarest_word"), weighed.alias("weighed"), covered.alias("covered"),
    )
    return out.select(
        "doc_id", "n_words", F.size("base_starts").cast("long").alias("n_base"), F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"), "base_labels", "labels", "places", "rarest_word",
        F.when(F.size("covered") > 0, F.least(inside / total, F.lit(1.0))).otherwise(F.lit(0.0)).alias("score"),
    )


def _span(starts: str, n: int) -> Column:
    """All places of phrases of ``n`` words."""
    return F.flatten(F.transform(F.col(starts), lambda s: F.sequence(s, s + (n - 1))))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
