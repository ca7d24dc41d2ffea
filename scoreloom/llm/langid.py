"""Language identification by nearest centroid.

A text becomes the TF-IDF vector of its hashed letter trigrams (lower case, everything else a space), of length one. Every language has
several centroids, clustered by spherical k-means, so that a language may come in several registers. A text gets the language of the
centroid with the largest cosine. It is rejected if it has no letter, or if it is long enough to judge and farther from its centroid than
the farthest training texts of that language, with a margin.

The model is fitted on a bounded sample of labelled rows (``MAX_TRAIN`` documents in all, drawn evenly over languages by a hash of the
text); every text is classified, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vector length, centroids per language, and the largest training sample.
DIM, CENTROIDS, MAX_TRAIN = 4096, 4, 2000
#: Texts with fewer letters are never rejected by distance.
MIN_LETTERS = 60
#: A text is too far if its cosine is below this share of the lowest percentile of its language's training texts.
REJECT_SHARE = 0.2
UNKNOWN = "und"

_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        table[start:stop] = [chr(c).isalpha() for c in range(start, stop)]
    return table


def trigram_counts(text: str | None, dim: int = DIM) -> tuple[np.ndarray, int]:
    """Counts of hashed letter trigrams, words padded with one space, and the number of letters."""
    counts, n_letters = np.zeros(dim, np.float32), 0
    if not text:
        return counts, 0
    shift = np.uint32(32 - (dim - 1).bit_length())
    tail = np.array([32], np.uint32)
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _letters()[codes]
        n_letters += int(letter.sum())
        codes = np.concatenate([tail, np.where(letter, codes, np.uint32(32))])
        if at + _CHUNK >= len(text):
            codes = np.append(codes, np.uint32(32))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        if len(codes) > 2:
            a, b, c = codes[:-2], codes[1:-1], codes[2:]
            mixed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> shift, minlength=dim)
        tail = codes[-2:]
    return counts, n_letters


@dataclass
class Centroids:
    langs: list[str]
    owner: np.ndarray
    vectors: np.ndarray
    idf: np.ndarray
    nearest_allowed: np.ndarray

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> list[tuple[str, float, float, bool]]:
        """``(language, cosine, margin to the next language, rejected)`` per row of trigram counts."""
        if not self.langs:
            return [(UNKNOWN, 0.0, 0.0, True)] * len(counts)
        cosine = np.clip(_unit(np.sqrt(counts) * self.idf) @ self.vectors.T, 0.0, 1.0)
        by_lang = np.zeros((len(counts), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            by_lang[:, k] = cosine[:, self.owner == k].max(axis=1)
        best = by_lang.argmax(axis=1)
        top = by_lang[np.arange(len(best)), best]
        rest = by_lang.copy()
        rest[np.arange(len(best)), best] = 0.0
        margin = top - rest.max(axis=1)
        far = (letters >= MIN_LETTERS) & (top < self.nearest_allowed[best])
        return [
            (self.langs[k], float(t), float(m), bool(f)) if n else (UNKNOWN, 0.0, 0.0, True)
            for k, t, m, f, n in zip(best, top, margin, far, letters, strict=True)
        ]


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids; starts from rows farthest from those already chosen, so the result follows from the rows alone."""
    chosen = [_unit(rows.mean(axis=0, keepdims=True))[0]]
    nearest = rows @ chosen[0]
    for _ in range(min(k, len(rows)) - 1):
        chosen.append(rows[int(nearest.argmin())])
        nearest = np.maximum(nearest, rows @ chosen[-1])
    centers = np.array(chosen)
    for _ in range(rounds):
        own = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        used = np.bincount(own, minlength=len(centers)) > 0
        new = np.where(used[:, None], _unit(sums), centers)
        if np.allclose(new, centers, atol=1e-6):
            break
        centers = new
    return centers


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_train: int = MAX_TRAIN, centroids: int = CENTROIDS) -> Centroids:
    """Fit on a sample of at most about ``max_train`` rows whose label and text are not null, as many of each language where there are."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    empty = Centroids([], np.empty(0, int), np.empty((0, DIM), np.float32), np.ones(DIM, np.float32), np.empty(0))
    if not sizes:
        return empty
    share = max(1, max_train // len(sizes))
    unit = F.pmod(F.xxhash64(F.lit(2), "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = F.lit(0.0)
    for name, n in sizes.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, share / n))).otherwise(rate)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(name, *trigram_counts(body)) for body, name in zip(batch["text"], batch["lang"], strict=True)]
            yield pd.DataFrame([(name, np.minimum(c, 60000).astype(np.uint16).tobytes()) for name, c, n in out if n], columns=["lang", "counts"])

    drawn = rows.filter(unit < rate).mapInPandas(vectors, "lang string, counts binary").orderBy("lang", "counts").collect()
    if not drawn:
        return empty
    counts = np.array([np.frombuffer(r["counts"], np.uint16) for r in drawn]).astype(np.float32)
    names = np.array([r["lang"] for r in drawn])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    unit_rows = _unit(np.sqrt(counts) * idf)
    langs = sorted(set(names.tolist()))
    owner, centers, allowed = [], [], []
    for k, name in enumerate(langs):
        own = unit_rows[names == name]
        found = spherical_kmeans(own, centroids)
        owner += [k] * len(found)
        centers.append(found)
        allowed.append(REJECT_SHARE * float(np.quantile((own @ found.T).max(axis=1), 0.01)))
    return Centroids(langs, np.array(owner), np.concatenate(centers).astype(np.float32), idf, np.array(allowed))


PREDICTION = "struct<lang: string, score: double, margin: double, rejected: boolean>"


def prediction(spark, model: Centroids, text: Column) -> Column:
    """``struct<lang, score, margin, rejected>`` of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTION)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values, out = texts.tolist(), []
            for at in range(0, len(values), 256):
                counted = [trigram_counts(x) for x in values[at : at + 256]]
                out += shared.value.predict(np.array([c for c, _ in counted]), np.array([n for _, n in counted]))
            yield pd.DataFrame(out, columns=["lang", "score", "margin", "rejected"])

    return predicted(text)


def with_language(df: DataFrame, model: Centroids, text: str = "text", name: str = "language") -> DataFrame:
    """``df`` with the prediction of each row's text as a struct; no shuffle.

    Null texts and texts without letters are ``und`` with score 0 and rejected. A model fitted on nothing rejects everything. Equal texts get
    equal predictions; ties between languages go to the first by name.
    """
    return df.withColumn(name, prediction(df.sparkSession, model, F.col(text)))
