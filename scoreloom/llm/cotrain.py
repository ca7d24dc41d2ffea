"""Quality classifier by co-training of two views.

One classifier sees the text's content, the other the page's metadata: source, language, length, line layout and, where a page points to the
document, its address. Both start from the same labelled rows. In every round each labels the pool documents it is surest of, and the
other learns from them; a document that both would label differently is left alone. In the end each view is calibrated on labelled rows
that took no part in training, the calibrated log-odds are combined, and every document is scored.

Classifiers are fitted on a bounded sample of labelled rows, ``MAX_LABELLED``, drawn by a hash of the id. The pool is every other document: their
features are written once, each round scores all of them on Spark, and only the few surest, at most ``PER_ROUND`` for each view, come to the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import written
from scoreloom.llm.rules import CLASSES, class_counts

MAX_LABELLED = 8000
ROUNDS, PER_ROUND = 5, 200
#: Hashed places of words in the text view, and of names (source, language, host) in the metadata view.
WORD_PLACES, NAME_PLACES = 256, 64
#: A view may pass on a label it holds at least so likely.
SURE = 0.9

_STYLE = len(CLASSES) + 6
TEXT_WIDTH = _STYLE + WORD_PLACES
_LAYOUT = 7
META_WIDTH = _LAYOUT + 4 + NAME_PLACES


def _place(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % n


def text_features(text: str | None) -> np.ndarray:
    """Content: characters by class, repetition and word shape, and hashed words (square roots of shares)."""
    out = np.zeros(TEXT_WIDTH, np.float32)
    words = text.lower().split() if text else []
    if not words:
        return out
    n, counts = len(words), Counter(words)
    out[: len(CLASSES)] = np.sqrt(class_counts(text) / len(text))
    most = max(counts.values())
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    plain = sum(k for w, k in counts.items() if w.isalpha())
    out[len(CLASSES) : _STYLE] = (len(counts) / n, most / n, same / n, plain / n, len(text) / n / 10, np.log1p(n) / 10)
    places = out[_STYLE:]
    for word, k in counts.items():
        places[_place(word, WORD_PLACES)] += k
    np.sqrt(places / n, out=places)
    return out


def layout_features(text: str | None) -> list[float]:
    """Lines of a text: how many, how long, how they end, how often they repeat."""
    if not text:
        return [0.0] * _LAYOUT
    lines = text.split("\n")
    lengths = [len(x) for x in lines]
    mean = len(text) / len(lines)
    ended = sum(x.rstrip()[-1:] in (".", "!", "?", ":", '"') for x in lines) / len(lines)
    return [
        float(np.log1p(len(text)) / 10), float(np.log1p(len(lines)) / 5), float(np.log1p(mean) / 8), float(np.log1p(max(lengths)) / 10),
        ended, 1 - len(set(lines)) / len(lines), sum(x < 20 for x in lengths) / len(lines),
    ]


def meta_features(layout: list[float], source: str | None, lang: str | None, url: str | None) -> np.ndarray:
    out = np.zeros(META_WIDTH, np.float32)
    out[:_LAYOUT] = layout
    scheme, _, rest = (url or "").partition("://")
    host, _, path = rest.partition("/")
    out[_LAYOUT : _LAYOUT + 4] = (url is not None, scheme == "https", path.count("/") / 4, "?" in path)
    for kind, name in (("s", source), ("l", lang), ("h", host or None)):
        if name is not None:
            out[_LAYOUT + 4 + _place(f"{kind}/{name}", NAME_PLACES)] += 1
    return out


@dataclass
class Logistic:
    """Logistic regression with standardised inputs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Logistic:
        """Newton steps on the ridge-penalised likelihood; the two classes weigh the same."""
        mean, scale = rows.mean(axis=0), rows.std(axis=0)
        scale = np.where(scale > 1e-6, scale, 1.0)
        x = np.c_[(rows - mean) / scale, np.ones(len(rows))].astype(np.float64)
        positive = max(1, labels.sum())
        share = np.where(labels == 1, 0.5 / positive, 0.5 / max(1, len(labels) - positive)) * len(labels)
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(steps):
            p = _sigmoid(x @ w)
            curve = share * np.maximum(p * (1 - p), 1e-6)
            gradient = x.T @ (share * (p - labels)) + penalty * w
            w -= np.linalg.solve((x * curve[:, None]).T @ x + np.diag(penalty), gradient)
        return cls(mean.astype(np.float32), scale.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]))

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Clipped log-odds, in the precision of ``rows``."""
        return np.clip(((rows - self.mean) / self.scale) @ self.weights.astype(rows.dtype) + self.bias, -30, 30)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    text_platt: tuple[float, float]
    meta_platt: tuple[float, float]
    joint: tuple[float, float, float]

    def calibrated(self, text_odds: np.ndarray, meta_odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated likelihood of good quality from the text, from the metadata, and from both."""
        a = self.text_platt[0] * text_odds + self.text_platt[1]
        b = self.meta_platt[0] * meta_odds + self.meta_platt[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.joint[0] * a + self.joint[1] * b + self.joint[2])


def _calibration(columns: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Unweighted logistic fit of a few columns: slopes and offset."""
    x = np.c_[columns, np.ones(len(labels))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        curve = np.maximum(p * (1 - p), 1e-6)
        w -= np.linalg.solve((x * curve[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (p - labels) + 1e-2 * w)
    return w


#: What a pool gives: surest documents of one direction, as (keys, rows of the pupil's view).
Pick = tuple[list, np.ndarray]


class ArrayPool:
    """Unlabelled rows in memory."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.rows = {"text": text, "meta": meta}

    def surest(self, models: dict[str, Logistic], wanted: dict[tuple[str, int], int], taken: dict[str, list]) -> dict[tuple[str, int], Pick]:
        """For every (teacher, label) the ``wanted`` number of rows the teacher is surest of, the pupil has not taken and does not contradict."""
        likely = {v: _sigmoid(models[v].log_odds(rows.astype(float))) for v, rows in self.rows.items()}
        out = {}
        for (teacher, label), n in wanted.items():
            pupil = "meta" if teacher == "text" else "text"
            sure, other = (likely[v] if label else 1 - likely[v] for v in (teacher, pupil))
            free = np.ones(len(sure), bool)
            free[taken[pupil]] = False
            open_ = np.flatnonzero(free & (sure >= SURE) & (other > 1 - SURE))
            best = open_[np.argsort(-sure[open_], kind="stable")[:n]]
            out[teacher, label] = (best.tolist(), self.rows[pupil][best])
        return out


class TablePool:
    """Unlabelled rows of a written table ``row, doc_id, x``; ties in sureness go to the smaller id, then the smaller row."""

    def __init__(self, table: DataFrame):
        self.table = table

    def surest(self, models: dict[str, Logistic], wanted: dict[tuple[str, int], int], taken: dict[str, list]) -> dict[tuple[str, int], Pick]:
        shared = self.table.sparkSession.sparkContext.broadcast(models)

        @F.pandas_udf("struct<text: double, meta: double>")
        def likely(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for xs in batches:
                rows = _unpacked(xs)
                yield pd.DataFrame({v: _sigmoid(shared.value[v].log_odds(x.astype(float))) for v, x in zip(("text", "meta"), rows, strict=True)})

        scored = written(self.table.select("row", "doc_id", likely("x").alias("p")).select("row", "doc_id", "p.*"), "pool-odds")
        best = None
        for (teacher, label), n in wanted.items():
            pupil = "meta" if teacher == "text" else "text"
            sure, other = (F.col(v) if label else 1 - F.col(v) for v in (teacher, pupil))
            # At most PER_ROUND numbers for every round have been taken.
            free = scored.filter((sure >= SURE) & (other > 1 - SURE) & ~F.col("row").isin(taken[pupil]))
            part = free.orderBy(sure.desc(), "doc_id", "row").limit(n).select("row", F.lit(teacher).alias("teacher"), F.lit(label).alias("label"))
            best = part if best is None else best.union(part)
        best = best.collect()
        shared.unpersist()
        rows = self.table.filter(F.col("row").isin([r["row"] for r in best])).select("row", "x").collect() if best else []
        views = dict(zip([r["row"] for r in rows], zip(*_unpacked([r["x"] for r in rows]), strict=True), strict=True)) if rows else {}
        out = {}
        for teacher, label in wanted:
            keys = [r["row"] for r in best if (r["teacher"], r["label"]) == (teacher, label)]
            side = 1 if teacher == "text" else 0
            out[teacher, label] = (keys, np.array([views[k][side] for k in keys]).reshape(len(keys), META_WIDTH if side else TEXT_WIDTH))
        return out


def _unpacked(xs) -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([np.frombuffer(x, "<f4") for x in xs]).reshape(-1, TEXT_WIDTH + META_WIDTH)
    return rows[:, :TEXT_WIDTH], rows[:, TEXT_WIDTH:]


def co_train(
    text: np.ndarray, meta: np.ndarray, labels: np.ndarray, calibrate: np.ndarray, pool, rounds: int = ROUNDS, per_round: int = PER_ROUND
) -> CoTrained | None:
    """``labels`` are 0 or 1, ``calibrate`` marks rows kept for calibration, ``pool`` has the unlabelled rows. None without both classes on both sides."""
    known = ~calibrate
    if {*labels[known]} != {0, 1} or {*labels[calibrate]} != {0, 1}:
        return None
    own = {"text": (text[known], labels[known]), "meta": (meta[known], labels[known])}
    share = float(labels[known].mean())
    # Either class gets its share of the labels passed on, so that the pupil's balance stays.
    numbers = {1: round(per_round * share), 0: max(1, round(per_round * (1 - share)))}
    taken: dict[str, list] = {"text": [], "meta": []}
    models = {v: Logistic.fit(*own[v]) for v in own}
    for _ in range(rounds):
        picked = pool.surest(models, {(t, label): numbers[label] for t in ("text", "meta") for label in (1, 0)}, taken)
        for (teacher, label), (keys, rows) in picked.items():
            pupil = "meta" if teacher == "text" else "text"
            taken[pupil] += keys
            own[pupil] = (np.concatenate([own[pupil][0], rows]), np.append(own[pupil][1], np.full(len(keys), label)))
        models = {v: Logistic.fit(*own[v]) for v in own}
    odds = {"text": models["text"].log_odds(text[calibrate]), "meta": models["meta"].log_odds(meta[calibrate])}
    truth = labels[calibrate]
    a, b = _calibration(odds["text"][:, None], truth), _calibration(odds["meta"][:, None], truth)
    both = np.c_[a[0] * odds["text"] + a[1], b[0] * odds["meta"] + b[1]]
    return CoTrained(models["text"], models["meta"], (a[0], a[1]), (b[0], b[1]), tuple(_calibration(both, truth)))


def page_addresses(pages: DataFrame, url: str = "url") -> DataFrame:
    """``(page_doc, url)``: the address of the page that names a document by the first number in its path; the smallest of several."""
    number = F.regexp_extract(F.col(url), r"://[^/]*/(?:.*?/)?(\d+)", 1).try_cast("long")
    named = pages.select(number.alias("page_doc"), F.col(url).alias("url")).filter("page_doc is not null")
    return named.groupBy("page_doc").agg(F.min("url").alias("url"))


def _drawn(doc_id: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(doc_id)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fit(
    docs: DataFrame, labels: DataFrame, addresses: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    source: str = "source", lang: str = "lang", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, per_round: int = PER_ROUND,
) -> CoTrained | None:
    """Fit on labelled rows and the whole pool of others.

    Labels other than 0 and 1, and ids with several labels, are left out; their documents are in the pool. Null texts are empty ones, texts of any
    length are read whole. Repeated rows are rows of their own. Without documents, or without both labels, there is no model.
    """
    clean = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("lab_id")).agg(
        F.min(label).alias("lab"), F.max(label).alias("lab_max")
    ).filter("lab = lab_max").drop("lab_max")
    n_labels, n_docs = clean.count(), docs.count()
    if not n_labels or not n_docs:
        return None
    sample = clean.filter(_drawn("lab_id", 4) < min(1.0, max_labelled / n_labels))
    # At most about max_labelled rows: a stated bound.
    marked = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
    ).join(F.broadcast(sample), F.col("doc_id") == F.col("lab_id"), "left")
    taken = _with_address(marked, addresses)

    @F.pandas_udf("binary")
    def features(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([
                np.concatenate([text_features(t), meta_features(layout_features(t), s, name, u)]).astype("<f4").tobytes()
                for t, s, name, u in zip(*columns, strict=True)
            ])

    fold = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(4)).cast("int")
    featured = taken.select(
        "doc_id", F.coalesce(F.col("lab").cast("long"), F.lit(-1)).alias("lab"), fold.alias("fold"), features("text", "source", "lang", "url").alias("x"),
    )
    table = written(featured.withColumn("row", F.monotonically_increasing_id()), "features")
    drawn = table.filter("lab >= 0").orderBy("doc_id", "x").collect()
    if not drawn:
        return None
    text_rows, meta_rows = _unpacked([r["x"] for r in drawn])
    keep_out = np.array([r["fold"] for r in drawn]) == 0
    return co_train(text_rows, meta_rows, np.array([r["lab"] for r in drawn]), keep_out, TablePool(table.filter("lab < 0")), rounds, per_round)


def _with_address(df: DataFrame, addresses: DataFrame | None) -> DataFrame:
    if addresses is None:
        return df.withColumn("url", F.lit(None).cast("string"))
    return df.join(addresses, F.col("doc_id") == F.col("page_doc"), "left").drop("page_doc")


def scores(
    docs: DataFrame, model: CoTrained | None, addresses: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
    source: str = "source", lang: str = "lang",
) -> DataFrame:
    """``doc_id, text_score, meta_score, score`` of every row: calibrated likelihoods of good quality from each view and from both.

    Null and empty texts are scored by what is left. Without a model (no usable labels) scores are null. Repeated rows are scored alike.
    The texts are read once; only ids, log-odds and layout go on to the join with page addresses.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<odds: double, layout: array<double>>")
    def content(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            values, odds = texts.tolist(), []
            for at in range(0, len(values), 512):
                rows = np.array([text_features(x) for x in values[at : at + 512]])
                odds += shared.value.text.log_odds(rows).tolist() if shared.value else [None] * len(rows)
            yield pd.DataFrame({"odds": odds, "layout": [layout_features(x) for x in values]})

    @F.pandas_udf("struct<text_score: double, meta_score: double, score: double>")
    def combined(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for odds, layout, sources, langs, urls in batches:
            names = ["text_score", "meta_score", "score"]
            if shared.value is None:
                yield pd.DataFrame({c: np.full(len(odds), np.nan) for c in names})
                continue
            rows = np.array([meta_features(list(x), s, name, u) for x, s, name, u in zip(layout, sources, langs, urls, strict=True)])
            yield pd.DataFrame(dict(zip(names, shared.value.calibrated(odds.to_numpy(), shared.value.meta.log_odds(rows)), strict=True)))

    seen = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), content(F.col(text)).alias("c"),
    )
    both = _with_address(seen, addresses)
    out = both.select("doc_id", combined("c.odds", "c.layout", "source", "lang", "url").alias("s"))
    return out.select("doc_id", *[F.nanvl(F.col(f"s.{c}"), F.lit(None).cast("double")).alias(c) for c in ("text_score", "meta_score", "score")])
