"""Language-model scoring by masked pseudo-likelihood.

Every token is predicted from the words on both sides, the token itself masked, and a document's score is the sum of the conditional
log-probabilities. The network, trained in numpy: one embedding table per window place, their sum through tanh, and two softmax heads that
name the token's class by two digits, the second given the first. So probabilities sum to one over all classes at the cost of two small
softmaxes.

Classes are words: the ``N_CLASSES - RARE - 1`` most frequent words of the corpus, counted over all documents, have a class each; the rest
share ``RARE`` classes by length, and the last class pads the ends. A word that shares its class has a probability of its own inside it, its count
in the corpus over that of the class: all words are counted, in hashed cells whose number grows with the distinct words, up to ``2 ** MOST_BITS``.

Training is data-parallel over all windows of all documents, dealt by a hash into splits of about ``SPLIT_TOKENS``: in each round every task takes the
shared parameters, runs over its split once, and gives its parameters; they are averaged, weighted by tokens, by an aggregate, and the next
round goes on from the average. What comes to the driver is the word list, the cells and one set of parameters, all of bounded size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import free_name, written

#: Digit base (classes are its square), rare classes, words to either side, width, and training settings.
DIGIT = 16
N_CLASSES, RARE = DIGIT * DIGIT, 24
SIDE, WIDTH = 2, 16
BATCH, ROUNDS, RATE = 4096, 2, 0.5
SPLIT_TOKENS = 2_000_000
#: Cells of the words without a class of their own: at least, and at most (64 MB), as powers of two.
LEAST_BITS, MOST_BITS = 12, 24
SEED = 8
#: Distinct words a task counts before it passes its counts on.
COUNTERS = 300_000

PAD = N_CLASSES - 1


def lm_words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


@dataclass
class Network:
    """Parameters: ``places`` (2 * SIDE, classes, width), ``first`` (width, digit), ``second`` (width, digit), ``given`` (digit, digit)."""

    places: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    given: np.ndarray

    @classmethod
    def fresh(cls, frequency: np.ndarray | None = None, seed: int = SEED) -> Network:
        """Small random weights; the biases start at the log of the class frequencies."""
        rng = np.random.default_rng(seed)

        def small(*shape):
            return rng.normal(0, 0.1, shape).astype(np.float32)

        share = np.ones(N_CLASSES) if frequency is None else frequency + 1.0
        table = share.reshape(DIGIT, DIGIT) / share.sum()
        bias = np.log(table.sum(axis=1)).astype(np.float32)
        given = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
        return cls(small(2 * SIDE, N_CLASSES, WIDTH), small(WIDTH, DIGIT), small(WIDTH, DIGIT), bias, given)

    def parts(self) -> list[np.ndarray]:
        return [self.places, self.first, self.second, self.bias, self.given]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, values: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(np.asarray(values[at : at + p.size], np.float32).reshape(p.shape))
            at += p.size
        return Network(*out)

    def copy(self) -> Network:
        return Network(*[p.copy() for p in self.parts()])

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.places[0][context[:, 0]]
        for k in range(1, context.shape[1]):
            total = total + self.places[k][context[:, k]]
        return np.tanh(total)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        a, b = target // DIGIT, target % DIGIT
        hidden, rows = self._hidden(context), np.arange(len(target))
        one, two = hidden @ self.first + self.bias, hidden @ self.second + self.given[a]
        return _log_share(one, rows, a) + _log_share(two, rows, b)

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One descent step on the mean loss of a batch; a class's embedding moves by the mean over its own windows."""
        a, b = target // DIGIT, target % DIGIT
        n, rows = len(target), np.arange(len(target))
        hidden = self._hidden(context)
        one, two = _softmax(hidden @ self.first + self.bias), _softmax(hidden @ self.second + self.given[a])
        one[rows, a] -= 1
        two[rows, b] -= 1
        back = (one @ self.first.T + two @ self.second.T) * (1 - hidden * hidden)
        digits = np.zeros((n, DIGIT), np.float32)
        digits[rows, a] = 1
        per_digit = digits.T @ two
        self.first -= rate * (hidden.T @ one) / n
        self.second -= rate * (hidden.T @ two) / n
        self.bias -= rate * one.mean(axis=0)
        self.given -= rate * per_digit / (digits.sum(axis=0)[:, None] + 1)
        for k in range(context.shape[1]):
            column = np.ascontiguousarray(context[:, k])
            order = np.argsort(column, kind="stable")
            classes = column[order]
            starts = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
            sums = np.add.reduceat(back[order], starts, axis=0)
            counts = np.diff(np.append(starts, n))[:, None]
            self.places[k][classes[starts]] -= rate * sums / (counts + 4)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    x /= x.sum(axis=1, keepdims=True)
    return x


def _log_share(x: np.ndarray, rows: np.ndarray, picked: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    return x[rows, picked] - top - np.log(np.exp(x - top[:, None]).sum(axis=1))


class Classes(dict):
    """Words to classes; unlisted words go by their length."""

    def __init__(self, words: list[str]):
        super().__init__((w, i) for i, w in enumerate(words))

    def __missing__(self, word: str) -> int:
        return PAD - RARE + min(len(word), RARE) - 1

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint8, len(words))


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, targets and the text each belongs to; windows do not cross texts."""
    gap = np.full(SIDE, PAD, np.uint8)
    joined = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
    owner = np.concatenate([np.full(SIDE, -1), *[x for i, t in enumerate(texts) for x in (np.full(len(t), i), np.full(SIDE, -1))]])
    at = np.flatnonzero(owner >= 0)
    around = [k for k in range(-SIDE, SIDE + 1) if k]
    return joined[at[:, None] + np.array(around)], joined[at], owner[at]


def _blocks(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Texts, as classes, some 20,000 tokens at a time; a longer text is a block of its own."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= 20_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: every word of all documents with its exact count."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for body in batch["text"]:
                counts.update(lm_words(body))
                if len(counts) > COUNTERS:
                    yield pd.DataFrame(counts.items(), columns=["word", "n"])
                    counts = Counter()
        if counts:
            yield pd.DataFrame(counts.items(), columns=["word", "n"])

    rows = df.select(F.col(text).alias("text")).mapInPandas(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, n: int = N_CLASSES - RARE - 1) -> list[tuple[str, int]]:
    """The ``n`` most frequent words with their counts, ties by word."""
    return [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()]


def _cell(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


@dataclass
class Spelling:
    """Log-counts of the words without a class of their own, by hashed cell, and the log-totals of the rare classes."""

    cells: np.ndarray
    totals: np.ndarray

    def log_probability(self, words: list[str], classes: np.ndarray) -> float:
        """Sum over the words without a class of their own of their log-share in their class."""
        at = np.flatnonzero(classes >= PAD - RARE)
        hashed = np.fromiter(map(_cell, map(words.__getitem__, at.tolist())), np.int64, len(at)) & (len(self.cells) - 1)
        return float((self.cells[hashed] - self.totals[classes[at] - (PAD - RARE)]).sum(dtype=np.float64))


def spelling(counts: DataFrame, words: list[str]) -> Spelling:
    """Counts of all words but ``words`` in cells: one for about every distinct word, up to ``2 ** MOST_BITS``; half a word is added to each."""
    rest = counts.filter(~F.col("word").isin(words)) if words else counts
    distinct = counts.count()
    bits = min(MOST_BITS, max(LEAST_BITS, distinct.bit_length()))
    cells = np.full(1 << bits, 0.5)
    hashed = rest.groupBy(F.crc32(F.col("word").cast("binary")).bitwiseAND(F.lit((1 << bits) - 1)).alias("cell")).agg(F.sum("n").alias("n"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [pa.array([np.asarray(batch.column(i)).astype("<i8").tobytes()], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["cell", "n"])

    for row in hashed.mapInArrow(packed, "cell binary, n binary").toLocalIterator():
        cells[np.frombuffer(row["cell"], "<i8")] += np.frombuffer(row["n"], "<i8")
    totals = np.full(RARE, 0.5 * len(cells))
    for row in rest.groupBy(F.least(F.char_length("word"), F.lit(RARE)).alias("size")).agg(F.sum("n").alias("n")).collect():
        totals[row["size"] - 1] += row["n"]
    return Spelling(np.log(cells).astype(np.float32), np.log(totals))


@dataclass
class Scorer:
    words: list[str]
    spelling: Spelling
    network: Network


def encoded(df: DataFrame, words: list[str], spelled: Spelling, text: str = "text", name: str = "coded") -> DataFrame:
    """``df`` with ``struct<classes, spelled>`` in place of the text: a class per word, one byte each, and the log-shares inside the rare classes."""
    shared = df.sparkSession.sparkContext.broadcast((words, spelled))

    @F.pandas_udf("struct<classes: binary, spelled: double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classes, table = Classes(shared.value[0]), shared.value[1]
        for texts in batches:
            split = (lm_words(x) for x in texts)
            rows = [(found.tobytes(), table.log_probability(own, found)) for own in split for found in (classes.of(own),)]
            yield pd.DataFrame(rows, columns=["classes", "spelled"])

    return df.withColumn(name, of(F.col(text))).drop(text)


def fit(coded: DataFrame, start: Network, n_tokens: int, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """Train on all windows of the ``coded`` documents, in splits that follow from the rows alone. An empty table gives ``start``."""
    network = start
    key = F.xxhash64(*[c for c in coded.columns if c != "coded"], "coded.classes")
    n_splits = max(1, -(-n_tokens // SPLIT_TOKENS))
    dealt = coded.select(key.alias("k"), F.col("coded.classes").alias("c")).repartition(n_splits, "k").sortWithinPartitions("k")
    for r in range(rounds):
        shared = coded.sparkSession.sparkContext.broadcast(network)

        def fitted(batches: Iterator[pd.DataFrame], shared=shared, step=rate / (1 + r)) -> Iterator[pd.DataFrame]:
            own, seen = shared.value.copy(), 0
            for batch in batches:
                for block in _blocks(np.frombuffer(x, np.uint8) for x in batch["c"]):
                    context, target, _ = windows(block)
                    for at in range(0, len(target), BATCH):
                        own.step(context[at : at + BATCH], target[at : at + BATCH], step)
                    seen += len(target)
            if seen:
                values = own.flat().astype(np.float64) * seen
                at = range(0, len(values), 256)
                yield pd.DataFrame({"i": [*at], "weight": float(seen), "x": [values[k : k + 256] for k in at]})

        parts = dealt.select("c").mapInPandas(fitted, "i long, weight double, x array<double>")
        cells = parts.select("i", "weight", F.posexplode("x").alias("k", "v"))
        sums = cells.groupBy("i", "k").agg((F.sum("v") / F.sum("weight")).cast("float").alias("v"))
        got = sums.orderBy("i", "k").collect()
        if got:
            network = network.filled(np.array([row["v"] for row in got], np.float32))
    return network


def train(df: DataFrame, text: str = "text", rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED) -> Scorer:
    """A scorer trained on all texts of ``df``; an empty table gives an untrained one."""
    return _trained(df.select(F.col(text).alias("text")), rounds, rate, seed)[0]


def _trained(df: DataFrame, rounds: int, rate: float, seed: int) -> tuple[Scorer, DataFrame]:
    counts = written(word_counts(df), "words")
    listed = frequent_words(counts)
    words = [w for w, _ in listed]
    frequency = np.zeros(N_CLASSES)
    frequency[: len(listed)] = [n for _, n in listed]
    spelled = spelling(counts, words)
    frequency[PAD - RARE : PAD] = np.exp(spelled.totals) - 0.5 * len(spelled.cells)
    coded = written(encoded(df, words, spelled), "coded")
    network = fit(coded, Network.fresh(frequency, seed), counts.agg(F.sum("n")).first()[0] or 0, rounds, rate)
    return Scorer(words, spelled, network), coded


SCORE = "struct<n_tokens: long, log_probability: double, mean: double>"


def score_classes(texts: Iterator[np.ndarray], network: Network) -> list[tuple[int, float]]:
    """Tokens of every text, and the sum of the log-probabilities of their classes."""
    out = []
    for block in _blocks(texts):
        context, target, owner = windows(block)
        logs = np.zeros(len(target))
        for at in range(0, len(target), BATCH):
            logs[at : at + BATCH] = network.log_probability(context[at : at + BATCH], target[at : at + BATCH])
        sums = np.bincount(owner, weights=logs, minlength=len(block))
        out += [(len(t), float(s)) for t, s in zip(block, sums, strict=True)]
    return out


def pseudo_likelihood(spark, network: Network, coded: str) -> Column:
    """``struct<n_tokens, log_probability, mean>`` of a column of encoded texts."""
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf(SCORE)
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for classes, spelled in batches:
            found = score_classes((np.frombuffer(x, np.uint8) for x in classes), shared.value)
            rows = [(n, s + own, (s + own) / n if n else None) for (n, s), own in zip(found, spelled, strict=True)]
            yield pd.DataFrame(rows, columns=["n_tokens", "log_probability", "mean"])

    return scored(F.col(f"{coded}.classes"), F.col(f"{coded}.spelled"))


def with_score(df: DataFrame, scorer: Scorer, text: str = "text", name: str = "lm") -> DataFrame:
    """``df`` with ``struct<n_tokens, log_probability, mean>``: the sum over all tokens, and per token.

    Null and empty texts have no tokens, sum 0 and a null mean. Texts of any length are scored whole. Equal texts have equal scores, repeated rows
    too; a word the corpus does not have counts as half a word. An empty table gives no rows. A column called ``name`` is replaced.
    """
    body, coded = free_name([*df.columns, name], "text"), free_name([*df.columns, name], "coded")
    rows = encoded(df.withColumn(body, F.col(text)), scorer.words, scorer.spelling, body, coded)
    return rows.withColumn(name, pseudo_likelihood(df.sparkSession, scorer.network, coded)).drop(coded)


def corpus_scores(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_tokens, log_probability, mean`` of every row under a network trained on all rows; texts are encoded once.

    Null and empty texts as in ``with_score``; repeated rows are trained on and scored as often as they occur; no rows give no rows.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scorer, coded = _trained(rows, rounds, rate, seed)
    return coded.select("doc_id", pseudo_likelihood(df.sparkSession, scorer.network, "coded").alias("lm")).select("doc_id", "lm.*")
