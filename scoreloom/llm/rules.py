"""Quality rules on distributions: a document against its language's reference.

Two histograms of a text are compared with the reference of its language by the Jensen-Shannon distance (base 2, from 0 to 1): its
characters by class, and its words by common word ("other" for the rest). References are sums over all documents of a language. Short texts
are not judged: their histograms are noise. Common words are heavy hitters: every word with at least ``COMMON_SHARE`` of a language's
words is a candidate of the task where it is most frequent, and candidates are then counted exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rules: fewest words, window of the repetition count, largest share of repeated words in percent.
MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
#: Character classes; anything else is the last class.
CLASSES = ("lower", "upper", "other letter", "digit", "white", "stop", "bracket or quote", "symbol")
COMMON_WORDS, COMMON_SHARE = 64, 0.001
#: Largest distances, and the shortest texts that are judged by them.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.30, 200
MAX_WORD_DISTANCE, MIN_LETTER_WORDS = 0.75, 50
#: Counters of a task; beyond that the rarest are dropped with the usual bound of Misra and Gries.
COUNTERS = 200_000

_WHITE = " \t\n\x0b\x0c\r"
_LETTERS = re.compile(r"[^\W\d_]+")


def _class_table() -> np.ndarray:
    table = np.full(256, 7, np.int8)
    for code in range(256):
        c = chr(code)
        if "a" <= c <= "z":
            table[code] = 0
        elif "A" <= c <= "Z":
            table[code] = 1
        elif c.isalpha():
            table[code] = 2
        elif c.isdigit():
            table[code] = 3
        elif c in _WHITE or c == "\xa0":
            table[code] = 4
        elif c in ".,;:!?":
            table[code] = 5
        elif c in "()[]{}'\"-\xab\xbb":
            table[code] = 6
    return table


_CLASS = _class_table()


def class_counts(text: str) -> np.ndarray:
    """Characters of a text by class. Letters beyond Latin-1 are other letters, other characters beyond it symbols."""
    out = np.zeros(len(CLASSES), np.int64)
    for at in range(0, len(text), 1 << 20):
        codes = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "replace"), np.uint32)
        low = codes < 256
        out += np.bincount(_CLASS[codes[low]], minlength=len(CLASSES))
        for code, n in zip(*np.unique(codes[~low], return_counts=True), strict=True):
            out[2 if chr(int(code)).isalpha() else 7] += n
    return out


def letter_words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def n_repeated(words: list, window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words which occur at least twice."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    # Hashes of the windows first: without two equal ones there is no repeat.
    mixed = (ids + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        total = total * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : n - window + 1 + k]
    ordered = np.sort(total)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    # Exact: number the runs of two, four and so on; a window of any length is two overlapping runs of the largest power of two.
    runs, length = ids, 1
    while length * 2 <= window:
        runs = np.unique(runs[:-length] * np.int64(n + 1) + runs[length:], return_inverse=True)[1]
        length *= 2
    if length < window:
        shift = window - length
        runs = np.unique(runs[:-shift] * np.int64(n + 1) + runs[shift:], return_inverse=True)[1]
    again = np.bincount(runs)[runs] > 1
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _WHITE))
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeated(words)


def js_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; an empty one is at distance 1 from anything but another empty one."""
    if not a.sum() or not b.sum():
        return float(bool(a.sum()) != bool(b.sum()))
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = sum(np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q)) / 2
    return float(np.sqrt(max(0.0, min(1.0, total))))


@dataclass
class Reference:
    """Histograms of one language: characters by class, and the common words with one place for the rest."""

    classes: np.ndarray
    words: dict[str, int]
    counts: np.ndarray

    def distances(self, text: str) -> tuple[float, float, int]:
        own, words = np.zeros(len(self.counts)), letter_words(text)
        for word, n in Counter(words).items():
            own[self.words.get(word, len(self.words))] += n
        return js_distance(class_counts(text), self.classes), js_distance(own, self.counts), len(words)


def references(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Reference]:
    """References of all languages from all documents whose text and language are not null. What reaches the driver is bounded by the number of
    languages times the candidates of ``COMMON_SHARE``.
    """
    rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters: dict[str, Counter] = {}
        seen: Counter = Counter()
        for batch in batches:
            for name, body in zip(batch["lang"], batch["text"], strict=True):
                words = letter_words(body)
                seen[name] += len(words)
                own = counters.setdefault(name, Counter())
                own.update(words)
                if len(own) > COUNTERS:
                    floor = sorted(own.values(), reverse=True)[COUNTERS // 2]
                    counters[name] = Counter({w: n - floor for w, n in own.items() if n > floor})
        # A word with the share globally has it in at least one task; half of it allows for what was dropped.
        yield pd.DataFrame(
            [(name, w) for name, own in counters.items() for w, n in own.items() if n >= COMMON_SHARE / 2 * seen[name]],
            columns=["lang", "word"],
        )

    candidates: dict[str, set[str]] = {}
    for r in rows.mapInPandas(frequent, "lang string, word string").distinct().collect():
        candidates.setdefault(r["lang"], set()).add(r["word"])
    wanted = {name: {w: i for i, w in enumerate(sorted(words))} for name, words in candidates.items()}

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch["lang"], batch["text"], strict=True):
                known = wanted.get(name, {})
                own = words.setdefault(name, np.zeros(len(known) + 1, np.int64))
                classes.setdefault(name, np.zeros(len(CLASSES), np.int64))[:] += class_counts(body)
                for word, n in Counter(letter_words(body)).items():
                    own[known.get(word, len(known))] += n
        yield pd.DataFrame(
            [(name, kind, i, int(n)) for kind, side in enumerate((classes, words)) for name, own in side.items() for i, n in enumerate(own) if n],
            columns=["lang", "kind", "i", "n"],
        )

    sums = rows.mapInPandas(histograms, "lang string, kind int, i int, n long").groupBy("lang", "kind", "i").agg(F.sum("n").alias("n")).collect()
    out = {}
    for name in sorted({r["lang"] for r in sums}):
        classes, known = np.zeros(len(CLASSES)), sorted(wanted.get(name, {}))
        words = np.zeros(len(known) + 1)
        for r in sums:
            if r["lang"] == name:
                (words if r["kind"] else classes)[r["i"]] = r["n"]
        best = [i for i in np.argsort(-words[:-1], kind="stable")[:COMMON_WORDS] if words[i]]
        counts = np.append(words[best], words.sum() - words[best].sum())
        out[name] = Reference(classes, {known[i]: k for k, i in enumerate(best)}, counts)
    return out


JUDGED = (
    "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, base_failed: boolean, kept: boolean, "
    "class_distance: double, word_distance: double>"
)


def judge(text: str | None, lang: str | None, known: dict[str, Reference]) -> tuple:
    """Base counts and verdict of one text; a text of a language without a reference is held against the nearest one."""
    counts = base_counts(text)
    n_words, repeated = counts[0], counts[4]
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT * n_words
    against = [known[lang]] if lang in known else list(known.values())
    if not text or not against:
        return (*counts, failed, not failed, None, None)
    by_class, by_word, n_letter_words = min((r.distances(text) for r in against), key=lambda d: d[0] + d[1])
    bad = (len(text) >= MIN_CHARS and by_class > MAX_CLASS_DISTANCE) or (n_letter_words >= MIN_LETTER_WORDS and by_word > MAX_WORD_DISTANCE)
    return (*counts, failed, not failed and not bad, by_class, by_word)


def judged(spark, known: dict[str, Reference], text: Column, lang: Column) -> Column:
    shared = spark.sparkContext.broadcast(known)

    @F.pandas_udf(JUDGED)
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
        for texts, langs in batches:
            yield pd.DataFrame([judge(t, name, shared.value) for t, name in zip(texts, langs, strict=True)], columns=names)

    return of(text, lang.cast("string"))


def with_rules(df: DataFrame, text: str = "text", lang: str = "lang", name: str = "rules") -> DataFrame:
    """``df`` with a struct of counts, distances and ``kept``; references come from ``df`` itself.

    Null and empty texts have no words, fail the base rules and have null distances. Rows with a null language are judged by the nearest
    reference. Equal rows get equal verdicts; an empty table gives no rows.
    """
    return df.withColumn(name, judged(df.sparkSession, references(df, text, lang), F.col(text), F.col(lang)))
