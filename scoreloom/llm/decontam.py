"""Benchmark decontamination with a BM25 index of the test items.

Every training text is cut into overlapping passages and every passage queries the index. Scores are BM25 sums of an item's terms that
the passage holds, divided by the sum of all its terms, so that one threshold serves items of any length. Retrieval is block-max WAND over
all passages of a batch at once: a passage's terms are ordered from the longest posting list to the shortest, and the terms before the pivot,
whose best impacts together stay below the threshold, cannot name a candidate alone; the terms from the pivot on name blocks of items; a block
is skipped if the block maxima of all terms cannot reach the threshold; only what is left is scored, and every item at the threshold or above
is given. Every retrieved passage is verified: an item counts as a leak only if the text around one of them holds enough of the item's word
shingles, and enough words of its question and of its answer each.

The index covers one shard of the items; shards are bounded in size, and one is built and broadcast at a time, so what is on the driver and what is
broadcast grow neither with the documents nor with the benchmark. A larger benchmark is a few more passes over the texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import free_name, text_key, written

#: BM25 constants as published.
K1, B = 1.2, 0.75
#: Least share of an item's BM25 sum that retrieves it.
THRESHOLD = 0.65
#: Words of a shingle, the least share of an item's shingles, and the least share of the distinct words of its question and of its answer.
SHINGLE, OVERLAP, WORD_OVERLAP = 5, 0.8, 0.5
#: Words of a passage step; a passage is as many steps as the longest item needs, and one more.
STEP = 32
#: Items per block, the most cells (terms times blocks, four bytes each) of an index shard, and passages times blocks that are searched together.
BLOCK, SHARD_CELLS, SEARCH_CELLS = 8, 8_000_000, 1 << 13
#: Texts that are worked on together: their arrays stay in a core's cache.
TEXTS = 64

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[str, str]:
    """An item without a separate answer: its last sentence is the answer; one sentence is both."""
    parts = _SENTENCE.split(text.strip())
    return (text, text) if len(parts) < 2 else (" ".join(parts[:-1]), parts[-1])


def shingles(words: Sequence[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of ``n`` words; a shorter text is one run."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@dataclass
class Item:
    item_id: int
    n_words: int
    runs: set[tuple[str, ...]]
    question: set[str]
    answer: set[str]


@dataclass
class Index:
    """Postings grouped by term and block. Terms are numbered from the longest posting list to the shortest.

    ``entry[term, block]`` is the number of a group of postings or -1; a group has its best impact, its items and their impacts.
    """

    items: list[Item]
    terms: dict[str, int]
    best: np.ndarray
    entry: np.ndarray
    term_start: np.ndarray
    entry_block: np.ndarray
    entry_best: np.ndarray
    entry_start: np.ndarray
    item: np.ndarray
    impact: np.ndarray


def build_index(rows: Sequence[tuple[int, str, str, bool]], frequency: Counter, n_items: int, mean_words: float) -> Index:
    """Index of ``(item_id, question, answer, one text)``; ``frequency`` and the other numbers describe all items, also those of other shards."""
    items, postings = [], defaultdict(list)
    for number, (item_id, question, answer, joined) in enumerate(rows):
        q, a = words_of(question), words_of(answer)
        words = q if question == answer else q + a
        # The last sentence of a text goes on from the one before; an answer of its own is looked for by itself.
        runs = shingles(words) if joined else shingles(q) | shingles(a)
        items.append(Item(item_id, len(words), runs, set(q), set(a)))
        impact = {}
        for term, tf in Counter(words).items():
            idf = math.log(1 + (n_items - frequency[term] + 0.5) / (frequency[term] + 0.5))
            impact[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_words))
        total = sum(impact.values())
        for term, value in impact.items():
            postings[term].append((number, value / total))
    terms = {t: i for i, t in enumerate(sorted(postings, key=lambda t: (-len(postings[t]), t)))}
    flat = [(i, number // BLOCK, number, value) for t, i in terms.items() for number, value in postings[t]]
    term, block, item = (np.array([r[k] for r in flat], np.int64) for k in range(3))
    impact = np.array([r[3] for r in flat], np.float64)
    change = np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))) if len(flat) else np.empty(0, bool)
    starts = np.flatnonzero(change)
    entry = np.full((len(terms), -(-len(items) // BLOCK)), -1, np.int32)
    entry[term[starts], block[starts]] = np.arange(len(starts))
    # The last entry stands for "none".
    entry_best = np.append(np.maximum.reduceat(impact, starts) if len(flat) else impact, 0.0)
    best = np.array([max(value for _, value in postings[t]) for t in terms])
    term_start = np.searchsorted(term[starts], np.arange(len(terms) + 1))
    return Index(items, terms, best, entry, term_start, block[starts], entry_best, np.append(starts, len(flat)), item, impact)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts in place."""
    values.sort()
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``starts[i], starts[i] + 1, ...`` of all runs, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def block_max_wand(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(passage, item, score)`` of all items whose impacts over a passage's distinct terms sum to ``threshold`` or more.

    ``passage`` and ``term`` are pairs, sorted and distinct.
    """
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(passage):
        return none
    threshold -= 1e-9
    first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    numbers = passage[first]
    counts = np.diff(np.append(first, len(passage)))
    upto = np.cumsum(index.best[term])
    before = np.concatenate(([0.0], upto))[first]
    own = np.repeat(np.arange(len(numbers)), counts)
    pivot = upto - before[own] >= threshold
    if not pivot.any():
        return none
    n_blocks = index.entry.shape[1]
    lists = index.term_start[term[pivot] + 1] - index.term_start[term[pivot]]
    entry = _runs(index.term_start[term[pivot]], lists)
    cell = np.repeat(own[pivot], lists) * n_blocks + index.entry_block[entry]
    # Blocks that terms from the pivot on name: their block maxima, and the best of the terms before it.
    named = np.bincount(cell, weights=index.entry_best[entry], minlength=len(numbers) * n_blocks).reshape(-1, n_blocks)
    rest = np.bincount(own[~pivot], weights=index.best[term[~pivot]], minlength=len(numbers))
    owner, block = np.nonzero((named > 0) & (named + rest[:, None] >= threshold))
    if not len(owner):
        return none
    # Bound of every (passage, block): the block maxima of all terms of the passage.
    lengths = counts[owner]
    group = index.entry[term[_runs(first[owner], lengths)], np.repeat(block, lengths)]
    edges = np.cumsum(lengths) - lengths
    keep = np.add.reduceat(index.entry_best[group], edges) >= threshold
    if not keep.any():
        return none
    kept = np.repeat(np.cumsum(keep) - 1, lengths)[np.repeat(keep, lengths)]
    group = group[np.repeat(keep, lengths)]
    kept, group = kept[group >= 0], group[group >= 0]
    sizes = index.entry_start[group + 1] - index.entry_start[group]
    posting = _runs(index.entry_start[group], sizes)
    cell = np.repeat(kept, sizes) * BLOCK + index.item[posting] % BLOCK
    score = np.bincount(cell, weights=index.impact[posting], minlength=int(keep.sum()) * BLOCK)
    found = np.flatnonzero(score >= threshold)
    return numbers[owner[keep][found // BLOCK]], block[keep][found // BLOCK] * BLOCK + found % BLOCK, score[found]


def leaks(index: Index, texts: Sequence[str | None], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[dict]]:
    """Verified leaks of every text: ``item_id, score, overlap, question_overlap, answer_overlap``, one per item, best verified passage."""
    span = max((i.n_words for i in index.items), default=0)
    steps = -(-span // STEP) + 1
    words, owner, lengths = [], [], []
    for text in texts:
        own = words_of(text)
        lengths.append(len(own))
        words.append(own)
    ids = np.fromiter(map(index.terms.get, chain.from_iterable(words), repeat(-1)), np.int64, sum(lengths))
    n_steps = np.array([max(1, -(-n // STEP)) for n in lengths])
    first = np.concatenate(([0], np.cumsum(n_steps)))[:-1]
    place = np.arange(len(ids)) - np.repeat(np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths)
    step = np.repeat(first, lengths) + place // STEP
    hit = ids >= 0
    n_terms = max(1, len(index.terms))
    at, term = np.divmod(_distinct(step[hit] * n_terms + ids[hit]), n_terms)
    total = int(n_steps.sum())
    owner = np.repeat(np.arange(len(texts)), n_steps)
    end = np.minimum(np.arange(total) + steps, (first + n_steps)[owner])
    out: list[list[dict]] = [[] for _ in texts]
    retrieved: dict[int, dict[int, list[tuple[int, float]]]] = defaultdict(lambda: defaultdict(list))
    together = max(64, min(4096, SEARCH_CELLS // max(1, index.entry.shape[1])))
    for lo in range(0, total, together):
        hi = min(lo + together, total)
        near = slice(*np.searchsorted(at, [lo, end[hi - 1]]))
        pairs = []
        for k in range(steps):
            passage = at[near] - k
            held = (passage >= lo) & (passage < hi)
            held[held] = at[near][held] < end[passage[held]]
            pairs.append(passage[held] * n_terms + term[near][held])
        passage, own_term = np.divmod(_distinct(np.concatenate(pairs)), n_terms)
        for number, item, score in zip(*(x.tolist() for x in block_max_wand(index, passage, own_term, threshold)), strict=True):
            retrieved[int(owner[number])][item].append((number, score))
    for doc, hits in retrieved.items():
        for item, passages in sorted(hits.items()):
            one = index.items[item]
            # The text around a passage, a span to either side.
            around = [
                (max(0, (p - int(first[doc])) * STEP - span), (int(end[p]) - int(first[doc])) * STEP + span, score) for p, score in passages
            ]
            leak = None
            for group in _overlapping(around):
                # A passage holds no more than the stretch it is part of.
                if len(group) > 1 and not _verified(one, words[doc][group[0][0] : group[-1][1]], overlap):
                    continue
                for lo, hi, score in group:
                    if leak is None or score > leak[0]:
                        shares = _verified(one, words[doc][lo:hi], overlap)
                        leak = (score, *shares) if shares else leak
            if leak:
                score, share, q, a = leak
                out[doc].append({
                    "item_id": one.item_id, "score": min(1.0, score), "overlap": share, "question_overlap": q, "answer_overlap": a,
                })
    return out


def _overlapping(around: list[tuple[int, int, float]]) -> list[list[tuple[int, int, float]]]:
    """Stretches of the text: runs of ``around`` (from, to, score), in order, that overlap."""
    out: list[list[tuple[int, int, float]]] = []
    for one in around:
        if out and one[0] < out[-1][-1][1]:
            out[-1].append(one)
        else:
            out.append([one])
    return out


def _verified(item: Item, words: Sequence[str], overlap: float) -> tuple[float, float, float] | None:
    """Shares of the item's shingles, question words and answer words in ``words``, if they are enough for a leak."""
    bag = set(words)
    q, a = (len(x & bag) / len(x) if x else 1.0 for x in (item.question, item.answer))
    if min(q, a) < WORD_OVERLAP:
        return None
    share = shingle_share(item.runs, words)
    return (share, q, a) if share >= overlap else None


def shingle_share(runs: set[tuple[str, ...]], words: Sequence[str]) -> float:
    """Share of ``runs`` that occur in ``words``; runs may have several lengths."""
    held = set().union(*({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in {len(r) for r in runs}))
    return len(runs & held) / len(runs)


HITS = "array<struct<item_id: long, score: double, overlap: double, question_overlap: double, answer_overlap: double>>"


def _split_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for item, body, reply in frame.itertuples(index=False):
            joined = not reply
            question, reply = question_and_answer(body or "") if joined else (body or "", reply)
            rows.append((item, question, reply, joined, words_of(question) if question == reply else words_of(question) + words_of(reply)))
        yield pd.DataFrame(rows, columns=["item_id", "question", "answer", "joined", "words"])


class ItemIndexes(Iterable):
    """Indexes of all items with words, shard by shard: at most about ``shard_cells`` terms times blocks each.

    Shards are cut by a hash of the item; words are counted over all items by aggregates. Only the items of one shard and the counts of
    their words are on the driver at a time. Items that are null, empty or without an id are left out; repeated ones stay.
    """

    def __init__(
        self, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", answer: str | None = None, shard_cells: int = SHARD_CELLS,
    ):
        reply = F.col(answer) if answer else F.lit(None)
        rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("body"), reply.cast("string").alias("reply"))
        split = rows.filter("item_id is not null").mapInPandas(
            _split_items, "item_id long, question string, answer string, joined boolean, words array<string>"
        )
        self.items = written(split.filter(F.size("words") > 0), "items")
        self.number, n_words, n_terms = self.items.agg(
            F.count(F.lit(1)), F.sum(F.size("words")), F.sum(F.size(F.array_distinct("words")))
        ).first()
        self.mean_words = (n_words or 0) / max(1, self.number)
        self.shards = math.ceil(math.sqrt((n_terms or 0) * (self.number / BLOCK) / shard_cells))

    def __iter__(self) -> Iterator[Index]:
        words = F.explode(F.array_distinct("words")).alias("word")
        frequency = self.items.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        own = F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(max(1, self.shards)))
        for shard in range(self.shards):
            part = self.items.filter(own == shard)
            rows = [tuple(r) for r in part.select("item_id", "question", "answer", "joined").orderBy("item_id", "question", "answer").collect()]
            counts = frequency.join(part.select(words).distinct(), "word", "left_semi") if self.shards > 1 else frequency
            if rows:
                yield build_index(rows, Counter({r["word"]: r["n"] for r in counts.collect()}), self.number, self.mean_words)


def leak_column(shared, text: Column, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Column:
    """Leaks of a text column by a broadcast index as ``array<struct<item_id, score, overlap, question_overlap, answer_overlap>>``."""

    @F.pandas_udf(HITS)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.tolist()
            yield pd.Series([x for at in range(0, len(values), TEXTS) for x in leaks(shared.value, values[at : at + TEXTS], threshold, overlap)])

    return found(text)


def with_leaks(
    df: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "leaks", item_id: str = "item_id", item_text: str = "text",
    answer: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_cells: int = SHARD_CELLS,
) -> DataFrame:
    """``df`` with the leaks of each row's text under ``name``, by item id; a column of that name is replaced.

    Null and empty texts have none; a text of any length is searched whole, passage by passage. Items that are null, empty or without an id are left
    out, repeated items are found separately, repeated rows get the same leaks; an empty table stays empty, without items nothing is found.
    An index of one shard is broadcast and the leaks are a column: no shuffle, other columns do not leave the JVM. Of a larger benchmark
    one shard is broadcast at a time: each is a pass over the texts that writes its hits, and the hits are joined back by the hash of the text.
    """
    indexes = ItemIndexes(benchmark, item_id, item_text, answer, shard_cells)
    context = df.sparkSession.sparkContext
    none = F.array().cast(HITS)
    if indexes.shards <= 1:
        one = next(iter(indexes), None)
        return df.withColumn(name, none if one is None else leak_column(context.broadcast(one), F.col(text), threshold, overlap))
    hits = None
    for index in indexes:
        shared = context.broadcast(index)
        found = df.select(text_key(F.col(text)).alias("key"), leak_column(shared, F.col(text), threshold, overlap).alias("leaks"))
        part = written(found.filter(F.size("leaks") > 0).dropDuplicates(["key"]), "leaks")
        shared.unpersist()
        hits = part if hits is None else hits.unionByName(part)
    key, leaks_of = free_name([*df.columns, name], "key"), free_name([*df.columns, name], "hits")
    whole = hits.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias(leaks_of)).withColumnRenamed("key", key)
    joined = df.withColumn(key, text_key(F.col(text))).join(whole, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(leaks_of), none)).drop(key, *([leaks_of] if leaks_of != name else []))
