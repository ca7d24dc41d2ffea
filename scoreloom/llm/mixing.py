"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times. The whole part is taken at once; the fractions are rounded
dependently: fractional documents meet, and mass moves at random from one to the other until one of them is whole. A move keeps
``copies * size`` of the two, so a source's taken words stay at its target up to the one fraction that is left over at the end, and its
chances keep every document's expected copies. Long documents are settled first, so what is left over is short.

The meetings form a tree. Hash buckets of a source are reduced by separate tasks to one fraction each, then these by 64s, and so on.
Bucket and random numbers are functions of the data, so a lost task or a rerun repeats them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import WORD, free_name, text_key, with_keys, written

#: Fixed values of the mix contract: weights by rank of the source, and the most copies of a document.
WEIGHTS, CAP = (5, 2, 1), 3.0
#: Documents a bucket should hold, and fractions that meet in one group of a higher level.
BUCKET_ROWS, FAN_IN = 1024, 64

_TREE = "source string, bucket long, h long, doc_id long, key long, size long, copies long, p double"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Words each source should give. Sources sorted by code point, null last, have ``weights`` in turn and share the sum of all sizes;
    no target goes above ``cap`` times its source's size, and what is cut off is shared again by weight.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, left, targets = float(sum(sizes.values())), list(order), {}
    while left:
        total = sum(weight[s] for s in left)
        full = [s for s in left if rest * weight[s] / total > cap * sizes[s]]
        if not full:
            targets |= {s: rest * weight[s] / total for s in left}
            break
        for s in full:
            targets[s] = cap * sizes[s]
        rest -= sum(targets[s] for s in full)
        left = [s for s in left if s not in full]
    return targets


def _uniform(h: int) -> float:
    """A number in [0, 1) from a hash, by the finaliser of SplitMix64."""
    z = (h + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((z ^ (z >> 31)) >> 11) / float(1 << 53)


def pivotal(p: Sequence[float], size: Sequence[int], draws: Sequence[float]) -> np.ndarray:
    """Round the fractions ``p`` so that ``sum(p * size)`` stays; at most one is left fractional.

    Documents are taken from the longest to the shortest. As long as the shorter ones can take or give its words, a document meets all of them
    as one party: it goes up with its own chance ``p`` and they go down by shares, or the other way round, so every expectation stays and the
    long document is whole after one draw. The last ones, where that is no longer so, meet in pairs. Fractions of size zero become zero.
    """
    p, size, draws = np.array(p, float), np.asarray(size, float), np.asarray(draws, float)
    p[size <= 0] = 0.0
    order = np.argsort(-size, kind="stable")
    order = order[(p[order] > 0) & (p[order] < 1)]
    for k, i in enumerate(order):
        if not 0 < p[i] < 1:
            continue
        rest = order[k + 1 :]
        q = p[rest]
        share = np.minimum(q / (1 - p[i]), (1 - q) / p[i])
        room = float(share @ size[rest])
        if room <= size[i]:
            _pairs(p, size, draws, order[k:])
            break
        share *= size[i] / room
        up = draws[i] < p[i]
        q = q - (1 - p[i]) * share if up else q + p[i] * share
        q[q < 1e-12] = 0.0
        q[q > 1 - 1e-12] = 1.0
        p[rest], p[i] = q, float(up)
    return p


def _pairs(p: np.ndarray, size: np.ndarray, draws: np.ndarray, order: np.ndarray) -> None:
    """The fraction in hand (a) meets the next one (b). Raising a by ``x / size_a`` and lowering b by ``x / size_b`` goes on until one is whole;
    the two directions are drawn so that the expected change is zero.
    """
    a = -1
    for b in order.tolist():
        if not 0.0 < p[b] < 1.0:
            continue
        if a < 0:
            a = b
            continue
        up, down = min((1 - p[a]) * size[a], p[b] * size[b]), min(p[a] * size[a], (1 - p[b]) * size[b])
        if draws[b] * (up + down) < down:
            a_whole, b_whole = (1 - p[a]) * size[a] <= up, p[b] * size[b] <= up
            p[a], p[b] = 1.0 if a_whole else p[a] + up / size[a], 0.0 if b_whole else p[b] - up / size[b]
        else:
            a_whole, b_whole = p[a] * size[a] <= down, (1 - p[b]) * size[b] <= down
            p[a], p[b] = 0.0 if a_whole else p[a] - down / size[a], 1.0 if b_whole else p[b] + down / size[b]
        if 0.0 < p[b] < 1.0:
            a = b
        elif not 0.0 < p[a] < 1.0:
            a = -1


def _reduced(batches: Iterator[pd.DataFrame], level: int) -> Iterator[pd.DataFrame]:
    """Round sorted rows group by group (source, bucket); a group that runs over the end of a batch waits for the next."""
    held: pd.DataFrame | None = None

    def rounded(rows: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
        p, size = rows["p"].to_numpy(copy=True), rows["size"].to_numpy()
        draws = np.array([_uniform(int(x) + level * 0xD1B54A32D192ED03) for x in rows["h"]])
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            p[s:e] = pivotal(p[s:e], size[s:e], draws[s:e])
        return rows.assign(p=p)

    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        if rows.empty:
            continue
        source, bucket = rows["source"].fillna("\0").to_numpy(), rows["bucket"].to_numpy()
        bounds = [0, *(np.flatnonzero((source[1:] != source[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist()]
        held = rows.iloc[bounds[-1] :]
        yield rounded(rows.iloc[: bounds[-1]], bounds)
    if held is not None:
        yield rounded(held, [0, len(held)])


def copies(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None,
    weights: Sequence[float] = WEIGHTS, cap: float = CAP, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, key`` (hash of the text), ``source, size, source_size, target, copies``.

    Null texts have size zero and are taken zero times. A null source is a source of its own. Repeated rows are separate rows and may get
    different copies. Source names and sizes are metadata and pass through the driver. An empty table gives no rows.
    """
    rows = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("key"), F.col(source).cast("string").alias("source"),
        (word_count(F.col(text)) if size is None else size.cast("long")).alias("size"),
    )
    rows = written(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    targets = source_targets({r["source"]: r["n"] for r in totals}, weights, cap)
    plan = rows.sparkSession.createDataFrame(
        [(r["source"], r["n"], float(targets[r["source"]]), max(1, math.ceil(r["rows"] / bucket_rows))) for r in totals],
        "src string, source_size long, target double, buckets long",
    )
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("long")
    h = F.xxhash64(F.lit(10), F.col("doc_id"), F.col("key"))
    start = joined.select(
        "source", F.pmod(F.xxhash64(F.lit(11), h), F.col("buckets")).alias("bucket"), h.alias("h"), "doc_id", "key", "size",
        whole.alias("copies"), F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0).alias("p"),
    )
    widest = max((math.ceil(r["rows"] / bucket_rows) for r in totals), default=1)
    done, level, depth = None, start, 0
    while True:
        placed = level.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "h", "doc_id", "key")
        reduced = written(placed.mapInPandas(lambda it, depth=depth: _reduced(it, depth), _TREE), "mix")
        fraction = (F.col("p") > 0) & (F.col("p") < 1)
        whole_now = reduced.filter(~fraction)
        done = whole_now if done is None else done.unionByName(whole_now)
        if widest <= 1:
            # What is left over, at most one document of a source, is drawn with its own chance.
            last = reduced.filter(fraction).withColumn("p", (F.pmod(F.xxhash64(F.lit(12), "h"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("p")).cast("double"))
            done = done.unionByName(last)
            break
        level = reduced.filter(fraction).withColumn("bucket", F.floor(F.col("bucket") / fan_in))
        widest, depth = math.ceil(widest / fan_in), depth + 1
    return done.join(plan, F.col("source").eqNullSafe(F.col("src"))).select(
        "doc_id", "key", "source", "size", "source_size", "target", (F.col("copies") + F.col("p").cast("long")).alias("copies"),
    )


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it. Extra columns of any name are carried through; an empty table stays empty."""
    decided = copies(df, doc_id, text, source, **how)
    times, rows = free_name(df, "__copies"), free_name(df, "__rows")
    per_key = decided.groupBy("doc_id", "key", "source").agg(F.sum("copies").alias(times), F.count(F.lit(1)).alias(rows))
    stem, rank = free_name(df, "__key"), free_name(df, "__rank")
    keyed, names = with_keys(df, stem, [F.col(doc_id).cast("long"), text_key(F.col(text)), F.col(source).cast("string")])
    shares, _ = with_keys(per_key, stem, [F.col("doc_id"), F.col("key"), F.col("source")])
    joined = keyed.join(shares.select(*names, times, rows), names)
    # Repeated rows share their copies out: the first rows of a key get one more where they do not divide evenly.
    nth = Window.partitionBy(*names).orderBy(names[0])
    shared = joined.withColumn(rank, F.row_number().over(nth))
    own = F.floor(F.col(times) / F.col(rows)) + (F.col(rank) <= F.col(times) % F.col(rows)).cast("long")
    repeats = F.when(own > 0, F.array_repeat(F.lit(0), own.cast("int")))
    return shared.withColumn(rank, F.explode(repeats)).select(*df.columns)


def mix_report(decided: DataFrame) -> DataFrame:
    """Per source: documents, words, target and words taken."""
    return decided.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum(F.col("copies") * F.col("size")).alias("taken"),
    )
