"""Batching by length and balanced packing (survey rows O1-O5)."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.groups import join_null_safe, lookup_by_group, ranked, running_sum, scalar_row, value_buckets
from scoreloom.operators.joins import POS_BLOCK, pos_bucket, require, with_row_index


def _length_rank(df: DataFrame, keys: list[str], length: str, pos: str, name: str) -> DataFrame:
    """Rank by length, longest first, ties by position; equal lengths are split into position blocks."""
    buckets = {"__lb": -F.col(length), **pos_bucket(pos)}
    return ranked(df, keys, [F.col(length).desc(), F.col(pos)], buckets, name)


def length_batches(df: DataFrame, n: int, length: str = "length", pos: str = "pos", group: str | None = None) -> DataFrame:
    """Longest-first batches of ``n`` rows (O1); ``pos`` stays as the way back to the input order."""
    keys = [group] if group else []
    out = _length_rank(df, keys, length, pos, "__r")
    return out.withColumn("batch", F.floor((F.col("__r") - 1) / n).cast("bigint")).withColumn(
        "slot", ((F.col("__r") - 1) % n).cast("bigint")).drop("__r")


def restore_order(df: DataFrame, pos: str = "pos") -> DataFrame:
    return df.orderBy(pos)


BLOCKS_PER_RUN = 256


def budget_chunks(df: DataFrame, cap: int, cost: str = "n_images", pos: str = "pos", block: int = POS_BLOCK) -> DataFrame:
    """Exact sequential chunking (O2): a new chunk starts when the running cost would exceed ``cap``.

    The running cost makes every row depend on all rows before it. A block of rows, however, is a map from the state on
    entry (no chunk yet, or a running cost from 0 to just over ``cap``) to the state on exit, so blocks are summarised in parallel,
    ``BLOCKS_PER_RUN`` summaries compose to one, the runs are chained, and every block is then replayed from its known entry state. The
    chained table holds one row of ``cap + 3`` numbers for ``block * BLOCKS_PER_RUN`` positions, nearly 17 million by default.
    """
    tagged = df.withColumn("__blk", F.floor(F.col(pos) / block).cast("bigint"))
    states = cap + 3

    def advance(costs, load, open_, count):
        for c in costs:
            flush = open_ & (load + c > cap)
            count = count + flush
            load = np.minimum(np.where(flush, 0, load) + c, cap + 1)
            open_ = np.ones_like(open_)
        return load, open_, count

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        costs = pdf.sort_values(pos)[cost].to_numpy()
        load = np.concatenate(([0], np.arange(cap + 2)))
        open_ = np.concatenate(([False], np.ones(cap + 2, dtype=bool)))
        load, open_, count = advance(costs, load, open_, np.zeros(states, dtype=np.int64))
        return pd.DataFrame({"__blk": [pdf["__blk"].iloc[0]], "exit": [(load + 1).astype(np.int32)], "flushes": [count]})

    maps = tagged.select("__blk", pos, cost).groupBy("__blk").applyInPandas(
        summarise, "__blk bigint, exit array<int>, flushes array<bigint>"
    )

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        state, count = np.arange(states), np.zeros(states, dtype=np.int64)
        for exits, flushes in pdf.sort_values("__blk")[["exit", "flushes"]].itertuples(index=False):
            count, state = count + np.asarray(flushes)[state], np.asarray(exits)[state]
        return pd.DataFrame({"__sup": [pdf["__sup"].iloc[0]], "exit": [state.astype(np.int32)], "flushes": [count]})

    def chain(pdf: pd.DataFrame, order: str, state: int, chunk: int) -> pd.DataFrame:
        rows = []
        for at, exits, flushes in pdf.sort_values(order)[[order, "exit", "flushes"]].itertuples(index=False):
            rows.append((at, state, chunk))
            chunk += int(flushes[state])
            state = int(exits[state])
        return pd.DataFrame(rows, columns=[order, "__state", "__chunk"])

    maps = maps.withColumn("__sup", F.floor(F.col("__blk") / BLOCKS_PER_RUN))
    runs = maps.groupBy("__sup").applyInPandas(compose, "__sup bigint, exit array<int>, flushes array<bigint>")
    starts = runs.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(
        lambda pdf: chain(pdf, "__sup", 0, 0), "__sup bigint, __state int, __chunk bigint"
    )
    entries = maps.join(starts, "__sup").groupBy("__sup").applyInPandas(
        lambda pdf: chain(pdf, "__blk", int(pdf["__state"].iloc[0]), int(pdf["__chunk"].iloc[0])), "__blk bigint, __state int, __chunk bigint"
    )

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        state, chunk = int(pdf["__state"].iloc[0]), int(pdf["__chunk"].iloc[0])
        load, open_, ids = max(state - 1, 0), state > 0, []
        for c in pdf[cost].to_numpy():
            if open_ and load + c > cap:
                chunk, load = chunk + 1, 0
            load, open_ = min(load + c, cap + 1), True
            ids.append(chunk)
        return pd.DataFrame({pos: pdf[pos].to_numpy(), "chunk": ids})

    plan = tagged.select("__blk", pos, cost).join(entries, "__blk")
    pos_type = df.schema[pos].dataType.simpleString()
    ids = plan.groupBy("__blk").applyInPandas(replay, f"{pos} {pos_type}, chunk bigint")
    return df.join(ids, pos)


def budget_chunks_floor(df: DataFrame, cap: int, cost: str = "n_images", pos: str = "pos") -> DataFrame:
    """Cheap variant of O2: the chunk is the running cost before the row, divided by ``cap``."""
    out = running_sum(df, [], [F.col(pos)], F.col(cost), pos_bucket(pos), "__run")
    return out.withColumn("chunk", F.floor((F.col("__run") - F.col(cost)) / cap).cast("bigint")).drop("__run")


def workload(length: Column) -> Column:
    """Relative compute of a sequence: linear plus quadratic part."""
    n = length.cast("bigint")
    return n * 24576 + n * n


def _snake(rank: Column, k: Column) -> Column:
    """Group of the rank-th item (from 1) when items are dealt back and forth over ``k`` groups."""
    turn, seat = F.floor((rank - 1) / k), (rank - 1) % k
    return F.when(turn % 2 == 0, seat).otherwise(k - 1 - seat).cast("bigint")


def greedy_shares(loads: Sequence[int], counts: Sequence[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """How many items of each load go to each of ``k`` groups when items, largest first, each go to the group with the least load (ties: the first).

    Equal items are dealt at once: below a common level every group is filled up in one step, and only what is left, less than an item a
    group, is dealt one by one. ``equal_size``: a group with fewer items comes first, so sizes differ by at most one.
    """
    bias = sum(w * c for w, c in zip(loads, counts, strict=True)) + 1 if equal_size else 0
    sums, out = [0] * k, []
    for load, count in sorted(zip(loads, counts, strict=True), reverse=True):
        weight, share, left = load + bias, [0] * k, count
        if count > k and weight > 0:
            # The level that the groups would reach if items were divisible; groups above it get none.
            order, total, level = sorted(sums), 0, None
            for m, low in enumerate(order, 1):
                total += low
                level = (count * weight + total) // m
                if m == k or level <= order[m]:
                    break
            share = [max(0, (level - s) // weight) for s in sums]
            left -= sum(share)
        heap = [(s + n * weight, g) for g, (s, n) in enumerate(zip(sums, share, strict=True))]
        heapq.heapify(heap)
        for _ in range(left):
            s, g = heap[0]
            share[g] += 1
            heapq.heapreplace(heap, (s + weight, g))
        sums = [s + n * weight for s, n in zip(sums, share, strict=True)]
        out.append(share)
    return out


def balance(df: DataFrame, k: int, length: str = "length", pos: str = "pos", equal_size: bool = False) -> DataFrame:
    """Balanced groups (O3): rows, largest workload first, go to the group with the least of it.

    The plan is made on the histogram of lengths, one row per distinct length, in one task; rows of a length are then dealt by their position, the
    first ones to group 0. ``equal_size`` gives every group the same number of rows, an error if they do not divide. A null length counts as 0.
    """
    known = F.coalesce(F.col(length), F.lit(0)).cast("bigint")
    keyed = df.withColumn("__length", known)
    histogram = keyed.groupBy("__length").agg(F.count(F.lit(1)).alias("__size"), F.first(workload(F.col("__length"))).alias("__load"))
    if equal_size:
        total = scalar_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
        fits = F.when(total % k == 0, F.lit(True)).otherwise(F.raise_error(F.lit("rows do not divide into equal groups")).cast("boolean"))
        histogram = histogram.filter(fits)

    def planned(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__load", ascending=False, kind="stable")
        shares = greedy_shares(pdf["__load"].tolist(), pdf["__size"].tolist(), k, equal_size)
        return pd.DataFrame({"__length": pdf["__length"], "__size": pdf["__size"], "__ends": [np.cumsum(x) for x in shares]})

    plan = histogram.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(planned, "__length bigint, __size bigint, __ends array<bigint>")
    ordered = ranked(keyed, ["__length"], [F.col(pos)], pos_bucket(pos), "__r")
    placed = lookup_by_group(ordered, plan, ["__length"], "__size", "inner")
    group = F.size(F.filter("__ends", lambda e: e < F.col("__r"))).cast("bigint")
    return placed.withColumn("group", group).drop("__length", "__size", "__ends", "__r")


def balance_by_uid(df: DataFrame, k: int, uid: str = "uid", length: str = "length", pos: str = "pos") -> DataFrame:
    """Balanced groups that keep the rows of one uid together (O3)."""
    per = df.groupBy(uid).agg(
        F.sum(workload(F.col(length))).alias("__load"), F.min(pos).alias("__first"), F.count(F.lit(1)).alias("__size")
    )
    order = ranked(per, [], [F.col("__load").desc(), F.col("__first")], value_buckets(-F.col("__load")), "__r")
    side = order.withColumn("group", _snake(F.col("__r"), F.lit(k))).select(uid, "__size", "group")
    return lookup_by_group(df, side, [uid], "__size", "inner").drop("__size")


def imbalance(balanced: DataFrame, k: int, length: str = "length", pos: str = "pos") -> DataFrame:
    """Spread of token sums before (consecutive blocks of rows) and after balancing (O3)."""
    rows = with_row_index(balanced, pos, "__row")
    total = scalar_row(balanced.agg(F.count(F.lit(1)).alias("n")))["n"]
    rows = rows.withColumn("__blk", F.floor(F.col("__row") / F.floor(total / k)).cast("bigint"))
    before = rows.groupBy("__blk").agg(F.sum(length).alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("s").alias("t"))
    after = balanced.groupBy("group").agg(F.sum(length).alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    b = before.withColumn("__a", scalar_row(after))
    return b.select(
        F.col("lo").alias("min"), F.col("hi").alias("max"), (F.col("hi") - F.col("lo")).alias("minmax_diff"),
        F.col("__a.lo").alias("balanced_min"), F.col("__a.hi").alias("balanced_max"), (F.col("t") / k).alias("mean"),
    )


def micro_batches(
    df: DataFrame, max_len: int, length: str = "length", pos: str = "pos", multiple_of: int = 1, at_least: int = 1
) -> DataFrame:
    """Token-bounded micro-batches (O4): as many as the total needs, balanced, small ones at both ends.

    Adds ``micro`` (its place in the order) and ``offset``, the packed start of the row inside it. A row longer than ``max_len``, or more
    batches than rows, is an error.
    """
    fits = F.coalesce(F.col(length) <= max_len, F.lit(True))
    df = require(df, fits, f"a row is longer than a micro-batch of {max_len}")
    totals = scalar_row(df.agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("t")))
    count = F.greatest(F.least(totals["n"], F.ceil(totals["t"] / max_len)), F.lit(at_least))
    count = F.ceil(count / multiple_of) * multiple_of
    count = F.when(count <= totals["n"], count).otherwise(F.raise_error(F.lit("more micro-batches than rows")).cast("bigint"))
    out = _length_rank(df, [], length, pos, "__r").withColumn("__k", count)
    out = out.withColumn("__g", _snake(F.col("__r"), F.col("__k")))
    groups = out.groupBy("__g", "__k").agg(F.sum(workload(F.col(length))).alias("__load"), F.min(pos).alias("__first"))
    order = ranked(groups, [], [F.col("__load").desc(), F.col("__first").desc()], value_buckets(-F.col("__load")), "__rank")
    r, half = F.col("__rank") - 1, F.ceil(F.col("__k") / 2)
    slot = F.when(r % 2 == 0, half - 1 - r / 2).otherwise(half + (r - 1) / 2).cast("bigint")
    out = join_null_safe(out.drop("__k"), order.select("__g", slot.alias("micro")), ["__g"], "inner")
    w = Window.partitionBy("micro").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("offset", F.coalesce(F.sum(length).over(w), F.lit(0))).drop("__r", "__g")


def token_windows(
    df: DataFrame, max_len: int, context: int, tokens: str = "tokens", prefix: Column | None = None, disjoint: bool = False
) -> DataFrame:
    """Rolling windows over token arrays (O5): ``input`` conditions ``target``; every token is a target exactly once.

    ``disjoint`` cuts the part of the input that overlaps the targets.
    """
    if not 1 <= context <= max_len:
        raise ValueError("context must be between 1 and the window length")
    t, n = F.col(tokens), F.size(tokens)
    step = max_len - context + 1
    first = F.least(n, F.lit(max_len))
    windows = F.when(n > 0, F.sequence(F.lit(0), F.ceil((n - first) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("window", F.explode(windows))
    w = F.col("window")
    done = F.when(w == 0, F.lit(0)).otherwise(first + (w - 1) * step)
    end = F.when(w == 0, first).otherwise(F.least(n, first + w * step))
    begin = F.when(w == 0, F.lit(0)).otherwise(end - max_len - 1)
    head = F.array(prefix if prefix is not None else F.lit(0).cast(df.schema[tokens].dataType.elementType))
    body = F.slice(t, F.greatest(begin, F.lit(0)) + 1, F.greatest(end - 1 - F.greatest(begin, F.lit(0)), F.lit(0)))
    inp = F.when(w == 0, F.concat(head, body)).otherwise(body)
    target = F.slice(t, done + 1, end - done)
    out = out.withColumn("input", inp).withColumn("target", target)
    if disjoint:
        keep = F.size("input") - (F.size("target") - 1)
        out = out.withColumn("input", F.slice("input", F.lit(1), F.greatest(keep, F.lit(0))))
    return out
