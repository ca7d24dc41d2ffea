"""Operators with custom state: bounded intake of samples (T1) and the adaptive coefficient over steps in any order (T4).

Both keep what waits in the state store, key by key, and both give the same rows whatever the micro-batches are. A retried batch starts from the
state before it. Their state needs a store that keeps several variables per key; :func:`run_stateful` sets it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scoreloom.streaming.rollouts import run_available

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stateful(stream: DataFrame, out: str, checkpoint: str, **how) -> int:
    """:func:`run_available` with the state store that these operators need; the session's setting is as before afterwards."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return run_available(stream, out, checkpoint, **how)
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def state_rows(spark: SparkSession, checkpoint: str, variable: str, flatten: bool = True) -> DataFrame:
    """What a state variable holds after the last batch: the key and the entries of a list or a map."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    return reader.option("flattenCollectionTypes", str(flatten).lower()).load()


DECISIONS = "queue string, seq long, sample long, action string, lag long, stale boolean, pending long"


class _Intake(StatefulProcessor):
    """One queue. ``pending`` holds samples and their versions, oldest first; it never has more than ``capacity`` entries."""

    def __init__(self, capacity: int, max_stale: int | None):
        self.capacity, self.max_stale = capacity, max_stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", "sample long, version long")
        self.current = handle.getValueState("current", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.current.get()[0] if self.current.exists() else None
        queue = deque(tuple(x) for x in self.pending.get()) if self.pending.exists() else deque()
        stale = sum(1 for _, version in queue if now - version >= 1)
        out = []

        def leave(seq: int, action: str) -> None:
            nonlocal stale
            sample, version = queue.popleft()
            stale -= now - version >= 1
            out.append((key[0], seq, sample, action, now - version, now - version >= 1, len(queue)))

        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for seq, kind, sample, version, amount in events[["seq", "kind", "sample", "version", "amount"]].itertuples(index=False):
            if kind == "version":
                newest = int(version) if now is None else max(now, int(version))
                if newest != now:
                    now = newest
                    stale = sum(1 for _, made in queue if now - made >= 1)
            elif kind == "take":
                for _ in range(min(int(amount), len(queue))):
                    leave(seq, "taken")
            elif kind == "sample":
                # A queue starts with the version of its first sample.
                now = int(version) if now is None else now
                if self.max_stale is not None and stale >= self.max_stale:
                    out.append((key[0], seq, int(sample), "paused", now - int(version), now - int(version) >= 1, len(queue)))
                    continue
                if len(queue) >= self.capacity:
                    leave(seq, "evicted")
                queue.append((int(sample), int(version)))
                stale += now - int(version) >= 1
            else:
                raise ValueError(f"unknown kind of event: {kind}")
        self.pending.put(list(queue)) if queue else self.pending.clear()
        if now is not None:
            self.current.update((now,))
        yield pd.DataFrame(out, columns=["queue", "seq", "sample", "action", "lag", "stale", "pending"])

    def close(self) -> None:
        pass


def bounded_intake(stream: DataFrame, capacity: int, max_stale: int | None = None, queue: str = "queue") -> DataFrame:
    """Decisions of bounded queues (T1), one row per sample that leaves its queue or is not let in.

    ``stream`` holds events in the order they arrive: by batch, and by ``seq`` inside a batch. ``kind`` is ``sample`` (``sample`` made with
    parameter ``version``), ``version`` (the newest version moves to ``version``) or ``take`` (the consumer takes the ``amount`` oldest).
    A sample that comes to a full queue evicts the oldest one. While ``max_stale`` pending samples lag a version or more behind, a sample is ``paused``:
    it is given back at once, to be sent again, so state is bounded by ``capacity``. ``lag`` and ``stale`` are as of the decision. Samples
    still pending are in the state (``state_rows(spark, checkpoint, "pending")``).
    """
    if capacity < 1 or (max_stale is not None and max_stale < 1):
        raise ValueError("capacity and max_stale must be positive")
    events = stream.select(F.col(queue).alias("queue"), "seq", "kind", "sample", "version", "amount")
    return events.groupBy("queue").transformWithStateInPandas(_Intake(capacity, max_stale), DECISIONS, "append", "None")


def intake_events(samples: DataFrame, versions: DataFrame, takes: DataFrame, queue: str = "queue") -> DataFrame:
    """One stream of events from three: ``samples(queue, seq, sample, version)``, ``versions(queue, seq, version)``, ``takes(queue, seq, amount)``."""
    none = F.lit(None).cast("long")

    def shaped(df: DataFrame, kind: str, own: tuple[str, ...]) -> DataFrame:
        rest = [(F.col(c).cast("long") if c in own else none).alias(c) for c in ("sample", "version", "amount")]
        return df.select(F.col(queue).alias("queue"), F.col("seq").cast("long").alias("seq"), F.lit(kind).alias("kind"), *rest)

    return shaped(samples, "sample", ("sample", "version")).unionByName(shaped(versions, "version", ("version",))).unionByName(
        shaped(takes, "take", ("amount",))
    )


COEFFICIENTS = "name string, seq long, coef double, coef_after double"


class _Adaptive(StatefulProcessor):
    """One coefficient: the number of the next step, its value, and the steps that came before their predecessors."""

    def __init__(self, init: float, target: float, horizon: float, first: int):
        self.start, self.target, self.horizon, self.first = init, target, horizon, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "seq long, coef double")
        self.waiting = handle.getMapState("waiting", "seq long", "kl double, n double, ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, coef = self.at.get() if self.at.exists() else (self.first, self.start)
        for frame in rows:
            for number, kl, n, ms in zip(frame["seq"].tolist(), frame["kl"].tolist(), frame["n"].tolist(), frame["ms"].tolist(), strict=True):
                if number < seq or self.waiting.containsKey((number,)):
                    raise ValueError(f"step {number} of {key[0]} came twice")
                self.waiting.updateValue((number,), (kl, n, ms))
                self.handle.registerTimer(ms)
        out = []
        while self.waiting.containsKey((seq,)):
            kl, n, ms = self.waiting.getValue((seq,))
            self.waiting.removeKey((seq,))
            after = coef * (1 + min(max(kl / self.target - 1, -0.2), 0.2) * n / self.horizon)
            out.append((key[0], seq, coef, after))
            seq, coef = seq + 1, after
        self.at.update((seq, coef))
        yield pd.DataFrame(out, columns=["name", "seq", "coef", "coef_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if any(ms <= due for _, _, ms in self.waiting.values()):
            raise RuntimeError(f"step {self.at.get()[0]} of {key[0]} did not come in time")
        yield pd.DataFrame([], columns=["name", "seq", "coef", "coef_after"])

    def close(self) -> None:
        pass


def adaptive_kl(stream: DataFrame, init: float, target: float, horizon: float, ts: str = "ts", delay: str = "0 seconds", first: int = 0) -> DataFrame:
    """Adaptive coefficient as state (T4): every step multiplies it by the clipped error of its KL.

    Input: one row per (``name``, ``seq``) with ``kl``, ``n`` and event time ``ts``; the steps of a name are numbered on from ``first``. Steps may
    arrive in any order: one whose predecessors are missing waits in the state, so the result does not depend on the batches. A step that
    comes twice is an error, and so is a gap that the watermark, ``delay`` behind the newest event, has passed.
    """
    ms = (F.unix_micros(F.col(ts).cast("timestamp")) / 1000).cast("long")
    steps = stream.withWatermark(ts, delay).select(
        "name", F.col("seq").cast("long").alias("seq"), F.col("kl").cast("double").alias("kl"), F.col("n").cast("double").alias("n"), ms.alias("ms"), ts,
    )
    return steps.groupBy("name").transformWithStateInPandas(_Adaptive(init, target, horizon, first), COEFFICIENTS, "append", "EventTime")


def refuse_gaps(spark: SparkSession, checkpoint: str) -> None:
    """An error if steps still wait for a predecessor after the stream has ended."""
    left = state_rows(spark, checkpoint, "waiting").select(F.col("key.*"), F.col("user_map_key.seq").alias("seq")).limit(5).collect()
    if left:
        raise RuntimeError(f"steps without their predecessors: {[tuple(r) for r in left]}")
