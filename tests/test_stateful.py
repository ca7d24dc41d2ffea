"""Bounded intake and the adaptive coefficient against plain Python, under different micro-batches."""

import datetime
import random
from collections import deque

import pytest

from scoreloom.streaming import rollouts as st
from scoreloom.streaming import stateful as sf

EVENTS = "queue string, seq long, kind string, sample long, version long, amount long"


def plain_queue(events, capacity, max_stale):
    queue, now, out = deque(), None, []
    for name, seq, kind, sample, version, amount in events:
        if kind == "version":
            now = version if now is None else max(now, version)
        elif kind == "take":
            for _ in range(min(amount, len(queue))):
                s, v = queue.popleft()
                out.append((name, seq, s, "taken", now - v))
        else:
            now = version if now is None else now
            if max_stale is not None and sum(now - v >= 1 for _, v in queue) >= max_stale:
                out.append((name, seq, sample, "paused", now - version))
                continue
            if len(queue) == capacity:
                s, v = queue.popleft()
                out.append((name, seq, s, "evicted", now - v))
            queue.append((sample, version))
    return out, list(queue)


def batches(spark, path, slices, schema):
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return st.rollout_stream(spark, path, schema, files_per_batch=1)


@pytest.mark.parametrize("max_stale", [None, 3])
def test_intake_against_a_plain_queue(spark, tmp_path, max_stale):
    rng = random.Random(5)
    events, version = [], 0
    for seq in range(300):
        kind = rng.choices(["sample", "take", "version"], [12, 2, 1])[0]
        version += kind == "version"
        events.append(("q", seq, kind, seq if kind == "sample" else None, version - rng.randrange(2) if kind == "sample" else version if kind == "version" else None, 4 if kind == "take" else None))
    # Any cut into batches gives the same decisions; inside a batch the order is that of seq.
    cuts = [events[:1], events[1:140], events[140:170], events[170:]]
    shuffled = [rng.sample(c, len(c)) for c in cuts]
    other = [("other", 0, "take", None, None, 2), ("other", 1, "sample", 7, 3, None), (None, 2, "sample", 8, 1, None), (None, 3, "take", None, None, 9)]
    stream = batches(spark, str(tmp_path / "in"), [[*shuffled[0], *other], *shuffled[1:]], EVENTS)
    sf.run_stateful(sf.bounded_intake(stream, 6, max_stale), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    want, left = plain_queue(events, 6, max_stale)
    got = [(r["queue"], r["seq"], r["sample"], r["action"], r["lag"]) for r in rows if r["queue"] == "q"]
    assert sorted(got) == sorted(want)
    assert ("paused" in {r["action"] for r in rows}) == (max_stale is not None)
    assert all(r["stale"] == (r["lag"] >= 1) for r in rows) and [r["sample"] for r in rows if r["queue"] is None] == [8]
    state = sf.state_rows(spark, str(tmp_path / "checkpoint"), "pending").collect()
    assert sorted(tuple(r["list_element"]) for r in state if r["key"]["queue"] == "q") == sorted(left)


def test_order_of_arrival_decides(spark, tmp_path):
    late_version = [[("q", 1, "sample", 1, 0, None)], [("q", 3, "take", None, None, 1)], [("q", 2, "version", None, 5, None)]]
    early_version = [late_version[0], late_version[2], late_version[1]]
    lags = []
    for name, slices in (("late", late_version), ("early", early_version)):
        stream = batches(spark, str(tmp_path / name), slices, EVENTS)
        sf.run_stateful(sf.bounded_intake(stream, 2), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint"))
        lags.append([r["lag"] for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect()])
    assert lags == [[0], [5]]


STEPS = "name string, seq long, kl double, n double, ts timestamp"


def steps(name, numbers):
    day = datetime.datetime(2024, 1, 1)
    return [(name, i, 5.0 + i % 7, 100.0 + i, day + datetime.timedelta(days=i)) for i in numbers]


def run_steps(spark, path, slices, delay="400 days"):
    stream = batches(spark, f"{path}/in", slices, STEPS)
    sf.run_stateful(sf.adaptive_kl(stream, 0.2, 8.0, 1000.0, delay=delay), f"{path}/out", f"{path}/checkpoint")
    sf.refuse_gaps(spark, f"{path}/checkpoint")
    return {(r["name"], r["seq"]): (r["coef"], r["coef_after"]) for r in spark.read.parquet(f"{path}/out").collect()}


def test_steps_in_any_order(spark, tmp_path):
    rows = steps("a", range(40)) + steps("b", range(9))
    want = {}
    for name in "ab":
        coef = 0.2
        for _, i, kl, n, _ in (r for r in rows if r[0] == name):
            after = coef * (1 + min(max(kl / 8.0 - 1, -0.2), 0.2) * n / 1000.0)
            want[name, i] = (coef, after)
            coef = after
    shuffled = random.Random(2).sample(rows, len(rows))
    assert run_steps(spark, str(tmp_path / "sorted"), [rows]) == want
    assert run_steps(spark, str(tmp_path / "shuffled"), [shuffled[i::4] for i in range(4)]) == want


def test_gaps_and_repeats_are_errors(spark, tmp_path):
    with pytest.raises(RuntimeError, match="without their predecessors"):
        run_steps(spark, str(tmp_path / "end"), [steps("a", [0, 1, 3])])
    # The watermark passes a waiting step: its predecessor did not come in time.
    with pytest.raises(Exception, match="did not come in time"):
        run_steps(spark, str(tmp_path / "late"), [steps("a", [0, 2]), steps("b", [*range(30)]), steps("b", [30])], delay="5 days")
    with pytest.raises(Exception, match="came twice"):
        run_steps(spark, str(tmp_path / "twice"), [steps("a", [0, 1]), steps("a", [1])])
