"""Streaming queries: T1-T4, each run to completion over the given events and read back from its sink."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.operators import prep as pp
from scoreloom.plans.catalog import register, table
from scoreloom.plans.fixtures import ROLLOUT_SQL, rollouts
from scoreloom.session import scratch_path
from scoreloom.streaming import rollouts as st
from scoreloom.streaming import stateful as sf_


def _replayed(spark, df, order, files=4):
    path = st.replay_files(df, order, files)
    return st.rollout_stream(spark, path, spark.read.parquet(path).schema)


@register("t1_ingest_rollouts", "data_source:s lag:l samples:l stale_samples:l", f"""
WITH {ROLLOUT_SQL}, x AS (SELECT data_source, (SELECT max(step) FROM rollouts) - step AS lag FROM rollouts)
SELECT data_source, lag, count(*) AS samples, sum(CASE WHEN lag >= 1 THEN 1 ELSE 0 END) AS stale_samples FROM x WHERE lag <= 20 GROUP BY ALL""")
def _t1(spark, sf):
    r = rollouts(spark, sf).select("pos", "data_source", F.col("step").alias("param_version"))
    current = r.agg(F.max("param_version").alias("version"))
    stream = st.ingest_rollouts(_replayed(spark, r, "pos"), current, max_lag=20)
    out = scratch_path(spark, "ingest")
    st.run_available(stream, out, scratch_path(spark, "ingest-checkpoint"))
    return st.stale_counts(spark.read.parquet(out), keys=("data_source", "lag"))


@register("t1_bounded_intake", "data_source:s action:l samples:l stale:l lag:l", f"""
WITH RECURSIVE {ROLLOUT_SQL},
ev AS (
  SELECT data_source, 4 * min(pos) + 1 AS seq, 1 AS kind, step AS v, 0 AS amount FROM rollouts GROUP BY data_source, step
  UNION ALL SELECT data_source, 4 * pos + 2, 2, step - pos % 3, 0 FROM rollouts
  UNION ALL SELECT data_source, 4 * pos + 3, 3, 0, 12 FROM rollouts WHERE pos % 16 = 15),
o AS (SELECT *, row_number() OVER (PARTITION BY data_source ORDER BY seq) AS i FROM ev),
-- One row per event: the queue of versions before it, the newest version, and what the event did.
f AS (
  SELECT i, data_source, kind, v, amount, CAST([] AS BIGINT[]) AS q, v AS now FROM o WHERE i = 1
  UNION ALL
  SELECT o.i, o.data_source, o.kind, o.v, o.amount,
    CASE WHEN f.kind = 3 THEN f.q[f.amount + 1:]
         WHEN f.kind = 2 AND len(list_filter(f.q, lambda x: f.now - x >= 1)) < 6
         THEN list_append(CASE WHEN len(f.q) >= 20 THEN f.q[2:] ELSE f.q END, f.v)
         ELSE f.q END,
    CASE WHEN f.kind = 1 THEN greatest(f.now, f.v) ELSE f.now END
  FROM f JOIN o ON o.i = f.i + 1 AND o.data_source = f.data_source),
d AS (
  SELECT data_source, 1 AS action, now - unnest(q[:amount]) AS lag FROM f WHERE kind = 3
  UNION ALL SELECT data_source, 2, now - q[1] FROM f WHERE kind = 2 AND len(list_filter(q, lambda x: now - x >= 1)) < 6 AND len(q) >= 20
  UNION ALL SELECT data_source, 3, now - v FROM f WHERE kind = 2 AND len(list_filter(q, lambda x: now - x >= 1)) >= 6)
SELECT data_source, action, count(*) AS samples, count(*) FILTER (lag >= 1) AS stale, sum(lag) AS lag FROM d GROUP BY ALL""")
def _t1b(spark, sf):
    # Every event is a sample made with a version up to two days old; a day's first event moves the version, every sixteenth takes twelve.
    r = rollouts(spark, sf)
    samples = r.select(F.col("data_source").alias("queue"), (4 * F.col("pos") + 2).alias("seq"), F.col("pos").alias("sample"), (F.col("step") - F.col("pos") % 3).alias("version"))
    versions = r.groupBy(F.col("data_source").alias("queue"), F.col("step").alias("version")).agg((4 * F.min("pos") + 1).alias("seq"))
    takes = r.filter("pos % 16 = 15").select(F.col("data_source").alias("queue"), (4 * F.col("pos") + 3).alias("seq"), F.lit(12).alias("amount"))
    # All events of a queue in a slice lie in one file, and slices are consumed in order.
    path = st.replay_files(sf_.intake_events(samples, versions, takes), "seq", 4, together="queue")
    stream = st.rollout_stream(spark, path, spark.read.parquet(path).schema)
    out = scratch_path(spark, "intake")
    sf_.run_stateful(sf_.bounded_intake(stream, 20, 6), out, scratch_path(spark, "intake-checkpoint"))
    action = F.element_at(F.create_map(*[F.lit(x) for x in ("taken", 1, "evicted", 2, "paused", 3)]), F.col("action"))
    return spark.read.parquet(out).groupBy(F.col("queue").alias("data_source"), action.alias("action")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("stale").cast("long")).alias("stale"), F.sum("lag").alias("lag"))


@register("t2_stream_metrics", "step:l name:s mean:d weighted_mean:d min:d max:d last:d n:l", f"""
WITH {ROLLOUT_SQL} SELECT step, data_source AS name, avg(score) AS mean, sum(score * length) / sum(length) AS weighted_mean, min(score) AS min, max(score) AS max, arg_max(score, ts) AS last, count(*) AS n
FROM rollouts GROUP BY step, data_source""")
def _t2(spark, sf):
    r = rollouts(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"), "step", F.col("data_source").alias("name"), F.col("score").alias("value"), F.col("length").alias("samples"))
    stream = st.stream_metrics(_replayed(spark, r, "ts"))
    out = scratch_path(spark, "metrics")
    st.run_available(stream, out, scratch_path(spark, "metrics-checkpoint"), mode="update")
    m = st.latest_emits(spark, out, ["w", "step", "name"])
    per = m.groupBy("step", "name").agg(
        F.sum("sum").alias("s"), F.sum("n").alias("n"), F.sum("weighted").alias("ws"), F.sum("samples").alias("w"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.max_by("last", "w").alias("last"))
    return per.select("step", "name", (F.col("s") / F.col("n")).alias("mean"), (F.col("ws") / F.col("w")).alias("weighted_mean"), "min", "max", "last", "n")


class _Copies:
    """Two copies of every turn, and the number of turns the conversation has had in its batch."""

    def __init__(self):
        self.turns = 0

    def eval(self, row):
        self.turns += 1
        for copy in (0, 1):
            yield row["conv_id"], row["turn"], copy, row["text"], self.turns


@register("t3_grow_dataset", "conv_id:l turn:l copy:l text:s nth:l", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations)
SELECT conv_id, turn, c AS copy, text, nth FROM t, range(0, 2) r(c) WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 60""")
def _t3(spark, sf):
    c = table(spark, sf, "conversations")
    out = scratch_path(spark, "grown")
    # A conversation lies in one file, so in one batch.
    path = st.replay_files(c, "conv_id", 3, together="conv_id")
    stream = st.rollout_stream(spark, path, spark.read.parquet(path).schema)
    generate = st.table_generator(_Copies, "conv_id bigint, turn bigint, copy int, text string, nth int", ["conv_id"], ["turn"])
    st.grow(stream, out, scratch_path(spark, "grown-checkpoint"), generate, pp.token_count(F.col("text")), 60)
    return spark.read.parquet(out).select("conv_id", "turn", "copy", "text", "nth")


@register("t4_adaptive_kl", "name:s step:l coef:d coef_after:d", f"""
WITH RECURSIVE {ROLLOUT_SQL}, s AS (SELECT data_source AS name, step, avg(score) AS kl, count(*) AS n, row_number() OVER (PARTITION BY data_source ORDER BY step) AS i FROM rollouts GROUP BY data_source, step),
f AS (SELECT i, name, step, 0.2::DOUBLE AS coef, 0.2::DOUBLE * (1 + greatest(least(kl / 10.0::DOUBLE - 1, 0.2), -0.2) * n / 10000.0) AS coef_after FROM s WHERE i = 1
  UNION ALL SELECT s.i, s.name, s.step, f.coef_after, f.coef_after * (1 + greatest(least(kl / 10.0::DOUBLE - 1, 0.2), -0.2) * n / 10000.0) FROM s JOIN f ON s.i = f.i + 1 AND s.name = f.name)
SELECT name, step, coef, coef_after FROM f""")
def _t4(spark, sf):
    steps = rollouts(spark, sf).groupBy(F.col("data_source").alias("name"), "step").agg(
        F.avg("score").alias("kl"), F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp").alias("ts"))
    # A name has a step per day. The days that occur are numbered on, and the rows arrive in an order that has nothing to do with them.
    numbered = steps.withColumn("seq", F.row_number().over(Window.partitionBy("name").orderBy("step")) - 1)
    path = st.replay_files(numbered.withColumn("shuffled", F.xxhash64("name", "seq")), "shuffled", 4)
    stream = st.rollout_stream(spark, path, spark.read.parquet(path).schema)
    out, checkpoint = scratch_path(spark, "kl"), scratch_path(spark, "kl-checkpoint")
    sf_.run_stateful(sf_.adaptive_kl(stream, 0.2, 10.0, 10000.0, delay="60 days"), out, checkpoint)
    sf_.refuse_gaps(spark, checkpoint)
    return spark.read.parquet(out).join(numbered.select("name", "seq", "step"), ["name", "seq"]).select("name", "step", "coef", "coef_after")
