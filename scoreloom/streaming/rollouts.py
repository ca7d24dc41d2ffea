"""Structured Streaming forms of the step-wise consumers (survey rows T1-T3; those with a state of their own are in ``stateful``).

Every sink writes the rows of a micro-batch into a folder named after the batch and overwrites it on a retry, so a batch that is
run again after a lost executor leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.session import scratch_path


def rollout_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int = 8) -> DataFrame:
    """Files of rollouts as a stream; the file limit is the intake limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def batch_folder_sink(out: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch writer into ``out/batch_id=N``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if transform is None else transform(batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", transform=None, may_drop_late: bool = False) -> int:
    """Process everything that is there and stop; gives the number of rows that came later than the watermark allows.

    Late rows are not in the result, so they are an error unless ``may_drop_late``.
    """
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(batch_folder_sink(out, transform)).start()
    )
    query.awaitTermination()
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    if late and not may_drop_late:
        raise RuntimeError(f"{late} rows are later than the watermark allows")
    return late


def ingest_rollouts(
    stream: DataFrame, current: DataFrame, version: str = "param_version", max_lag: int | None = None
) -> DataFrame:
    """Version lag of every sample (T1) by a stream-static join with the newest ``version`` of ``current``, one row.

    A sample is stale from lag 1 on and still used; ``max_lag`` drops samples that lag further behind.
    """
    now = F.broadcast(current.agg(F.max("version").alias("__now")).withColumn("__one", F.lit(1)))
    out = stream.withColumn("__one", F.lit(1)).join(now, "__one").drop("__one")
    out = out.withColumn("lag", F.col("__now") - F.col(version)).withColumn("stale", F.col("lag") >= 1).drop("__now")
    return out if max_lag is None else out.filter(F.col("lag") <= max_lag)


def stale_counts(rows: DataFrame, end_version: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("stale").cast("long")).alias("stale_samples"), F.max("lag").alias("max_lag"))


def stream_metrics(
    stream: DataFrame, ts: str = "ts", step: str = "step", name: str = "name", value: str = "value", samples: str = "samples",
    window: str = "1 day", watermark: str = "2 days",
) -> DataFrame:
    """Mergeable step metrics per tumbling window (T2): sums, sample-weighted sums, extremes and the last value."""
    v, w = F.col(value), F.col(samples)
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window).alias("w"), F.col(step), F.col(name))
        .agg(
            F.sum(v).alias("sum"), F.count(v).alias("n"), F.sum(v * w).alias("weighted"), F.sum(w).alias("samples"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.max_by(v, F.col(ts)).alias("last"),
        )
    )


def latest_emits(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode result written by :func:`run_available`."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")


def grow(
    stream: DataFrame, out: str, checkpoint: str, generate: Callable[[DataFrame], DataFrame], length: Column, cap: int,
    on_batch: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Growing dataset (T3): generated rows of every batch that pass the length filter are appended; a hook sees the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if on_batch:
            on_batch(batch, batch_id)
        fresh = generate(batch)
        kept = fresh.filter(F.coalesce(length, F.lit(cap + 1)) <= cap)
        kept.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def table_generator(handler: type, schema: str, partition_by: list[str] | None = None, order_by: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A generator for :func:`grow` from a table function: ``handler.eval(row)`` yields tuples of ``schema`` for every row.

    With ``partition_by`` the rows of a key go to one handler object, in the order of ``order_by``, and ``handler.terminate()`` may yield more
    when they end. Without it any task takes any rows.
    """
    function = F.udtf(handler, returnType=schema)

    def generate(batch: DataFrame) -> DataFrame:
        if partition_by is None:
            return function(batch.asTable())
        rows = batch.asTable().partitionBy(*partition_by)
        return function(rows.orderBy(*order_by) if order_by else rows)

    return generate


def replay_files(df: DataFrame, order: str, slices: int, label: str = "replay", together: str | None = None) -> str:
    """Write a table as slices in ``order``, one after the other, so that a stream reads them in that order; null keys come first.

    A file source takes files by modification time; files written by one job all carry about the same time. So the rows are dealt to slices
    in one pass over the table, by sampled bounds, and each slice is then appended by a job of many tasks. ``together``: all rows of a slice
    with the same value of this column go into one file, for consumers that keep a state per value.
    """
    spark = df.sparkSession
    path, staged = scratch_path(spark, label), scratch_path(spark, f"{label}-staged")
    key = F.col(order).cast("double") if order != "ts" else F.unix_micros(order).cast("double")
    cuts = [i / slices for i in range(1, slices)]
    edges = df.select(key.alias("k")).approxQuantile("k", cuts, 0.01) if cuts else []
    number = sum((F.coalesce(key >= e, F.lit(False)).cast("int") for e in edges), F.lit(0))
    with_slice = T.StructType([*df.schema.fields, T.StructField("__slice", T.IntegerType())])
    df.withColumn("__slice", number).write.partitionBy("__slice").parquet(staged)
    for n in range(slices):
        part = spark.read.schema(with_slice).parquet(staged).filter(F.col("__slice") == n).drop("__slice")
        (part if together is None else part.repartition(together)).write.mode("append").parquet(path)
    return path
