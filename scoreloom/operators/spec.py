"""Task and group specifications: the user's hooks as functions on DataFrames (survey section 2.9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scoring import apply_filters
from scoreloom.operators.corpus import group_metrics


def _same(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class TaskSpec:
    """One evaluation task.

    ``process_docs`` prepares the documents, ``filters`` are response filter chains, ``process_results`` adds one numeric column
    per name in ``metrics``. ``aggregate`` may replace the default mean with standard error.
    """

    name: str
    metrics: Sequence[str]
    process_results: Callable[[DataFrame], DataFrame]
    process_docs: Callable[[DataFrame], DataFrame] = _same
    filters: dict[str, Sequence[tuple[str, dict]]] = field(default_factory=dict)
    aggregate: Callable[[DataFrame], DataFrame] | None = None


def evaluate(task: TaskSpec, docs: DataFrame, responses: DataFrame, doc_id: str = "doc_id", resps: str = "resps") -> DataFrame:
    """(task, metric, value, stderr, size) of one task: documents joined to responses, filtered, scored, aggregated."""
    rows = task.process_docs(docs).join(responses.select(doc_id, resps), doc_id)
    scored = task.process_results(apply_filters(rows, task.filters, resps))
    if task.aggregate:
        return task.aggregate(scored).withColumn("task", F.lit(task.name))
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in task.metrics]
    long = scored.select(F.inline(F.array(*pairs)))
    return long.groupBy("metric").agg(
        F.avg("v").alias("value"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("stderr"), F.count("v").alias("size")
    ).withColumn("task", F.lit(task.name))


@dataclass(frozen=True)
class GroupSpec:
    """A nested tree of groups and tasks, and whether subtasks count by their size."""

    tree: dict
    weight_by_size: bool = True


def evaluate_groups(spec: GroupSpec, results: DataFrame) -> DataFrame:
    """Group metrics of task results produced by :func:`evaluate`."""
    return group_metrics(results, spec.tree, spec.weight_by_size, se="stderr")
