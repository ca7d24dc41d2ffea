"""Top rows, likelihood choices and checkpoint ranking (survey rows W16, W17, O6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.benchmarks import tail_index
from scoreloom.operators.groups import lookup_by_group, order_statistics


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; with a rank filter Spark keeps only ``k`` rows per group and map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def take_first_k(df: DataFrame, keys: Sequence[str], pos: str, k: int = 1) -> DataFrame:
    """The first ``k`` responses per document."""
    return top_k(df, keys, [F.col(pos)], k)


def pick_choice(
    df: DataFrame, keys: Sequence[str], idx: str = "idx", loss: str = "ll", length: str = "length",
    unconditional: str | None = None,
) -> DataFrame:
    """Chosen option per document (W16): smallest loss, smallest loss per character, largest gain over the unconditional.

    Ties go to the lowest option number.
    """
    low = lambda v: F.min_by(idx, F.struct(v, F.col(idx)))
    cols = [low(F.col(loss)).alias("pred"), low(F.col(loss) / F.col(length)).alias("pred_norm")]
    if unconditional:
        cols.append(F.max_by(idx, F.struct(F.col(loss) - F.col(unconditional), -F.col(idx))).alias("pred_mutual"))
    return df.groupBy(*keys).agg(*cols)


def best_steps(steps: DataFrame, k: int, step: str = "step", score: str = "score") -> DataFrame:
    """Best ``k`` checkpoints (W17): a step without a score inherits the last one, later steps win ties.

    One row per step, so the ordered fill runs over the step table.
    """
    filled = steps.withColumn(
        score, F.last(score, ignorenulls=True).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    ).filter(F.col(score).isNotNull())
    w = Window.orderBy(F.col(score).desc(), F.col(step).desc())
    return filled.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_rows(df: DataFrame, by: str, id_col: str, n: int) -> DataFrame:
    """The ``n`` largest rows (O6), a distributed top-n."""
    return df.orderBy(F.col(by).desc(), F.col(id_col)).limit(n)


def tail_rows(df: DataFrame, keys: Sequence[str], by: str, q: float) -> DataFrame:
    """Rows at or above the index percentile ``q`` of their group."""
    cut = order_statistics(df, keys, by, {"__cut": tail_index(F.col("n"), q)})
    return lookup_by_group(df, cut, keys, "n", "inner").filter(F.col(by) >= F.col("__cut")).drop("__cut", "n")
