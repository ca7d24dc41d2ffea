"""Group-wise building blocks that hold up when one key owns a large share of all rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. The helpers here aggregate first
(map-side combine), and bring the small result back to the rows through a join whose hot keys are split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where null matches null; the right-hand copies of the keys are dropped."""
    if not keys:
        raise ValueError("keys must not be empty")
    renamed = right
    condition = None
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
        term = left[key].eqNullSafe(F.col(f"__r_{key}"))
        condition = term if condition is None else condition & term
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{key}" for key in keys])


def scalar_row(one_row: DataFrame) -> Column:
    """The single row of ``one_row`` as a struct column (a scalar subquery: no join, no driver round trip)."""
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("s")).scalar()


def spread_hash(df: DataFrame) -> Column:
    """A repeatable per-row hash, used to spread the rows of a hot key. Maps cannot be hashed and are left out."""
    usable = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    return F.xxhash64(*[F.col(c) for c in usable])


def lookup_by_group(
    df: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    size_col: str,
    how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join one-row-per-key ``side`` onto ``df``; keys with more than ``rows_per_task`` rows are split.

    ``side[size_col]`` is the number of rows of the key in ``df``. Hot keys get ``ceil(size / rows_per_task)``
    salts on both sides, so no task receives more than about ``rows_per_task`` rows of one key. The broadcast
    list of hot keys has at most ``rows(df) / rows_per_task`` entries.
    """
    splits = F.ceil(F.col(size_col) / F.lit(rows_per_task)).cast("int")
    hot = F.broadcast(side.filter(F.col(size_col) > rows_per_task).select(*keys, splits.alias("__splits")))
    salted = join_null_safe(df, hot, keys, "left").withColumn(
        "__salt",
        F.when(F.col("__splits").isNull(), F.lit(0)).otherwise(
            F.pmod(spread_hash(df), F.col("__splits")).cast("int")
        ),
    ).drop("__splits")
    replicated = side.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.greatest(splits, F.lit(1)) - F.lit(1)))
    )
    return join_null_safe(salted, replicated, [*keys, "__salt"], how).drop("__salt")


def with_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``agg(...) over (partition by keys)`` as aggregate plus split lookup."""
    stats = df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("__size"))
    return lookup_by_group(df, stats, keys, "__size", "inner", rows_per_task).drop("__size")


def _bucket_offsets(tagged: DataFrame, keys: Sequence[str], names: Sequence[str], total: Column) -> DataFrame:
    """Sum of ``total`` over all earlier buckets of the key, one row per (keys, buckets).

    Bucket columns form levels: each level adds up the buckets before it inside its parent bucket, so the window of a level
    sees the distinct buckets of one parent only.
    """
    finest = tagged.groupBy(*keys, *names).agg(total.alias("__t"))
    out = None
    for depth in range(len(names), 0, -1):
        level = finest if depth == len(names) else finest.groupBy(*keys, *names[:depth]).agg(F.sum("__t").alias("__t"))
        before = (
            Window.partitionBy(*keys, *names[: depth - 1]).orderBy(names[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        shifted = level.select(*keys, *names[:depth], F.coalesce(F.sum("__t").over(before), F.lit(0)).alias(f"__o{depth}"))
        out = shifted if out is None else join_null_safe(out, shifted, [*keys, *names[:depth]], "inner")
    total_offset = sum((F.col(f"__o{d}") for d in range(2, len(names) + 1)), F.col("__o1"))
    return out.select(*keys, *names, total_offset.alias("__off"))


def _tag(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    for alias, expr in columns.items():
        df = df.withColumn(alias, expr)
    return df


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    buckets: dict[str, Column],
    name: str = "rn",
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key.

    ``buckets`` names coarse ascending expressions that agree with the leading sort order (the first digits
    of a hash, ``pos`` divided by a constant, a negated score). Rows are ranked inside (keys, buckets) and shifted by
    the number of rows in earlier buckets; only bucket counts go through wider windows.
    """
    tagged = _tag(df, buckets)
    names = list(buckets)
    offsets = _bucket_offsets(tagged, keys, names, F.count(F.lit(1)))
    local = Window.partitionBy(*keys, *names).orderBy(*order)
    out = join_null_safe(
        tagged.withColumn("__rn", F.row_number().over(local)), offsets, [*keys, *names], "inner"
    )
    return out.withColumn(name, F.col("__rn") + F.col("__off")).drop("__rn", "__off", *names)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    buckets: dict[str, Column],
    name: str = "running",
) -> DataFrame:
    """Inclusive running sum per key, bucketed like :func:`ranked`."""
    tagged = _tag(df.withColumn("__v", value), buckets)
    names = list(buckets)
    offsets = _bucket_offsets(tagged, keys, names, F.sum("__v"))
    local = (
        Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = join_null_safe(
        tagged.withColumn("__part", F.sum("__v").over(local)), offsets, [*keys, *names], "inner"
    )
    return out.withColumn(name, F.col("__part") + F.col("__off")).drop("__v", "__part", "__off", *names)


#: Ranges a power of two is cut into.
RANGES = 65_536


def value_buckets(value: Column, stem: str = "__v") -> dict[str, Column]:
    """Bucket levels that ascend with any number, whatever its distribution: sign and power of two, then its leading binary digits.

    There are a few thousand powers and ``RANGES`` ranges in each, so the wide windows of :func:`ranked` and :func:`running_sum` are bounded for
    dense positions, hashed 64-bit ids, shares in [0, 1) and equal loads alike. Nulls come first, NaN last.
    """
    v = value.cast("double")
    size = F.abs(v)
    finite = v.isNotNull() & ~F.isnan(v) & (size > 0) & (size < float("inf"))
    power = F.floor(F.log2(F.when(finite, size))).cast("int")
    sign = F.signum(v).cast("int")
    place = F.floor((F.when(finite, size) / F.pow(F.lit(2.0), power) - 1) * RANGES)
    top = F.when(v.isNull(), F.lit(None).cast("int")).when(F.isnan(v), F.lit(5000)).when(size == 0, F.lit(0)).when(
        finite, sign * (power + 2000)
    ).otherwise(sign * 4000)
    return {f"{stem}0": top, f"{stem}1": F.coalesce(sign * place, F.lit(0)).cast("int")}


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, Column],
    bucket: Column | None = None,
) -> DataFrame:
    """Exact order statistics per key; each pick is a 0-based index computed from ``n`` (the group size).

    Values are counted first, so the ranked table holds distinct values only; the counts of coarse value
    ranges (``bucket``, default: :func:`value_buckets`) are summed before single values are looked at.
    """
    buckets = value_buckets(F.col(value)) if bucket is None else {"__vb": bucket}
    counts = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    )
    run = running_sum(counts, keys, [F.col(value)], F.col("__c"), buckets, "__hi")
    sizes = counts.groupBy(*keys).agg(F.sum("__c").alias("n"))
    if keys:
        run = lookup_by_group(run, sizes, keys, "n", "inner")
    else:
        run = run.withColumn("n", scalar_row(sizes)["n"])
    lo, hi = F.col("__hi") - F.col("__c"), F.col("__hi")
    aggs = [
        F.max(F.when((idx >= lo) & (idx < hi), F.col(value))).alias(alias) for alias, idx in picks.items()
    ]
    return run.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def linear_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Interpolated percentiles (position ``q * (n - 1)``) per key from exact order statistics."""
    picks: dict[str, Column] = {}
    for alias, q in fractions.items():
        position = F.lit(q) * (F.col("n") - 1)
        picks[f"__lo_{alias}"] = F.floor(position)
        picks[f"__hi_{alias}"] = F.ceil(position)
    out = order_statistics(df, keys, value, picks)
    cols = [
        (
            F.col(f"__lo_{a}")
            + (F.col(f"__hi_{a}") - F.col(f"__lo_{a}")) * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)))
        ).alias(a)
        for a, q in fractions.items()
    ]
    return out.select(*keys, "n", *cols)
