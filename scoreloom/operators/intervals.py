"""Joins of points with intervals of any length (survey row J11), and a join that splits hot keys of both sides.

The values between the smallest start and the largest end are the leaves of an implicit tree. An interval is filed under the nodes it touches on the
one level whose nodes are as long as itself or shorter, up to ``2 ** BITS`` times: five of them at most. A point lies below one node of each level, and visits only
levels that some interval uses. Both meet on (level, node), so a point is compared with intervals that hold it or end within their own
length of it, whatever the lengths of the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.groups import ROWS_PER_TASK, join_null_safe, spread_hash

#: A node has ``2 ** BITS`` children. More bits mean fewer levels for a point and more nodes for an interval.
BITS = 2
#: Ranges of key hashes that are counted to find out where a hot key can be.
RANGES = 65_536
#: Steps of the tree for fractional values, as a power of two: what a double can tell apart.
_STEPS = 52


def free_names(taken: Iterable[str], *stems: str) -> list[str]:
    """Column names like ``stems`` that are not ``taken``, in any letter case."""
    used, out = {t.lower() for t in taken}, []
    for stem in stems:
        while stem.lower() in used:
            stem += "_"
        used.add(stem.lower())
        out.append(stem)
    return out


def join_split(left: DataFrame, right: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner join of two tables that may both have many rows of a key; null keys match nothing.

    A key with more than ``rows_per_task`` rows on a side is dealt over a grid: its rows of one side into rows of the grid, those of the other
    into columns, each repeated along the other direction. The broadcast list has at most rows / ``rows_per_task`` entries. Spark's estimates do
    not see how often a row was repeated before, so the join is a sort-merge join, never a broadcast of a side.
    """
    n, part, s_left, s_right, i, j = free_names([*left.columns, *right.columns], "n", "range", "s_left", "s_right", "cell_i", "cell_j")

    def hot_keys(df: DataFrame) -> DataFrame:
        # Only hash ranges with so many rows can hold a hot key; keys are counted one by one in those alone.
        own = df.select(*keys).dropna().withColumn(part, F.pmod(F.xxhash64(*keys), F.lit(RANGES)))
        busy = own.groupBy(part).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > rows_per_task).select(part)
        counts = own.join(F.broadcast(busy), part, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
        return counts.filter(F.col(n) > rows_per_task).select(*keys, F.ceil(F.col(n) / rows_per_task).cast("int").alias(n))

    sides = hot_keys(left).select(*keys, F.col(n).alias(s_left), F.lit(1).alias(s_right)).union(
        hot_keys(right).select(*keys, F.lit(1).alias(s_left), F.col(n).alias(s_right))
    )
    hot = F.broadcast(sides.groupBy(*keys).agg(F.max(s_left).alias(s_left), F.max(s_right).alias(s_right)))

    def dealt(df: DataFrame, own: str, splits: str, other: str, copies: str) -> DataFrame:
        tagged = join_null_safe(df, hot, keys, "left")
        place = F.when(F.col(splits).isNull(), F.lit(0)).otherwise(F.pmod(spread_hash(df), F.col(splits)).cast("int"))
        repeat = F.when(F.col(copies).isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(copies) - 1))
        return tagged.withColumn(own, place).withColumn(other, F.explode(repeat)).drop(s_left, s_right)

    both = dealt(left, i, s_left, j, s_right).hint("merge").join(dealt(right, j, s_right, i, s_left), [*keys, i, j])
    return both.drop(i, j)


def _is_time(kind: str) -> bool:
    return kind in ("timestamp", "timestamp_ntz", "date")


def _number(column: Column, kind: str) -> Column:
    """A value as a number: whole numbers and times (in microseconds) exactly, others as doubles."""
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column)
    if kind == "date":
        return F.unix_date(column).cast("bigint") * 86_400_000_000
    return column.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else column.cast("double")


def tree_nodes(low: Column, high: Column, levels: int, bits: int = BITS) -> Column:
    """The nodes that cover the whole numbers ``low`` to ``high`` exactly: ``array<struct<level, node>>``, under 2 ** (bits + 1) per level."""
    fan = 1 << bits
    none = F.array().cast("array<bigint>")

    def span(first: Column, end: Column) -> Column:
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(none)

    def of(level: int) -> Column:
        # What is left at this level is from `a` on and before `b`; the ends that do not fill a parent are given here.
        a, b = -F.shiftright(-low, bits * level), F.shiftright(high + 1, bits * level)
        up = -F.shiftright(-a, bits) * fan
        left = F.least(up, b)
        right = F.greatest(F.shiftright(b, bits) * fan, left)
        top = F.lit(level == levels - 1)
        nodes = F.when(top, span(a, b)).otherwise(F.concat(span(a, left), span(right, b)))
        return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))

    return F.concat(*[of(level) for level in range(levels)])


def level_of(length: Column, bits: int = BITS) -> Column:
    """The level whose nodes, ``2 ** (bits * level)`` long, are the longest that are no longer than ``length`` (a whole number, zero included)."""
    return F.floor((F.length(F.bin(length)) - 1) / bits).cast("int")


def interval_join(
    points: DataFrame, intervals: DataFrame, key: Sequence[str], point: str, start: str, end: str, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Points inside closed intervals of the same ``key`` (J11), one row per pair: key, other columns of the point, of the interval.

    Values are numbers or times, of one kind on both sides. Null values, null keys and intervals that end before they start match
    nothing. Ends may be infinite; NaN counts as larger than any number. Repeated rows give repeated pairs.
    """
    kinds = {dict(points.dtypes)[point], dict(intervals.dtypes)[start], dict(intervals.dtypes)[end]}
    if len({_is_time(k) for k in kinds}) > 1:
        raise ValueError(f"points and intervals are of different kinds: {sorted(kinds)}")
    level, node, place_, low_, high_ = free_names([*points.columns, *intervals.columns], "level", "node", "place", "low", "high")
    value = lambda df, c: _number(F.col(c), dict(df.dtypes)[c])
    whole = all(_is_time(k) or k in ("tinyint", "smallint", "int", "bigint") for k in kinds)
    proper = intervals.filter(F.col(start) <= F.col(end))
    s, e = value(proper, start), value(proper, end)
    edge = lambda c: F.when(F.abs(c.cast("double")) < float("inf"), c)
    low, high, least, most = proper.agg(
        F.min(F.least(edge(s), edge(e))), F.max(F.greatest(edge(s), edge(e))), F.min(s), F.max(e)
    ).first()
    if least is None:
        low = high = 0
    low, high = (0 if x is None else x for x in (low, high))
    if whole and high - low < 1 << 60:
        steps = high - low
        place = lambda c: F.greatest(F.least(c, F.lit(high)), F.lit(low)) - F.lit(low)
    else:
        # A monotone map of the values to steps; what shares a step is told apart by the values themselves.
        steps = (1 << _STEPS) - 1
        factor = F.lit(float(steps)) / F.greatest(F.lit(float(high) - float(low)), F.lit(5e-324))
        share = lambda c: F.floor(F.least(F.greatest((c.cast("double") - float(low)) * factor, F.lit(0.0)), F.lit(float(steps))))
        place = lambda c: F.when(F.isnan(c.cast("double")), F.lit(steps)).otherwise(share(c)).cast("bigint")
    at = lambda x, lv: F.call_function("shiftright", x, lv * F.lit(BITS))
    bounds = proper.withColumn(low_, place(s)).withColumn(high_, place(e)).withColumn(level, level_of(F.col(high_) - F.col(low_)))
    covered = bounds.withColumn(node, F.explode(F.sequence(at(F.col(low_), F.col(level)), at(F.col(high_), F.col(level))))).drop(low_, high_)
    # At most one number per level comes to the driver.
    used = sorted(r[0] for r in bounds.select(level).distinct().collect())
    inside = points.filter(value(points, point).between(F.lit(least), F.lit(most))) if used else points.limit(0)
    levels = F.array(*[F.lit(n) for n in used]) if used else F.array().cast("array<int>")
    placed = inside.withColumn(place_, place(value(points, point))).withColumn(level, F.explode(levels))
    placed = placed.withColumn(node, at(F.col(place_), F.col(level))).drop(place_)
    pairs = join_split(placed, covered, [*key, level, node], rows_per_task)
    return pairs.filter(F.col(point).between(F.col(start), F.col(end))).drop(level, node)
