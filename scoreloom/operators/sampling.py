"""Seeded draws, quotas and splits (survey rows SMP1-SMP7). Order is a stable hash, so a draw is a function of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.hashing import hash_bucket, hash_unit, stable_hash
from scoreloom.operators.groups import join_null_safe, lookup_by_group, ranked, running_sum, scalar_row
from scoreloom.operators.joins import pos_bucket


def keep_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: dict[str, Column], target: Column
) -> DataFrame:
    """The first ``target`` rows per key in the given order; ``target`` may use the group size ``n``.

    Bucket counts decide which buckets are kept whole; only the one bucket per key that contains the cut is ranked, so the
    rows are filtered in place instead of being shuffled.
    """
    tagged = df
    for alias, expr in buckets.items():
        tagged = tagged.withColumn(alias, expr)
    names = list(buckets)
    counts = tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__c"))
    run = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    cuts = (
        counts.withColumn("__hi", F.sum("__c").over(run)).withColumn("n", F.sum("__c").over(whole))
        .withColumn("__need", target - (F.col("__hi") - F.col("__c")))
        .filter(F.col("__need") > 0)
        .select(*keys, *names, F.when(F.col("__need") < F.col("__c"), F.col("__need")).alias("__cut"))
    )
    hit = join_null_safe(tagged, cuts, [*keys, *names], "inner")
    full = hit.filter(F.col("__cut").isNull())
    local = Window.partitionBy(*keys, *names).orderBy(*order)
    part = (
        hit.filter(F.col("__cut").isNotNull()).withColumn("__rn", F.row_number().over(local))
        .filter(F.col("__rn") <= F.col("__cut")).drop("__rn")
    )
    return full.unionByName(part).drop("__cut", *names)


def draw_exact(df: DataFrame, rate: float | Column, id_col: str, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Exactly ``floor(n * rate)`` rows per source (SMP1); a rate of 1 keeps everything."""
    h = stable_hash(id_col, seed=seed)
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return keep_first(df, by, [h, F.col(id_col)], {"__hb": hash_bucket(h)}, F.floor(F.col("n") * r))


def draw_count(df: DataFrame, count: int | Column, id_col: str, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """At most ``count`` rows per key in hash order."""
    h = stable_hash(id_col, seed=seed)
    c = count if isinstance(count, Column) else F.lit(count)
    return keep_first(df, by, [h, F.col(id_col)], {"__hb": hash_bucket(h)}, c)


def stratified(df: DataFrame, by: str, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """Proportional quota per stratum, rounded half to even, then topped up or trimmed to exactly ``n`` rows (SMP2).

    A quota is at most ``n`` and the top-up takes at most ``n`` rows more, so the first ``2 * n`` rows of a stratum hold all that can be
    chosen. The rank filter cuts every map task down to them; quotas meet these rows, never the table.
    """
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("__rows"))
    total = scalar_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    quotas = sizes.select(by, F.bround(F.col("__rows") / total * F.lit(float(n)), 0).cast("bigint").alias("__quota"))
    h = stable_hash(id_col, seed=seed)
    inside = Window.partitionBy(by).orderBy("__h", id_col)
    front = df.withColumn("__h", h).withColumn("__place", F.row_number().over(inside)).filter(F.col("__place") <= 2 * n)
    marked = join_null_safe(front, quotas, [by], "inner").withColumn("__f", (F.col("__place") > F.col("__quota")).cast("int"))
    out = keep_first(
        marked, [], [F.col("__f"), F.col("__h"), F.col(id_col)], {"__g": F.col("__f"), "__hb": hash_bucket(F.col("__h"))}, F.lit(n)
    )
    return out.drop("__h", "__place", "__quota", "__f")


def quota_per_type(df: DataFrame, by: str, per_type: int, id_col: str, seed: int = 0) -> DataFrame:
    """Up to ``per_type`` rows of each type (SMP2)."""
    return draw_count(df, per_type, id_col, [by], seed)


def spot_check(
    df: DataFrame, quotas: Sequence[tuple[str, Column, int]], id_col: str, total: int = 50, seed: int = 0
) -> DataFrame:
    """Ordered bucket quotas without repeats, filled up to ``total`` from the remaining rows (SMP3).

    One pass: a bucket can lose at most the rows that earlier buckets take, so its first rows in hash order, as many as all quotas up to it,
    hold its share. The rank filter cuts every map task down to that many; the few rows left are assigned in bucket order.
    """
    h = stable_hash(id_col, seed=seed)
    buckets = [*quotas, ("fill", F.lit(True), total)]
    needed = [sum(q[2] for q in buckets[: i + 1]) for i in range(len(buckets))]
    entries = [F.when(condition, F.struct(F.lit(i).alias("b"), F.lit(needed[i]).alias("m"))) for i, (_, condition, _) in enumerate(buckets)]
    tagged = df.withColumn("__h", h).withColumn("__e", F.explode(F.array_compact(F.array(*entries))))
    first = Window.partitionBy("__e.b").orderBy("__h", id_col)
    small = tagged.withColumn("__rn", F.row_number().over(first)).filter((F.col("__rn") <= max(needed)) & (F.col("__rn") <= F.col("__e.m")))
    # At most the sum of `needed` rows are gathered: one list of (bucket, hash, id) per bucket, taken in order.
    key = F.struct("__h", F.col(id_col).alias("i"))
    lists = small.groupBy().agg(*[
        F.array_sort(F.collect_list(F.when(F.col("__e.b") == i, key))).alias(f"l{i}") for i in range(len(buckets))
    ])
    for i, (_, _, count) in enumerate(buckets):
        earlier = F.flatten(F.array(*[F.col(f"p{j}") for j in range(i)])) if i else None
        rest = F.col(f"l{i}") if earlier is None else F.array_except(f"l{i}", earlier)
        lists = lists.withColumn(f"p{i}", F.slice(rest, 1, count))
    picks = F.flatten(F.array(*[
        F.transform(F.col(f"p{i}"), lambda s: F.struct(F.lit(i).alias("__o"), F.lit(name).alias("bucket"), s["__h"].alias("__ph"), s["i"].alias("__pi")))
        for i, (name, _, _) in enumerate(buckets)
    ]))
    chosen = lists.select(F.inline(F.slice(picks, 1, total)))
    rows = small.dropDuplicates([id_col])
    out = rows.join(chosen, F.col(id_col).eqNullSafe(F.col("__pi")))
    return out.orderBy("__o", "__h", id_col).drop("__h", "__e", "__rn", "__o", "__ph", "__pi")


def audit_sample(
    df: DataFrame, fraction: float, id_col: str, condition: Column | None = None, seed: int = 0
) -> DataFrame:
    """A stable share of the accepted rows (SMP4)."""
    pool = df if condition is None else df.filter(condition)
    return pool.filter(hash_unit(stable_hash(id_col, seed=seed)) < fraction)


def limit_rows(df: DataFrame, n: int, how: str, pos: str, seed: int = 0) -> DataFrame:
    """First ``n``, a random ``n``, or every ``len // n``-th row (SMP5)."""
    if how == "first":
        return keep_first(df, [], [F.col(pos)], pos_bucket(pos), F.lit(n))
    if how == "random":
        return draw_count(df, n, pos, [], seed)
    if how == "stride":
        out = ranked(df, [], [F.col(pos)], pos_bucket(pos), "__row")
        total = scalar_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
        step = F.greatest(F.floor(total / n), F.lit(1))
        row = F.col("__row") - 1
        return out.filter((row % step == 0) & (row / step < n)).drop("__row")
    raise ValueError(f"unknown limit mode: {how}")


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """Seeded shuffle: rows sorted by hash (a range-partitioned distributed sort)."""
    return df.orderBy(stable_hash(id_col, seed=seed), id_col)


def resample_weights(df: DataFrame, how: str = "pow", power: float = 2.0, score: str = "score") -> DataFrame:
    """Resampling weight of every row (SMP6): power of the score, extremes only, or best against rest."""
    s = F.col(score)
    if how == "pow":
        w = F.pow(F.abs(s), F.lit(float(power)))
    elif how in ("max_min", "max_random"):
        ends = scalar_row(df.agg(F.max(s).alias("hi"), F.min(s).alias("lo")))
        if how == "max_min":
            w = F.when((s == ends["hi"]) | (s == ends["lo"]), F.lit(1.0)).otherwise(F.lit(0.0))
        else:
            w = F.when(s == ends["hi"], F.lit(0.4)).otherwise(F.lit(0.1))
    else:
        raise ValueError(f"unknown weighting: {how}")
    return df.withColumn("weight", F.greatest(w + F.lit(1e-8), F.lit(1e-8)))


BIN_RUN = 10_000
UNITS = 10**12


def resample_weighted(df: DataFrame, pos: str, weight: str = "weight", seed: int = 0) -> DataFrame:
    """As many draws with replacement as rows, each row hit in proportion to its weight (SMP6).

    Rows become intervals of the cumulative weight and draws become points. Both meet on equal-width bins, one per row on
    average; bins crowded by many light rows are cut into finer ones. Running weights are decimals with twelve places, so that one row's end
    is exactly the next row's start and every draw meets one row. Output: ``draw`` and the drawn row.
    """
    # Whole numbers of units: sums of decimals with a fraction lose places as their type grows.
    exact = (F.col(weight).cast("decimal(26,12)") * F.lit(UNITS)).cast("decimal(26,0)")
    cum = running_sum(df, [], [F.col(pos)], exact, pos_bucket(pos), "__hi").withColumn("__lo", (F.col("__hi") - exact).cast("double") / UNITS)
    cum = cum.withColumn("__hi", F.col("__hi").cast("double") / UNITS)
    totals = scalar_row(cum.agg(F.count(F.lit(1)).cast("double").alias("n"), F.max("__hi").alias("w")))
    spans = cum.withColumn("__t", totals)
    n, total = F.col("__t.n"), F.col("__t.w")
    bin_of = lambda x: F.least(F.floor(x / total * n), n - 1).cast("bigint")
    # A row that owns many bins is spread in two steps, so that no array holds more than BIN_RUN of them.
    low, high = bin_of(F.col("__lo")), bin_of(F.col("__hi"))
    spans = spans.withColumn("__run", F.explode(F.sequence(F.floor(low / BIN_RUN), F.floor(high / BIN_RUN))))
    spans = spans.withColumn(
        "__bin", F.explode(F.sequence(F.greatest(low, F.col("__run") * BIN_RUN), F.least(high, F.col("__run") * BIN_RUN + BIN_RUN - 1)))
    ).drop("__run")
    crowd = spans.groupBy("__bin").agg(F.count(F.lit(1)).alias("__rows"))
    fine = crowd.select("__bin", "__rows", F.ceil(F.col("__rows") / 1000).cast("bigint").alias("__fine"))
    # Position of x inside its bin, as a sub-bin number from 0 to fine - 1.
    sub = lambda x: F.least(
        F.greatest(F.floor((x / total * n - F.col("__bin")) * F.col("__fine")), F.lit(0)), F.col("__fine") - 1
    ).cast("bigint")
    spans = lookup_by_group(spans, fine, ["__bin"], "__rows", "inner", rows_per_task=10_000)
    spans = spans.withColumn("__sub", F.explode(F.sequence(sub(F.col("__lo")), sub(F.col("__hi")))))
    draws = df.select(F.col(pos).alias("draw"), hash_unit(stable_hash(pos, seed=seed)).alias("__u")).withColumn("__t", totals)
    draws = draws.withColumn("__u", F.col("__u") * total).withColumn("__bin", bin_of(F.col("__u")))
    draws = draws.join(fine, "__bin").withColumn("__sub", sub(F.col("__u"))).select("draw", "__u", "__bin", "__sub")
    out = draws.join(spans.drop("__rows", "__fine", "__t"), ["__bin", "__sub"]).filter(
        (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))
    )
    return out.drop("__u", "__bin", "__sub", "__lo", "__hi")


def holdout_by_scene(
    df: DataFrame, source: str = "source", scene: str = "scene", pos: str = "pos", cap: int = 500, share: int = 20
) -> DataFrame:
    """Column ``split`` (SMP7): rows of the first ``max(1, scenes // share)`` scenes per source form the holdout.

    Scenes count in first-seen order. At most ``cap`` rows per source stay in the holdout; later ones return to train.
    """
    scenes = df.groupBy(source, scene).agg(F.min(pos).alias("__first"), F.count(F.lit(1)).alias("__size"))
    total = scenes.groupBy(source).agg(F.count(F.lit(1)).alias("__scenes"))
    order = ranked(scenes, [source], [F.col("__first")], pos_bucket("__first"), "__rank")
    held = join_null_safe(order, total, [source]).filter(
        F.col("__rank") <= F.greatest(F.floor(F.col("__scenes") / share), F.lit(1))
    ).select(source, scene, "__size")
    rows = lookup_by_group(df.select(source, scene, pos).filter(F.col(pos).isNotNull()), held, [source, scene], "__size", "inner")
    # The rank filter cuts every map task down to `cap` rows per source; the last place that fits then marks rows by their scene.
    front = rows.withColumn("__n", F.row_number().over(Window.partitionBy(source).orderBy(pos))).filter(F.col("__n") <= cap)
    last = front.groupBy(source).agg(F.max(pos).alias("__last"))
    marked = lookup_by_group(df, join_null_safe(held, last, [source], "inner"), [source, scene], "__size", "left")
    split = F.when(F.col(pos) <= F.col("__last"), "holdout").otherwise("train")
    return marked.withColumn("split", split).drop("__last", "__size")
