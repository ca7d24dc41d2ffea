"""Step, batch and validation metrics in long form (survey rows G1-G9, G21, G31)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import arrays as A
from scoreloom.functions.hashing import hash_int, stable_hash
from scoreloom.operators.groups import (
    join_null_safe,
    linear_percentiles,
    lookup_by_group,
    ranked,
    running_sum,
    scalar_row,
    value_buckets,
)

METRICS: dict[str, Callable[..., DataFrame]] = {}


def register_metric(name: str):
    """Make ``fn(df, **options) -> df`` available by name."""

    def wrap(fn):
        if METRICS.get(name, fn) is not fn:
            raise ValueError(f"metric already registered: {name}")
        METRICS[name] = fn
        return fn

    return wrap


def compute_metrics(df: DataFrame, names: Sequence[str], **options) -> dict[str, DataFrame]:
    """Registered metrics by name, each with the given options; an unknown name is an error that lists the known ones."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics {unknown}; registered are {sorted(METRICS)}")
    return {n: METRICS[n](df, **options) for n in names}


def melt_row(one_row: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """A one-row result as (metric, value) pairs."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value)) for c in one_row.columns]
    return one_row.select(F.inline(F.array(*pairs)))


def reduce_metrics(long: DataFrame, name: str = "name", value: str = "value", kind: str | None = None) -> DataFrame:
    """One value per name (G1): typed aggregation where ``kind`` is set, else max / min by name, else the mean.

    Mixing two kinds under one name is an error.
    """
    n = F.col(name)
    guess = F.when(n.contains("max"), "max").when(n.contains("min"), "min").otherwise("mean")
    tagged = long.withColumn("__k", F.coalesce(F.col(kind), guess) if kind else guess)
    v = F.col(value)
    out = tagged.groupBy(name).agg(
        F.min("__k").alias("k1"), F.max("__k").alias("k2"), F.avg(v).alias("a"), F.sum(v).alias("s"),
        F.min(v).alias("lo"), F.max(v).alias("hi"),
    )
    k = F.col("k1")
    chosen = (
        F.when(k != F.col("k2"), F.raise_error(F.concat(F.lit("mixed aggregation for "), n)).cast("double"))
        .when(k == "max", F.col("hi")).when(k == "min", F.col("lo")).when(k == "sum", F.col("s")).otherwise(F.col("a"))
    )
    return out.select(name, k.alias("aggregation"), chosen.alias(value))


# Metric names with an explicit cross-step rule.
STEP_RULES = {
    "time_sum": ["perf/time_per_step"],
    "min": ["timing_s/agent_loop/tool_calls/min"],
    "avg": ["timing_s/agent_loop/tool_calls/mean"],
    "max": ["timing_s/agent_loop/tool_calls/max"],
    "last": [
        "fully_async/count/total_generated_samples",
        "fully_async/count/stale_samples_processed",
        "fully_async/count/stale_trajectory_processed",
        "fully_async/count/current_param_version",
        "fully_async/count/dropped_stale_samples",
        "training/global_step",
    ],
}


def step_rule(name: Column) -> Column:
    """Aggregation rule of a metric name: listed names first, then keywords."""
    low = F.lower(name)
    rule = F.when(F.lit(False), F.lit(""))
    for kind, names in STEP_RULES.items():
        rule = rule.when(name.isin(names), kind)
    return (
        rule.when(low.contains("timing_s/"), "time_sum")
        .when(low.rlike("mean|avg|average"), "avg")
        .when(low.contains("max"), "max")
        .when(low.contains("min"), "min")
        .when(low.rlike("sum|total"), "sum")
        .otherwise("avg")
    )


def aggregate_steps(
    long: DataFrame, workers: int = 1, step: str = "step", name: str = "name", value: str = "value",
    rule: str | None = None, samples: str | None = None,
) -> DataFrame:
    """Combine metrics of several steps (G2), then the derived ones: throughput, sequence-length gap, idle share.

    ``rule`` may name a column that overrides the keyword rules (``weighted_avg`` weights by ``samples``).
    """
    v = F.col(value)
    kind = step_rule(F.col(name))
    weight = F.col(samples) if samples else F.lit(1.0)
    tagged = long.withColumn("__k", F.coalesce(F.col(rule), kind) if rule else kind).withColumn("__w", weight)
    agg = tagged.groupBy(name).agg(
        F.first("__k").alias("k"), F.sum(v).alias("s"), F.avg(v).alias("a"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.max_by(v, F.col(step)).alias("last"), F.sum(v * F.col("__w")).alias("sw"), F.sum("__w").alias("w"),
    )
    k = F.col("k")
    out = agg.select(
        F.col(name),
        F.when(k.isin("time_sum", "sum"), F.col("s")).when(k == "max", F.col("hi")).when(k == "min", F.col("lo"))
        .when(k == "last", F.col("last"))
        .when(k == "weighted_avg", F.when(F.col("w") == 0, F.col("a")).otherwise(F.try_divide("sw", "w")))
        .otherwise(F.col("a")).alias(value),
    )
    # One entry per metric name: the derived values only need the aggregated names.
    table = out.agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias("m"))
    m = F.col("m")

    def has(*keys: str) -> Column:
        cond = F.lit(True)
        for key in keys:
            cond = cond & F.map_contains_key(m, key)
        return cond

    def put(key: str, cond: Column, val: Column) -> Column:
        return F.when(cond, F.array(F.struct(F.lit(key).alias("k"), val.alias("v")))).otherwise(
            F.array().cast("array<struct<k:string,v:double>>")
        )

    def at(key: str) -> Column:
        return F.try_element_at(m, F.lit(key))

    derived = F.concat(
        put("global_seqlen/minmax_diff", has("global_seqlen/minmax_diff", "global_seqlen/max", "global_seqlen/min"),
            at("global_seqlen/max") - at("global_seqlen/min")),
        put("perf/throughput", has("perf/throughput", "perf/total_num_tokens", "perf/time_per_step"),
            F.try_divide(at("perf/total_num_tokens"), at("perf/time_per_step") * workers)),
        put("trainer/idle_ratio", has("timing_s/gen", "timing_s/step"), F.try_divide(at("timing_s/gen"), at("timing_s/step"))),
    )
    merged = table.select(F.map_concat(
        F.map_filter(m, lambda key, _: ~F.array_contains(F.transform(derived, lambda e: e["k"]), key)),
        F.map_from_entries(derived),
    ).alias("m"))
    return merged.select(F.explode("m").alias(name, value))


def prompt_stats(df: DataFrame, source: str = "data_source", uid: str = "uid", variable: str = "score") -> DataFrame:
    """Per prompt: number of responses, mean and population deviation."""
    v = F.col(variable)
    return df.groupBy(source, uid).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def validation_metrics(
    df: DataFrame, variables: Sequence[str], source: str = "data_source", uid: str = "uid"
) -> DataFrame:
    """``mean@N`` and ``std@N`` (G3): per prompt first, then an unweighted mean over the prompts that have N responses."""
    cols = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables]
    long = df.select(source, uid, F.inline(F.array(*cols)))
    per_prompt = long.groupBy(source, "variable", uid).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    per_source = per_prompt.groupBy(source, "variable", "n").agg(
        F.avg("mean").alias("mean"), F.avg("std").alias("std"), F.count(F.lit(1)).alias("prompts")
    )
    n = F.col("n").cast("string")
    rows = F.array(
        F.struct(F.concat(F.lit("mean@"), n).alias("metric"), F.col("mean").alias("value")),
        F.struct(F.concat(F.lit("std@"), n).alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("value")),
    )
    return per_source.select(source, "variable", "prompts", F.inline(rows)).filter(F.col("value").isNotNull())


def subset_sizes(n: Column) -> Column:
    """2, 4, 8, ... below ``n``, then ``n`` itself; nothing for a single response."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda e: F.pow(F.lit(2.0), e).cast("bigint"))
    below = F.filter(powers, lambda p: p < n)
    return F.when(n > 1, F.concat(below, F.array(n.cast("bigint")))).otherwise(F.array().cast("array<bigint>"))


def best_at_n(df: DataFrame, source: str = "data_source", uid: str = "uid", variable: str = "score") -> DataFrame:
    """Exact mean and deviation of the best and worst of n draws with replacement (G4), averaged over prompts.

    With ranks i of N, ``P(max is x_(i)) = (i/N)^n - ((i-1)/N)^n``. Equal values are counted first, so a prompt with very
    many responses contributes one row per distinct score.
    """
    keys = [source, uid]
    counts = df.groupBy(*keys, variable).agg(F.count(F.lit(1)).alias("c"))
    run = running_sum(counts, keys, [F.col(variable)], F.col("c"), value_buckets(F.col(variable)), "hi")
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("total"))
    run = lookup_by_group(run, sizes, keys, "total", "inner")
    rows = run.withColumn("n", F.explode(subset_sizes(F.col("total"))))
    total, n, x = F.col("total"), F.col("n"), F.col(variable)
    lo = F.col("hi") - F.col("c")
    top = F.pow(F.col("hi") / total, n) - F.pow(lo / total, n)
    bottom = F.pow((total - lo) / total, n) - F.pow((total - F.col("hi")) / total, n)
    per_prompt = rows.groupBy(*keys, "n").agg(
        F.sum(x * top).alias("b1"), F.sum(x * x * top).alias("b2"),
        F.sum(x * bottom).alias("w1"), F.sum(x * x * bottom).alias("w2"),
    )
    dev = lambda m1, m2: F.sqrt(F.greatest(F.col(m2) - F.col(m1) * F.col(m1), F.lit(0.0)))
    return per_prompt.groupBy(source, "n").agg(
        F.avg("b1").alias("best_mean"), F.avg(dev("b1", "b2")).alias("best_std"),
        F.avg("w1").alias("worst_mean"), F.avg(dev("w1", "w2")).alias("worst_std"),
    )


def bootstrap_draws(
    df: DataFrame, keys: Sequence[str], pos: str, size: Column, draws: int, seed: int = 42
) -> DataFrame:
    """``draws`` samples with replacement of ``size`` rows per group, as rows (keys, draw, slot, drawn row).

    A group becomes ``draws * size`` rows, which Spark's estimates do not see: groups are dealt over all tasks before, and the join with the
    rows is a sort-merge join, never a broadcast of the draws.
    """
    rows = ranked(df, keys, [F.col(pos)], value_buckets(F.col(pos), "__pb"), "__rank")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = (
        sizes.repartition(parts, *keys, "__n").withColumn("__size", size)
        .withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
        .withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("__size").cast("int"))))
        .withColumn("__rank", F.pmod(hash_int(stable_hash(*keys, "draw", "slot", seed=seed)), F.col("__n")) + 1)
        .drop("__n", "__size")
    )
    return join_null_safe(plan.hint("merge"), rows, [*keys, "__rank"], "inner").drop("__rank")


def bootstrap_best(
    df: DataFrame, n: int, draws: int = 1000, source: str = "data_source", uid: str = "uid", variable: str = "score",
    pos: str = "pos", seed: int = 42,
) -> DataFrame:
    """Resampled best@n / worst@n; :func:`best_at_n` gives the values these estimates converge to."""
    drawn = bootstrap_draws(df.select(source, uid, pos, variable), [source, uid], pos, F.lit(n), draws, seed)
    per_draw = drawn.groupBy(source, uid, "draw").agg(F.max(variable).alias("hi"), F.min(variable).alias("lo"))
    per_prompt = per_draw.groupBy(source, uid).agg(
        F.avg("hi").alias("bm"), F.stddev_pop("hi").alias("bs"), F.avg("lo").alias("wm"), F.stddev_pop("lo").alias("ws")
    )
    return per_prompt.groupBy(source).agg(
        F.avg("bm").alias("best_mean"), F.avg("bs").alias("best_std"),
        F.avg("wm").alias("worst_mean"), F.avg("ws").alias("worst_std"),
    )


def majority_value(
    df: DataFrame, keys: Sequence[str], vote: str = "pred", value: str = "score", pos: str = "pos"
) -> DataFrame:
    """Value of the first row carrying the most frequent vote (G5); ties go to the vote seen first."""
    votes = df.groupBy(*keys, vote).agg(
        F.count(F.lit(1)).alias("c"), F.min(pos).alias("p"), F.min_by(value, pos).alias("v")
    )
    rank = F.struct(F.col("c"), -F.col("p"))
    return votes.groupBy(*keys).agg(F.max_by(vote, rank).alias("vote"), F.max_by("v", rank).alias("value"))


def bootstrap_majority(
    df: DataFrame, n: int, draws: int = 1000, source: str = "data_source", uid: str = "uid", vote: str = "pred",
    value: str = "score", pos: str = "pos", seed: int = 42,
) -> DataFrame:
    """maj@n: mean and deviation of the majority value over resamples of n responses, averaged over prompts."""
    drawn = bootstrap_draws(df.select(source, uid, pos, vote, value), [source, uid], pos, F.lit(n), draws, seed)
    per_draw = majority_value(drawn, [source, uid, "draw"], vote, value, "slot")
    per_prompt = per_draw.groupBy(source, uid).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return per_prompt.groupBy(source).agg(F.avg("m").alias("maj_mean"), F.avg("s").alias("maj_std"))


def label_core(long: DataFrame, source: str = "data_source") -> DataFrame:
    """Section and slash-joined name of every validation metric.

    ``acc`` (or ``reward`` when absent) is the core variable; its mean, maj and best at the largest N are core metrics.
    """
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("bigint")
    tagged = long.withColumn("__n", n)
    per_var = tagged.groupBy(source, "variable").agg(F.max("__n").alias("__nmax"))
    per_source = tagged.groupBy(source).agg(F.max((F.col("variable") == "acc").cast("int")).alias("__acc"))
    out = join_null_safe(join_null_safe(tagged, per_var, [source, "variable"]), per_source, [source])
    core_var = F.when(F.col("__acc") == 1, "acc").otherwise("reward")
    core = (
        (F.col("variable") == core_var) & F.col("metric").rlike("^(mean|maj|best)")
        & F.col("metric").contains(F.concat(F.lit("@"), F.col("__nmax").cast("string")))
    )
    section = F.when(core, "val-core").otherwise("val-aux")
    return out.withColumn("section", section).withColumn(
        "name", F.concat_ws("/", "section", F.col(source), "variable", "metric")
    ).drop("__n", "__nmax", "__acc")


def batch_stats(
    df: DataFrame, max_response: int, max_prompt: int, response: str = "response_length", prompt: str = "prompt_length",
    score: str | None = "score", reward: str | None = None, advantages: str | None = None, returns: str | None = None,
    values: str | None = None, mask: str = "mask",
) -> DataFrame:
    """Length, abort, score and token statistics of a batch in one pass (G7), one row wide."""
    r, p = F.col(response), F.col(prompt)
    alive = r != 0
    aggs: list[Column] = []

    def spread(label: str, col: Column):
        aggs.extend([F.avg(col).alias(f"{label}/mean"), F.max(col).alias(f"{label}/max"), F.min(col).alias(f"{label}/min")])

    spread("response_length", r)
    aggs.append(F.avg((r == max_response).cast("double")).alias("response_length/clip_ratio"))
    spread("response_length_non_aborted", F.when(alive, r))
    aggs.append(F.avg(F.when(alive, (r == max_response).cast("double"))).alias("response_length_non_aborted/clip_ratio"))
    aggs.append(F.avg((~alive).cast("double")).alias("response/aborted_ratio"))
    spread("prompt_length", p)
    aggs.append(F.avg((p == max_prompt).cast("double")).alias("prompt_length/clip_ratio"))
    if score:
        spread("critic/score", F.when(alive, F.col(score)))
    if reward:
        spread("critic/rewards", F.when(alive, F.col(reward)))
    m = F.col(mask)

    def token_spread(label: str, name: str):
        x = F.col(name)
        live = A.mask_count(m) > 0
        aggs.extend([
            (F.sum(A.masked_sum(x, m)) / F.sum(A.mask_count(m))).alias(f"{label}/mean"),
            F.max(F.when(live, A.masked_max(x, m))).alias(f"{label}/max"),
            F.min(F.when(live, A.masked_min(x, m))).alias(f"{label}/min"),
        ])

    if advantages:
        token_spread("critic/advantages", advantages)
    if returns:
        token_spread("critic/returns", returns)
    if returns and values:
        token_spread("critic/values", values)
        gap = F.zip_with(F.col(returns), F.col(values), lambda a, b: a - b)
        n = F.sum(A.mask_count(m))

        def variance(x: Column) -> Column:
            s1, s2 = F.sum(A.masked_sum(x, m)), F.sum(A.masked_sum(A.times(x, x), m))
            return (s2 - s1 * s1 / n) / (n - 1)

        aggs.append(
            (F.lit(1.0) - variance(gap) / (variance(F.col(returns)) + F.lit(1e-5))).alias("critic/vf_explained_var")
        )
    return df.agg(*aggs)


ALL_TOKEN_STAGES = ["ref", "values", "adv", "update_critic", "update_actor"]


def timing_metrics(
    stages: DataFrame, batch: DataFrame, workers: int = 1, stage: str = "stage", seconds: str = "seconds",
    response: str = "response_length", prompt: str = "prompt_length",
) -> DataFrame:
    """Milliseconds per token of each stage and, for stage ``step``, tokens per second and worker."""
    totals = scalar_row(batch.agg(F.sum(response).alias("r"), F.sum(F.col(response) + F.col(prompt)).alias("a")))
    t = stages.withColumn("__t", totals)
    tokens = F.when(F.col(stage) == "gen", F.col("__t.r")).when(F.col(stage).isin(ALL_TOKEN_STAGES), F.col("__t.a"))
    return t.select(
        stage,
        F.col(seconds).alias("timing_s"),
        (F.col(seconds) * 1000 / tokens).alias("per_token_ms"),
        F.when(F.col(stage) == "step", F.col("__t.a") / (F.col(seconds) * workers)).alias("throughput"),
    )


def composition(
    df: DataFrame, fields: Sequence[str], means: Sequence[str] = (), flags: Sequence[str] = (), uid: str = "uid",
    sample: str = "sample_id", source: str = "source", length: str = "length", score: str | None = "score",
) -> DataFrame:
    """Batch composition as (metric, value) rows (G21): counts, share per category value, means, per-source length and score."""
    rows = scalar_row(df.agg(F.count(F.lit(1)).alias("n"), F.max((F.col(score) != 0).cast("int")).alias("live"))
                      if score else df.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("live")))
    head = df.agg(
        F.count(F.lit(1)).alias("num_sequences"), F.countDistinct(uid).alias("num_prompts"),
        F.countDistinct(sample).alias("num_unique_samples"),
        *[F.avg(m).alias(f"{m}/mean") for m in means],
        *[F.avg(F.col(f).cast("boolean").cast("double")).alias(f"{f}/frac") for f in flags],
    )
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    shares = (
        df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())
        .groupBy("field", "value").agg(F.count(F.lit(1)).alias("c"))
        .select(F.concat_ws("/", "field", "value", F.lit("frac")).alias("metric"),
                (F.col("c") / rows["n"]).cast("double").alias("value"))
    )
    per_source = df.filter(F.col(source).isNotNull()).groupBy(source).agg(
        F.avg(length).alias("len"), F.avg(score if score else length).alias("sc")
    )
    base = F.concat(F.lit("source/"), F.col(source))
    split = per_source.select(F.inline(F.array(
        F.struct(F.concat(base, F.lit("/response_length/mean")).alias("metric"), F.col("len").alias("value")),
        F.struct(F.concat(base, F.lit("/score/mean")).alias("metric"),
                 F.when(rows["live"] == 1, F.col("sc")).alias("value")),
    ))).filter(F.col("value").isNotNull())
    return melt_row(head).filter(F.col("value").isNotNull()).unionByName(shares).unionByName(split)


def staleness_stats(
    df: DataFrame, current_version: int | Column, seconds: str = "processing_time", start: str = "param_version_start",
    end: str = "param_version_end", version: str = "param_version",
) -> DataFrame:
    """Processing-time percentiles, partial rollouts and version lag of a batch (G31), one row."""
    cur = current_version if isinstance(current_version, Column) else F.lit(current_version)
    span = F.abs(F.col(end) - F.col(start))
    head = df.agg(
        F.avg(seconds).alias("avg"), F.max(seconds).alias("max"), F.min(seconds).alias("min"),
        F.sum((span != 0).cast("long")).alias("total_partial_num"),
        F.avg((span != 0).cast("double")).alias("partial_ratio"),
        F.max(span).alias("max_partial_span"),
        F.countDistinct(version).alias("param_version_diversity"),
        F.sum((cur - F.col(version) >= 1).cast("long")).alias("stale_samples"),
        F.sum((cur - F.col(end) >= 1).cast("long")).alias("stale_trajectories"),
    )
    tail = scalar_row(linear_percentiles(df, [], seconds, {"tp50": 0.5, "tp95": 0.95, "tp99": 0.99}))
    return head.withColumn("__p", tail).select("*", "__p.tp50", "__p.tp95", "__p.tp99").drop("__p")


register_metric("validation")(validation_metrics)
register_metric("best_at_n")(best_at_n)
register_metric("batch")(batch_stats)
register_metric("composition")(composition)
