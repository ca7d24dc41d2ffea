"""Group-relative and token-level advantage estimators (survey rows W1-W10) behind one registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import arrays as A
from scoreloom.operators.groups import lookup_by_group, scalar_row, with_group_stats

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_estimator(name: str):
    """Make ``fn(df, **options) -> df`` selectable by name; a name can only mean one function."""

    def wrap(fn):
        if ESTIMATORS.get(name, fn) is not fn:
            raise ValueError(f"estimator already registered: {name}")
        ESTIMATORS[name] = fn
        return fn

    return wrap


def estimate(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in ESTIMATORS:
        raise ValueError(f"unknown estimator: {name}")
    return ESTIMATORS[name](df, **options)


@register_estimator("grpo")
def adv_grpo(
    df: DataFrame, uid: str = "uid", score: str = "score", norm: bool = True, eps: float = 1e-6,
    floor_variance: bool = False,
) -> DataFrame:
    """Score minus group mean, over the sample standard deviation. A lone response keeps its score.

    ``floor_variance`` selects the vectorised form, where the variance never falls below ``eps``.
    """
    s = F.col(score)
    spread = F.stddev_samp(s)
    if floor_variance:
        spread = F.sqrt(F.greatest(F.var_samp(s), F.lit(eps)))
    out = with_group_stats(df, [uid], [F.avg(s).alias("__m"), spread.alias("__s"), F.count(s).alias("__n")])
    lone = F.col("__n") <= 1
    mean = F.when(lone, F.lit(0.0)).otherwise(F.col("__m"))
    std = F.when(lone, F.lit(1.0)).otherwise(F.col("__s"))
    adv = (s - mean) / (std + F.lit(eps)) if norm else s - mean
    return out.withColumn("advantage", adv).drop("__m", "__s", "__n")


@register_estimator("grpo_vectorized")
def adv_grpo_vectorized(df: DataFrame, **options) -> DataFrame:
    return adv_grpo(df, floor_variance=True, **options)


def top_two(df: DataFrame, uid: str, value: Column, pos: str) -> DataFrame:
    """Per group: size, best value, position of the first best row, second value (null for one row).

    The rank filter is limited per map task before the shuffle, so a hot group ships two rows per task.
    """
    w = Window.partitionBy(uid).orderBy(F.col("__v").desc(), F.col(pos))
    lead = (
        df.select(uid, pos, value.alias("__v"))
        .withColumn("__rn", F.row_number().over(w))
        .filter(F.col("__rn") <= 2)
    )
    return lead.groupBy(uid).agg(
        F.max(F.when(F.col("__rn") == 1, F.col("__v"))).alias("__r1"),
        F.max(F.when(F.col("__rn") == 1, F.col(pos))).alias("__p1"),
        F.max(F.when(F.col("__rn") == 2, F.col("__v"))).alias("__r2"),
    )


@register_estimator("grpo_passk")
def adv_passk(
    df: DataFrame, uid: str = "uid", score: str = "score", pos: str = "pos", norm: bool = True, eps: float = 1e-6
) -> DataFrame:
    """Only the best response of a group is credited, with its lead over the runner-up."""
    s = F.col(score)
    stats = (
        df.groupBy(uid).agg(F.stddev_samp(s).alias("__s"), F.count(F.lit(1)).alias("__size"))
        .join(top_two(df, uid, s, pos), uid)
    )
    out = lookup_by_group(df, stats, [uid], "__size", "inner")
    gap = F.col("__r1") - F.col("__r2")
    if norm:
        gap = gap / (F.col("__s") + F.lit(eps))
    adv = (
        F.when(F.col("__size") < 2, F.raise_error(F.lit("pass@k needs at least two responses per group")).cast("double"))
        .when(F.col(pos) == F.col("__p1"), gap)
        .otherwise(F.lit(0.0))
    )
    return out.withColumn("advantage", adv).drop("__s", "__size", "__r1", "__p1", "__r2")


@register_estimator("rloo")
def adv_rloo(df: DataFrame, uid: str = "uid", score: str = "score", vectorized: bool = False) -> DataFrame:
    """Leave-one-out baseline. A lone response keeps its score, or gets 0 in the vectorised form."""
    s = F.col(score)
    out = with_group_stats(df, [uid], [F.avg(s).alias("__m"), F.count(s).alias("__n")])
    n = F.col("__n")
    lone = F.lit(0.0) if vectorized else s
    adv = F.when(n > 1, (s - F.col("__m")) * n / (n - 1)).otherwise(lone)
    return out.withColumn("advantage", adv).drop("__m", "__n")


@register_estimator("rloo_vectorized")
def adv_rloo_vectorized(df: DataFrame, **options) -> DataFrame:
    return adv_rloo(df, vectorized=True, **options)


@register_estimator("reinforce_plus_plus_baseline")
def adv_rpp_baseline(df: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Group-centred score, whitened over all valid tokens (each row counts ``length`` times)."""
    s = F.col(score)
    out = with_group_stats(df, [uid], [F.avg(s).alias("__m"), F.count(s).alias("__n")])
    out = out.withColumn("__c", s - F.when(F.col("__n") <= 1, F.lit(0.0)).otherwise(F.col("__m")))
    w, c = F.col(length), F.col("__c")
    moments = scalar_row(
        out.agg(F.sum(w).alias("n"), F.sum(w * c).alias("s1"), F.sum(w * c * c).alias("s2"))
    )
    bound = out.withColumn("__mo", moments)
    return bound.withColumn("advantage", _whiten(c, F.col("__mo"))).drop("__m", "__n", "__c", "__mo")


def _whiten(value: Column, moments: Column) -> Column:
    n, s1, s2 = moments["n"], moments["s1"], moments["s2"]
    mean = s1 / (n + F.lit(A.EPS))
    var = (s2 - F.lit(2.0) * mean * s1 + mean * mean * n) / (n + F.lit(A.EPS)) * n / (n - 1)
    return (value - mean) / F.sqrt(var + F.lit(A.EPS))


def whiten_tokens(df: DataFrame, values: str, mask: str, name: str) -> DataFrame:
    """Masked whitening of a token array over the whole table."""
    v, m = F.col(values), F.col(mask)
    moments = scalar_row(
        df.agg(
            F.sum(A.mask_count(m)).alias("n"),
            F.sum(A.masked_sum(v, m)).alias("s1"),
            F.sum(A.masked_sum(A.times(v, v), m)).alias("s2"),
        )
    )
    scaled = df.withColumn("__mo", moments)
    return scaled.withColumn(
        name, F.transform(v, lambda x: _whiten(x, F.col("__mo")))
    ).drop("__mo")


@register_estimator("opo")
def adv_opo(df: DataFrame, uid: str = "uid", score: str = "score", length: str = "length") -> DataFrame:
    """Length-weighted group mean as the baseline; a lone response keeps its score."""
    s, ln = F.col(score), F.col(length)
    out = with_group_stats(
        df, [uid], [F.sum(s * ln).alias("__sl"), F.sum(ln).alias("__l"), F.count(s).alias("__n")]
    )
    base = F.when(F.col("__n") <= 1, F.lit(0.0)).otherwise(F.col("__sl") / F.col("__l"))
    return out.withColumn("advantage", s - base).drop("__sl", "__l", "__n")


@register_estimator("gpg")
def adv_gpg(df: DataFrame, uid: str = "uid", score: str = "score", f_norm: float = 1.0) -> DataFrame:
    """Centred score scaled by batch size over the number of non-zero scores of the batch."""
    s = F.col(score)
    out = with_group_stats(df, [uid], [F.avg(s).alias("__m"), F.count(s).alias("__n")])
    batch = scalar_row(
        df.agg(F.count(F.lit(1)).alias("n"), F.sum((s != 0).cast("long")).alias("nz"))
    )
    alpha = batch["n"] / F.greatest(batch["nz"], F.lit(1))
    mean = F.when(F.col("__n") <= 1, F.lit(0.0)).otherwise(F.col("__m"))
    return out.withColumn("advantage", alpha * (s - mean) / F.lit(f_norm)).drop("__m", "__n")


@register_estimator("remax")
def adv_remax(
    df: DataFrame, rewards: str = "reward", mask: str = "mask", baseline: str = "baseline"
) -> DataFrame:
    """Reward to go minus the row's own baseline, per token."""
    to_go = A.reverse_cumulative(A.times(F.col(rewards), F.col(mask)))
    out = df.withColumn("returns", to_go)
    adv = F.zip_with(F.col("returns"), F.col(mask), lambda g, m: g - F.col(baseline) * m)
    return out.withColumn("advantages", adv)


@register_estimator("reinforce_plus_plus")
def returns_discounted(
    df: DataFrame, gamma: float = 1.0, rewards: str = "reward", mask: str = "mask"
) -> DataFrame:
    """Discounted reward to go and its masked whitening."""
    out = df.withColumn("returns", A.discounted_returns(F.col(rewards), F.col(mask), gamma))
    out = whiten_tokens(out, "returns", mask, "advantages")
    return out.withColumn("advantages", A.times(F.col("advantages"), F.col(mask)))


@register_estimator("gae")
def gae(
    df: DataFrame, gamma: float = 1.0, lam: float = 1.0, rewards: str = "reward", values: str = "value",
    mask: str = "mask",
) -> DataFrame:
    raw = A.lambda_advantages(F.col(rewards), F.col(values), F.col(mask), gamma, lam)
    out = df.withColumn("__adv", raw)
    out = out.withColumn("returns", F.zip_with(F.col("__adv"), F.col(values), lambda a, v: a + v))
    return whiten_tokens(out, "__adv", mask, "advantages").drop("__adv")


def path_energy(log_prob: Column, sum_pi_squared: Column, weight: Column | None = None) -> Column:
    """Per-token score-norm proxy ``1 - 2p + sum p^2``, scaled by the squared importance weight if given."""
    energy = F.zip_with(log_prob, sum_pi_squared, lambda lp, sq: F.lit(1.0) - F.lit(2.0) * F.exp(lp) + sq)
    return energy if weight is None else F.zip_with(energy, weight, lambda e, w: e * w * w)


@register_estimator("optimal_token_baseline")
def adv_otb(
    df: DataFrame, uid: str = "uid", pos: str = "pos", rewards: str = "reward", mask: str = "mask",
    log_prob: str = "old_log_prob", sum_pi_squared: str = "sum_pi_squared", weight: str | None = None,
    zero_tail: bool = False, align: str = "time",
) -> DataFrame:
    """Per-position baseline ``sum(G W) / sum(W)`` over the group, W being the running path energy.

    ``align='valid'`` counts positions over unmasked tokens only (multi-turn responses with tool output
    between turns). ``zero_tail`` drops the baseline where the single longest response runs alone.
    """
    m = F.col(mask)
    out = df.withColumn("returns", A.reverse_cumulative(A.times(F.col(rewards), m)))
    energy = path_energy(F.col(log_prob), F.col(sum_pi_squared), F.col(weight) if weight else None)
    out = out.withColumn("__w", A.cumulative(A.times(energy, m)))
    out = out.withColumn("__len", A.mask_count(m).cast("int"))
    if align == "valid":
        out = out.withColumn("__slot", A.cumulative(m))
    else:
        out = out.withColumn("__slot", F.transform(m, lambda x, i: (i + 1).cast("double")))

    tokens = out.filter(F.col("__len") > 0) if align == "valid" else out
    flat = tokens.select(
        uid, F.explode(F.arrays_zip(F.col("returns").alias("g"), F.col("__w").alias("w"), m.alias("m"),
                                    F.col("__slot").alias("slot"))).alias("z")
    )
    if align == "valid":
        flat = flat.filter(F.col("z.m") != 0)
    per_slot = flat.groupBy(uid, F.col("z.slot").cast("int").alias("slot")).agg(
        F.sum(F.col("z.g") * F.col("z.w") * F.col("z.m")).alias("gw"), F.sum(F.col("z.w") * F.col("z.m")).alias("w")
    )
    base = per_slot.groupBy(uid).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("slot"), (F.col("gw") / (F.col("w") + F.lit(A.EPS))).alias("b")))),
            lambda e: e["b"],
        ).alias("__base")
    )
    sizes = tokens.groupBy(uid).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.join(df.groupBy(uid).agg(F.count(F.lit(1)).alias("__size")), uid)
    side = sizes.join(base, uid, "left").join(top_two(tokens, uid, F.col("__len"), pos), uid, "left")
    out = lookup_by_group(out, side, [uid], "__size", "left")
    alone = (
        (F.col(pos) == F.col("__p1")) & (F.col("__r1") > F.col("__r2")) if zero_tail else F.lit(False)
    )

    def minus_baseline(g: Column, k: Column) -> Column:
        slot = k["slot"].cast("int")
        use = (F.col("__n") > 1) & ~(alone & (slot > F.coalesce(F.col("__r2"), F.lit(0))))
        b = F.when(use, F.coalesce(F.get(F.col("__base"), slot - 1), F.lit(0.0))).otherwise(F.lit(0.0))
        return F.when(k["m"] != 0, (g - b) * k["m"]).otherwise(F.lit(0.0))

    keyed = F.arrays_zip(F.col("__slot").alias("slot"), m.alias("m"))
    out = out.withColumn("advantages", F.zip_with(F.col("returns"), keyed, minus_baseline))
    return out.drop("__w", "__len", "__slot", "__n", "__size", "__base", "__r1", "__p1", "__r2")


@register_estimator("tir_optimal_token_baseline")
def adv_otb_multi_turn(df: DataFrame, **options) -> DataFrame:
    return adv_otb(df, align="valid", **options)


def overlong(
    df: DataFrame, max_len: int, buffer: int, factor: float, length: str = "length", reward: str = "reward"
) -> DataFrame:
    """Linear penalty inside the last ``buffer`` tokens, never positive, added to the reward."""
    exceed = F.col(length) - F.lit(max_len - buffer)
    penalty = F.least(-exceed / F.lit(float(buffer)) * F.lit(float(factor)), F.lit(0.0))
    return df.withColumn("overlong_reward", penalty).withColumn(reward, F.col(reward) + F.col("overlong_reward"))
