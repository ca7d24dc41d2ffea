"""Token-level rollout analytics: importance weights, rejection, KL, divergence, loss modes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import arrays as A
from scoreloom.operators.advantage import path_energy
from scoreloom.operators.groups import scalar_row

RS_OPTIONS = (
    "token_k1", "token_k2", "token_k3",
    "seq_sum_k1", "seq_sum_k2", "seq_sum_k3",
    "seq_mean_k1", "seq_mean_k2", "seq_mean_k3",
    "seq_max_k2", "seq_max_k3",
)


def with_log_ratio(df: DataFrame, old: str = "old_log_prob", rollout: str = "rollout_log_prob") -> DataFrame:
    return df.withColumn("log_ratio", F.zip_with(F.col(old), F.col(rollout), lambda a, b: a - b))


def raw_is_weights(level: str, log_ratio: Column, mask: Column) -> Column:
    """Masked weights before truncation: per token, or the product over the sequence on every token."""
    bound = A.SAFETY_BOUND
    if level == "token":
        return F.zip_with(log_ratio, mask, lambda r, m: F.exp(A.clamp(r, -bound, bound)) * m)
    if level == "sequence":
        whole = F.exp(A.clamp(A.masked_sum(log_ratio, mask), -bound, bound))
        return A.let(whole, lambda w: F.transform(mask, lambda m: w * m))
    raise ValueError(f"unknown weight level: {level}")


def is_weights(
    df: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False,
    log_ratio: str = "log_ratio", mask: str = "mask",
) -> DataFrame:
    """Truncated importance weights (W11), optionally divided by their batch mean."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    m = F.col(mask)
    raw = raw_is_weights(level, F.col(log_ratio), m)
    out = df.withColumn("is_weight", F.transform(raw, lambda w: A.clamp(w, high=threshold)))
    if not normalize:
        return out
    w = F.col("is_weight")
    if level == "token":
        batch = out.agg((F.sum(A.masked_sum(w, m)) / (F.sum(A.mask_count(m)) + F.lit(A.EPS))).alias("mean"))
    else:
        valid = A.mask_count(m) > 0
        batch = out.agg(
            (
                F.sum(F.when(valid, A.masked_mean(w, m)))
                / F.greatest(F.sum(valid.cast("double")), F.lit(A.EPS))
            ).alias("mean")
        )
    mean = scalar_row(batch)["mean"]
    factor = F.when(mean > A.EPS, mean).otherwise(F.lit(1.0))
    out = out.withColumn("__f", factor)
    return out.withColumn("is_weight", F.transform(w, lambda x: x / F.col("__f"))).drop("__f")


def is_metrics(
    df: DataFrame, level: str = "token", threshold: float = 2.0, log_ratio: str = "log_ratio", mask: str = "mask"
) -> DataFrame:
    """One row of weight statistics (G30): spread after clamping, effective sample size, share out of bounds."""
    low = 1.0 / threshold
    m = F.col(mask)
    rows = df.select(
        A.mask_count(m).alias("n"),
        A.masked_sum(F.col(log_ratio), m).alias("lr"),
        m.alias("m"),
        raw_is_weights(level, F.col(log_ratio), m).alias("w"),
    )
    w, mm = F.col("w"), F.col("m")
    clamped = F.transform(w, lambda x: A.clamp(x, low, threshold))
    rows = rows.select(
        "n",
        "lr",
        A.masked_sum(w, mm).alias("sw"),
        A.masked_sum(clamped, mm).alias("sc"),
        A.masked_sum(A.times(clamped, clamped), mm).alias("sc2"),
        F.when(F.col("n") > 0, A.masked_max(w, mm)).alias("wmax"),
        F.when(F.col("n") > 0, A.masked_min(w, mm)).alias("wmin"),
        A.masked_sum(F.transform(w, lambda x: (x > threshold).cast("double")), mm).alias("hi"),
        A.masked_sum(F.transform(w, lambda x: (x < low).cast("double")), mm).alias("lo"),
        A.masked_mean(w, mm).alias("seq"),
    )
    total = F.sum("n") + F.lit(A.EPS)
    if level == "sequence":
        peak = F.exp(F.least(F.max("lr"), F.lit(A.SAFETY_BOUND)))
        bottom = F.exp(F.min("lr"))
        high = F.avg((F.col("lr") > math.log(threshold)).cast("double"))
        lowf = F.avg((F.col("lr") < math.log(low)).cast("double"))
    else:
        peak, bottom = F.max("wmax"), F.min("wmin")
        high, lowf = F.sum("hi") / total, F.sum("lo") / total
    agg = rows.agg(
        (F.sum("sw") / total).alias("is_mean"),
        peak.alias("is_max"),
        bottom.alias("is_min"),
        high.alias("fraction_high"),
        lowf.alias("fraction_low"),
        (F.sum("sc") / total).alias("__cm"),
        (F.sum("sc2") / total).alias("__c2"),
        F.sum("n").alias("__n"),
        F.avg("seq").alias("seq_mean"),
        F.coalesce(F.stddev_samp("seq"), F.lit(0.0)).alias("seq_std"),
        F.max("seq").alias("seq_max"),
        F.min("seq").alias("seq_min"),
        F.max(F.abs(F.col("seq") - 1.0)).alias("seq_max_deviation"),
        F.avg((F.col("seq") > threshold).cast("double")).alias("seq_fraction_high"),
        F.avg((F.col("seq") < low).cast("double")).alias("seq_fraction_low"),
    )
    var = F.greatest(F.col("__c2") - F.col("__cm") * F.col("__cm"), F.lit(0.0))
    ess = F.pow(F.col("__cm") + F.lit(A.EPS), F.lit(2.0)) / F.col("__c2")
    return (
        agg.withColumn("is_std", F.when(F.col("__n") > 1, F.sqrt(var)).otherwise(F.lit(0.0)))
        .withColumn("eff_sample_size", ess)
        .drop("__cm", "__c2", "__n")
    )


def parse_rs_thresholds(options: list[str], spec: str | float) -> dict[str, tuple[float | None, float]]:
    """``lower_upper`` (or one number, its inverse being the lower bound) for k1 options, one bound for the rest."""
    parts = [p.strip() for p in str(spec).split(",") if p.strip()]
    if len(parts) == 1:
        parts = parts * len(options)
    if len(parts) != len(options):
        raise ValueError("give one threshold, or one per option")
    bounds: dict[str, tuple[float | None, float]] = {}
    for option, part in zip(options, parts):
        if option.endswith("k1"):
            low, high = part.split("_", 1) if "_" in part else (str(1.0 / float(part)), part)
            pair = (float(low), float(high))
        elif "_" in part:
            raise ValueError(f"{option} takes one upper bound")
        else:
            pair = (None, float(part))
        if pair[1] <= 0 or (pair[0] is not None and pair[0] <= 0):
            raise ValueError("thresholds must be positive")
        bounds[option] = pair
    return bounds


def _rs_token_values(kind: str, log_ratio: Column) -> Column:
    b = A.SAFETY_BOUND

    def value(raw: Column) -> Column:
        r = A.clamp(raw, -b, b)
        if kind == "k1":
            return -r
        if kind == "k2":
            return F.lit(0.5) * r * r
        return F.exp(r) - F.lit(1.0) - r

    return F.transform(log_ratio, value)


def rejection_mask(
    df: DataFrame, options: str, thresholds: str | float, log_ratio: str = "log_ratio", mask: str = "mask"
) -> DataFrame:
    """Hard trust region (W12): every option must pass; k1 bounds apply in log space.

    Adds ``rs_mask`` (mask times all verdicts) and one ``keep_<option>`` array per option.
    """
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    unknown = [n for n in names if n not in RS_OPTIONS]
    if unknown or not names:
        raise ValueError(f"unknown rejection options: {unknown}")
    bounds = parse_rs_thresholds(names, thresholds)
    m = F.col(mask)
    out = df
    for name in names:
        kind = name[-2:]
        low, high = bounds[name]
        lo, hi = (math.log(low), math.log(high)) if kind == "k1" else (None, high)

        def passes(x: Column) -> Column:
            ok = x <= F.lit(hi)
            return ok if lo is None else ok & (x >= F.lit(lo))

        values = _rs_token_values(kind, F.col(log_ratio))
        if name.startswith("token"):
            out = out.withColumn(f"stat_{name}", values)
            keep = F.transform(F.col(f"stat_{name}"), lambda x: passes(x).cast("double"))
        else:
            reduce = {"sum": A.masked_sum, "mean": A.masked_mean, "max": A.masked_max}[name.split("_")[1]]
            out = out.withColumn(f"stat_{name}", reduce(values, m))
            verdict = passes(F.col(f"stat_{name}")).cast("double")
            keep = F.array_repeat(verdict, F.size(m))
        out = out.withColumn(f"keep_{name}", keep)
    combined = m
    for name in names:
        combined = F.zip_with(combined, F.col(f"keep_{name}"), lambda a, b: a * b)
    return out.withColumn("rs_mask", combined)


def rejection_metrics(masked: DataFrame, options: str, thresholds: str | float, mask: str = "mask") -> DataFrame:
    """Long table of masked fractions and statistic summaries per option of a :func:`rejection_mask` result."""
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    bounds = parse_rs_thresholds(names, thresholds)
    m = F.col(mask)
    n = A.mask_count(m)
    rows = masked.withColumn("__n", n)
    aggs: list[Column] = []
    labels: list[tuple[str, str]] = []

    def add(option: str, metric: str, col: Column):
        aggs.append(col.alias(f"c{len(aggs)}"))
        labels.append((option, metric))

    total = F.sum("__n") + F.lit(A.EPS)
    valid = F.col("__n") > 0
    for name in names:
        low, high = bounds[name]
        k1 = name.endswith("k1")
        hi = math.log(high) if k1 else high
        lo = math.log(low) if k1 else 0.0
        keep, stat = F.col(f"keep_{name}"), F.col(f"stat_{name}")
        kept = A.masked_sum(keep, m)
        add(name, "masked_fraction", F.sum(F.col("__n") - kept) / total)
        add(name, "seq_masked_fraction", F.avg(F.when(valid, (kept < F.col("__n")).cast("double"))))
        token = name.startswith("token")
        seq = A.masked_mean(stat, m) if token else stat
        if token:
            add(name, "mean", F.sum(A.masked_sum(stat, m)) / total)
            add(name, "max", F.max(F.when(valid, A.masked_max(stat, m))))
            add(name, "min", F.min(F.when(valid, A.masked_min(stat, m))))
            add(name, "fraction_high", F.sum(A.masked_sum(F.transform(stat, lambda x: (x > hi).cast("double")), m)) / total)
            clamped = F.transform(stat, lambda x: A.clamp(x, lo, hi))
            s1, s2 = A.masked_sum(clamped, m), A.masked_sum(A.times(clamped, clamped), m)
        else:
            add(name, "mean", F.sum(stat * F.col("__n")) / total)
            add(name, "max", F.max(F.when(valid, stat)))
            add(name, "min", F.min(F.when(valid, stat)))
            add(name, "fraction_high", F.avg(F.when(valid, (stat > hi).cast("double"))))
            clamped = A.clamp(stat, lo, hi)
            s1, s2 = clamped * F.col("__n"), clamped * clamped * F.col("__n")
        mean = F.sum(s1) / total
        add(name, "std", F.sqrt(F.greatest(F.sum(s2) / total - mean * mean, F.lit(0.0))))
        add(name, "seq_mean", F.avg(F.when(valid, seq)))
        add(name, "seq_std", F.coalesce(F.stddev_samp(F.when(valid, seq)), F.lit(0.0)))
        add(name, "seq_fraction_high", F.avg(F.when(valid, (seq > hi).cast("double"))))
        if k1:
            add(name, "seq_fraction_low", F.avg(F.when(valid, (seq < lo).cast("double"))))
    left = A.masked_sum(F.col("rs_mask"), m)
    add("all", "masked_fraction", F.sum(F.col("__n") - left) / total)
    add("all", "seq_masked_fraction", F.avg((left < F.col("__n")).cast("double")))
    one = rows.agg(*aggs)
    entries = [
        F.struct(F.lit(o).alias("option"), F.lit(k).alias("metric"), F.col(f"c{i}").alias("value"))
        for i, (o, k) in enumerate(labels)
    ]
    return one.select(F.inline(F.array(*entries)))


def kl_estimate(kind: str, log_prob: Column, ref: Column) -> Column:
    """Per-token KL estimators k1, abs, k2 and the clamped low-variance k3."""
    d = log_prob - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return F.lit(0.5) * d * d
    if kind in ("low_var_kl", "k3"):
        r = A.clamp(-d, -A.SAFETY_BOUND, A.SAFETY_BOUND)
        return A.clamp(F.exp(r) - r - F.lit(1.0), -10.0, 10.0)
    raise ValueError(f"unknown KL estimator: {kind}")


def kl_penalty(
    df: DataFrame, kind: str = "k1", beta: float | Column = 0.001, scores: str = "score_tokens",
    log_prob: str = "old_log_prob", ref: str = "ref_log_prob", mask: str = "mask",
) -> DataFrame:
    """Token rewards ``score - beta * kl * mask`` and the row's mean KL."""
    b = beta if isinstance(beta, Column) else F.lit(float(beta))
    kl = F.zip_with(F.col(log_prob), F.col(ref), lambda a, r: kl_estimate(kind, a, r))
    out = df.withColumn("kl", A.times(kl, F.col(mask)))
    out = out.withColumn("kl_mean", A.masked_mean(F.col("kl"), F.col(mask)))
    return out.withColumn("token_reward", F.zip_with(F.col(scores), F.col("kl"), lambda s, k: s - b * k))


def kl_coefficients(
    steps: DataFrame, init: float, target: float, horizon: float, step: str = "step", kl: str = "kl", n: str = "n"
) -> DataFrame:
    """Coefficient in force at each step, and after it: each step multiplies it by a clipped error term.

    The input has one row per step, so the ordered product runs over the step table only.
    """
    if horizon <= 0:
        raise ValueError("horizon must be positive")
    err = A.clamp(F.col(kl) / F.lit(float(target)) - F.lit(1.0), -0.2, 0.2)
    factor = F.lit(1.0) + err * F.col(n) / F.lit(float(horizon))
    w = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    size = F.exp(F.sum(F.log(F.when(F.col("__x") != 0, F.abs(F.col("__x"))))).over(w))
    flips = F.sum((F.col("__x") < 0).cast("int")).over(w)
    zeros = F.sum((F.col("__x") == 0).cast("int")).over(w)
    after = F.when(zeros > 0, F.lit(0.0)).otherwise(
        F.lit(float(init)) * F.coalesce(size, F.lit(1.0)) * F.when(flips % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    )
    out = steps.withColumn("__x", factor).withColumn("coef_after", after)
    before = F.lag("coef_after", 1).over(Window.orderBy(step))
    return out.withColumn("coef", F.coalesce(before, F.lit(float(init)))).drop("__x")


def _with_tail(lp: Column) -> Column:
    total = F.least(A.log_sum_exp(lp), F.lit(-1e-7))
    return F.concat(lp, F.array(F.log(-F.expm1(total))))


def renormalise(lp: Column) -> Column:
    """Rescale log-probabilities so that they sum to one."""
    return A.let(A.log_sum_exp(lp), lambda z: F.transform(lp, lambda x: x - z))


def divergence(student: Column, teacher: Column, alpha: float, tail: str | None = "tail") -> Column:
    """Divergence of two top-k log-probability arrays: forward KL at 0, reverse KL at 1, else generalised JSD.

    ``tail='tail'`` adds the left-over mass as one more entry, ``'renorm'`` rescales, ``None`` takes the arrays as complete.
    """
    if tail == "tail":
        student, teacher = _with_tail(student), _with_tail(teacher)
    elif tail == "renorm":
        student, teacher = renormalise(student), renormalise(teacher)

    def term(s: Column, t: Column) -> Column:
        if alpha == 0.0:
            return F.exp(t) * (t - s)
        if alpha == 1.0:
            return F.exp(s) * (s - t)
        a, b = s + F.lit(math.log(1.0 - alpha)), t + F.lit(math.log(alpha))
        peak = F.greatest(a, b)
        mix = peak + F.log(F.exp(a - peak) + F.exp(b - peak))
        from_student, from_teacher = F.exp(s) * (s - mix), F.exp(t) * (t - mix)
        return from_student + F.lit(alpha) * (from_teacher - from_student)

    return A.array_total(F.zip_with(student, teacher, term))


def distill_divergence(
    tokens: DataFrame, alpha: float, tail: str | None = "tail", is_clip: float | None = None,
    student: str = "student", teacher: str = "teacher", log_prob: str = "log_prob", old_log_prob: str = "old_log_prob",
    weight: str | None = None,
) -> DataFrame:
    """Per-token divergence table (W15), raw and weighted by the clipped policy ratio and rollout weights."""
    out = tokens.withColumn("divergence", divergence(F.col(student), F.col(teacher), alpha, tail))
    weighted = F.col("divergence")
    if is_clip is not None:
        ratio = F.exp(A.clamp(F.col(log_prob) - F.col(old_log_prob), -A.SAFETY_BOUND, A.SAFETY_BOUND))
        weighted = weighted * A.clamp(ratio, high=is_clip)
    if weight:
        weighted = weighted * F.col(weight)
    return out.withColumn("weighted_divergence", weighted)


def sampled_reverse_kl(log_prob: Column, teacher_log_prob: Column) -> Column:
    """The single-sample form used when only the chosen token's log-probability is known."""
    return (log_prob - teacher_log_prob) * log_prob


def divergence_summary(tokens: DataFrame, mask: str = "m") -> DataFrame:
    m = F.col(mask)
    n = F.greatest(F.sum(m), F.lit(1.0))
    return tokens.agg(
        (F.sum(F.col("divergence") * m) / n).alias("raw_token_mean"),
        (F.sum(F.col("weighted_divergence") * m) / n).alias("weighted_token_mean"),
        F.sum(m).alias("num_tokens"),
    )


def agg_tokens(df: DataFrame, mode: str, values: str = "loss", mask: str = "mask", scale: float | None = None) -> DataFrame:
    """One loss number per mode (G28); sequences without a valid token do not count."""
    m = F.col(mask)
    rows = df.select(A.masked_sum(F.col(values), m).alias("s"), A.mask_count(m).alias("n"), F.size(m).alias("width"))
    live = (F.col("n") > 0).cast("double")
    if mode == "token-mean":
        value = F.sum("s") / F.sum("n")
    elif mode == "seq-mean-token-sum":
        value = F.sum(F.col("s") * live) / F.sum(live)
    elif mode == "seq-mean-token-mean":
        value = F.sum(F.col("s") / (F.col("n") + F.lit(A.EPS)) * live) / F.sum(live)
    elif mode == "seq-mean-token-sum-norm":
        value = F.sum("s") / (F.lit(float(scale)) if scale else F.max("width"))
    else:
        raise ValueError(f"unknown loss mode: {mode}")
    return rows.agg(value.alias("loss")).withColumn("mode", F.lit(mode))


def offpolicy_metrics(
    df: DataFrame, old: str = "old_log_prob", rollout: str = "rollout_log_prob", mask: str = "mask"
) -> DataFrame:
    """Policy mismatch in one row (G29): perplexities, KL estimates and chi-square at token and sequence level."""
    m = F.col(mask)
    bound = A.SAFETY_BOUND
    lr = F.zip_with(F.col(old), F.col(rollout), lambda a, b: a - b)
    rows = df.select(
        A.mask_count(m).alias("n"),
        A.masked_mean(F.col(old), m).alias("lt"),
        A.masked_mean(F.col(rollout), m).alias("lr"),
        A.masked_sum(lr, m).alias("ratio"),
        A.masked_sum(F.transform(lr, lambda x: F.exp(x) - x - F.lit(1.0)), m).alias("k3"),
        A.masked_sum(F.transform(lr, lambda x: F.exp(F.lit(2.0) * A.clamp(x, -bound, bound))), m).alias("rho2"),
    )
    diff = F.col("lr") - F.col("lt")
    total = F.sum("n") + F.lit(A.EPS)
    return rows.agg(
        F.avg(F.exp(-F.col("lt"))).alias("training_ppl"),
        F.avg(-F.col("lt")).alias("training_log_ppl"),
        (-F.sum("ratio") / total).alias("kl"),
        (F.sum("k3") / total).alias("k3_kl"),
        F.avg(F.exp(-F.col("lr"))).alias("rollout_ppl"),
        F.avg(-F.col("lr")).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"),
        F.avg(F.abs(diff)).alias("log_ppl_abs_diff"),
        F.max(diff).alias("log_ppl_diff_max"),
        F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"),
        (F.sum("rho2") / total - F.lit(1.0)).alias("chi2_token"),
        (F.avg(F.exp(F.lit(2.0) * A.clamp(F.col("ratio"), -bound, bound))) - F.lit(1.0)).alias("chi2_seq"),
    )


def variance_proxy(
    df: DataFrame, gradient_norm: float | None = None, weight: str | None = None, advantages: str = "advantages",
    log_prob: str = "old_log_prob", sum_pi_squared: str = "sum_pi_squared", mask: str = "mask",
) -> DataFrame:
    """Gradient variance proxies from advantages and path energy."""
    m = F.col(mask)
    wcol = F.col(weight) if weight else None
    energy = path_energy(F.col(log_prob), F.col(sum_pi_squared), wcol)
    plain = A.masked_sum(path_energy(F.col(log_prob), F.col(sum_pi_squared)), m)
    rows = df.select(
        A.masked_mean(F.col(advantages), m).alias("a"),
        A.masked_sum(energy, m).alias("w"),
        F.greatest(plain, F.lit(0.0)).alias("w0"),
        (A.masked_mean(wcol, m) if weight else F.lit(1.0)).alias("rho"),
    )
    a2 = F.col("a") * F.col("a")
    power = F.avg(F.col("rho") * F.col("rho") * a2 * F.col("w0"))
    out = rows.agg(
        power.alias("proxy2_total_power"),
        F.avg(a2).alias("expected_a_squared"),
        F.avg("w").alias("expected_w"),
        F.count(F.lit(1)).alias("__n"),
    )
    if gradient_norm is None:
        signal, noise = F.lit(0.0), F.lit(0.0)
    else:
        signal = F.lit(float(gradient_norm) ** 2)
        noise = F.when(
            F.col("__n") > 1,
            F.greatest((F.col("proxy2_total_power") - signal) / (F.col("__n") - 1), F.lit(0.0)),
        ).otherwise(F.lit(0.0))
    return out.withColumn("proxy1_signal_strength", signal).withColumn("proxy3_pure_noise", noise).drop("__n")
