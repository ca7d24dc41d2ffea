"""Advantage and token queries: W1-W15, G9, G28-G30, P15."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from scoreloom.functions import arrays as A
from scoreloom.operators import advantage as adv
from scoreloom.operators import rollout as ro
from scoreloom.plans.catalog import register
from scoreloom.plans.fixtures import ROLLOUT_SQL, TOKEN_SQL, per_token, rollouts, token_series

_ADV = "pos:l uid:s advantage:d"


@register("w1_adv_grpo", _ADV, f"""
WITH {ROLLOUT_SQL}, g AS (SELECT uid, avg(score) m, stddev_samp(score) s, count(*) n FROM rollouts GROUP BY uid)
SELECT pos, r.uid, CASE WHEN n = 1 THEN score / (1 + 1e-6::DOUBLE) ELSE (score - m) / (s + 1e-6::DOUBLE) END AS advantage
FROM rollouts r JOIN g ON r.uid = g.uid""")
def _w1(spark, sf):
    return adv.estimate(rollouts(spark, sf), "grpo")


@register("w1_adv_grpo_centered", _ADV, f"""
WITH {ROLLOUT_SQL}, g AS (SELECT uid, avg(score) m, count(*) n FROM rollouts GROUP BY uid)
SELECT pos, r.uid, CASE WHEN n = 1 THEN score ELSE score - m END AS advantage
FROM rollouts r JOIN g ON r.uid = g.uid""")
def _w1c(spark, sf):
    return adv.estimate(rollouts(spark, sf), "grpo", norm=False)


@register("w1_adv_grpo_vectorized", _ADV, f"""
WITH {ROLLOUT_SQL}, g AS (SELECT uid, avg(score) m, sqrt(greatest(var_samp(score), 1e-6::DOUBLE)) s, count(*) n FROM rollouts GROUP BY uid)
SELECT pos, r.uid, CASE WHEN n = 1 THEN score / (1 + 1e-6::DOUBLE) ELSE (score - m) / (s + 1e-6::DOUBLE) END AS advantage
FROM rollouts r JOIN g ON r.uid = g.uid""")
def _w1v(spark, sf):
    return adv.estimate(rollouts(spark, sf), "grpo_vectorized")


@register("w2_adv_passk", _ADV, f"""
WITH {ROLLOUT_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, pos) rn, count(*) OVER (PARTITION BY uid) n,
         stddev_samp(score) OVER (PARTITION BY uid) s FROM rollouts),
r2 AS (SELECT *, max(CASE WHEN rn = 1 THEN score END) OVER (PARTITION BY uid) a,
          max(CASE WHEN rn = 2 THEN score END) OVER (PARTITION BY uid) b FROM r WHERE n > 1)
SELECT pos, uid, CASE WHEN rn = 1 THEN (a - b) / (s + 1e-6::DOUBLE) ELSE 0 END AS advantage FROM r2""")
def _w2(spark, sf):
    r = rollouts(spark, sf)
    big = r.groupBy("uid").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("uid")
    return adv.estimate(r.join(big, "uid", "left_semi"), "grpo_passk")


@register("w3_adv_rloo", _ADV, f"""
WITH {ROLLOUT_SQL}, g AS (SELECT uid, avg(score) m, count(*) n FROM rollouts GROUP BY uid)
SELECT pos, r.uid, CASE WHEN n = 1 THEN score ELSE score * n / (n - 1) - m * n / (n - 1) END AS advantage
FROM rollouts r JOIN g ON r.uid = g.uid""")
def _w3(spark, sf):
    return adv.estimate(rollouts(spark, sf), "rloo")


@register("w3_adv_rloo_vectorized", _ADV, f"""
WITH {ROLLOUT_SQL}, g AS (SELECT uid, sum(score) s, count(*) n FROM rollouts GROUP BY uid)
SELECT pos, r.uid, CASE WHEN n = 1 THEN 0 ELSE (n * score - s) / (n - 1) END AS advantage
FROM rollouts r JOIN g ON r.uid = g.uid""")
def _w3v(spark, sf):
    return adv.estimate(rollouts(spark, sf), "rloo_vectorized")


@register("w4_adv_rpp_baseline", _ADV, f"""
WITH {ROLLOUT_SQL}, g AS (SELECT uid, avg(score) m, count(*) n FROM rollouts GROUP BY uid),
c AS (SELECT pos, r.uid, length, CASE WHEN n = 1 THEN score ELSE score - m END AS c FROM rollouts r JOIN g ON r.uid = g.uid),
mo AS (SELECT sum(length) n, sum(length * c) / (sum(length) + 1e-8::DOUBLE) mean FROM c),
va AS (SELECT sum(length * (c - mean) * (c - mean)) / (any_value(n) + 1e-8::DOUBLE) * any_value(n) / (any_value(n) - 1) v FROM c, mo)
SELECT pos, uid, (c - mean) / sqrt(v + 1e-8::DOUBLE) AS advantage FROM c, mo, va""")
def _w4(spark, sf):
    return adv.estimate(rollouts(spark, sf), "reinforce_plus_plus_baseline")


@register("w5_adv_opo", _ADV, f"""
WITH {ROLLOUT_SQL}, g AS (SELECT uid, sum(score * length) / sum(length) m, count(*) n FROM rollouts GROUP BY uid)
SELECT pos, r.uid, CASE WHEN n = 1 THEN score ELSE score - m END AS advantage FROM rollouts r JOIN g ON r.uid = g.uid""")
def _w5(spark, sf):
    return adv.estimate(rollouts(spark, sf), "opo")


@register("w6_adv_gpg", _ADV, f"""
WITH {ROLLOUT_SQL}, s AS (SELECT * REPLACE (CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE score END AS score) FROM rollouts),
g AS (SELECT uid, avg(score) m, count(*) n FROM s GROUP BY uid),
b AS (SELECT count(*) / greatest(sum(CASE WHEN score <> 0 THEN 1 ELSE 0 END), 1) AS alpha FROM s)
SELECT pos, s.uid, alpha * (score - CASE WHEN n = 1 THEN 0 ELSE m END) AS advantage FROM s JOIN g ON s.uid = g.uid, b""")
def _w6(spark, sf):
    r = rollouts(spark, sf)
    return adv.estimate(r.withColumn("score", F.when(F.col("k") % 3 == 0, 0.0).otherwise(F.col("score"))), "gpg")


_TOKADV = "vec_id:l t:l advantage:d returns:d"


@register("w7_adv_remax", _TOKADV, f"""
WITH {TOKEN_SQL}, x AS (SELECT *, sum(reward * m) OVER (PARTITION BY vec_id ORDER BY t DESC) AS ret,
   0.1::DOUBLE * (vec_id % 7) AS base FROM tok)
SELECT vec_id, t, ret - base * m AS advantage, ret AS returns FROM x""")
def _w7(spark, sf):
    df = token_series(spark, sf).withColumn("baseline", F.lit(0.1) * (F.col("vec_id") % 7))
    out = adv.estimate(df, "remax").withColumnRenamed("advantages", "advantage")
    return per_token(out, "advantage", "returns")


_WHITEN_SQL = """
mo AS (SELECT sum(m) n, sum(a * m) / (sum(m) + 1e-8::DOUBLE) mean FROM x),
va AS (SELECT sum(m * (a - mean) * (a - mean)) / (any_value(n) + 1e-8::DOUBLE) * any_value(n) / (any_value(n) - 1) v FROM x, mo)
"""


@register("w8_discounted_returns", _TOKADV, f"""
WITH {TOKEN_SQL}, x AS (
  SELECT p.vec_id, p.t, p.m, sum(q.reward * pow(0.9::DOUBLE, q.t - p.t) * CASE WHEN q.t = p.t THEN 1 ELSE q.m * p.m END) AS a
  FROM tok p JOIN tok q ON p.vec_id = q.vec_id AND q.t >= p.t GROUP BY ALL),
y AS (SELECT vec_id, t, m, a FROM x), {_WHITEN_SQL.replace('x', 'x')}
SELECT vec_id, t, (a - mean) / sqrt(v + 1e-8::DOUBLE) * m AS advantage, a AS returns FROM x, mo, va WHERE m = 1""")
def _w8(spark, sf):
    df = token_series(spark, sf).withColumn("reward", A.times(F.col("reward"), F.col("mask")))
    out = adv.estimate(df, "reinforce_plus_plus", gamma=0.9).withColumnRenamed("advantages", "advantage")
    return per_token(out, "advantage", "returns", "mask").filter("mask = 1")


@register("w9_gae", _TOKADV, f"""
WITH {TOKEN_SQL}, d AS (
  SELECT *, reward + 0.99::DOUBLE * coalesce(lead(value) OVER (PARTITION BY vec_id ORDER BY t), 0) - value AS delta FROM tok WHERE m = 1),
x AS (SELECT p.vec_id, p.t, p.m, p.value, sum(q.delta * pow(0.99::DOUBLE * 0.95::DOUBLE, q.t - p.t)) AS a
  FROM d p JOIN d q ON p.vec_id = q.vec_id AND q.t >= p.t GROUP BY ALL), {_WHITEN_SQL}
SELECT vec_id, t, (a - mean) / sqrt(v + 1e-8::DOUBLE) AS advantage, a + value AS returns FROM x, mo, va""")
def _w9(spark, sf):
    out = adv.estimate(token_series(spark, sf), "gae", gamma=0.99, lam=0.95)
    out = out.withColumnRenamed("advantages", "advantage")
    return per_token(out, "advantage", "returns", "mask").filter("mask = 1")


def _otb_sql(tail: bool) -> str:
    drop = "AND NOT (ln = l1 AND l1 > l2 AND x.t > l2)" if tail else ""
    return f"""
WITH {TOKEN_SQL}, x AS (
  SELECT *, sum(reward * m) OVER (PARTITION BY vec_id ORDER BY t DESC) AS g,
    sum((1 - 2 * exp(old_lp) + sps) * m) OVER (PARTITION BY vec_id ORDER BY t) AS w,
    sum(m) OVER (PARTITION BY vec_id) AS ln FROM tok),
b AS (SELECT uid, t, sum(g * w * m) / (sum(w * m) + 1e-8::DOUBLE) AS b FROM x GROUP BY uid, t),
lens AS (SELECT uid, vec_id, any_value(ln) AS ln FROM x GROUP BY uid, vec_id),
two AS (SELECT uid, count(*) AS n, max(ln) AS l1, list_sort(list(ln), 'DESC')[2] AS l2 FROM lens GROUP BY uid)
SELECT x.vec_id, x.t, (g - CASE WHEN two.n > 1 {drop} THEN b ELSE 0 END) * m AS advantage, g AS returns
FROM x JOIN b ON x.uid = b.uid AND x.t = b.t JOIN two ON x.uid = two.uid"""


@register("w10_adv_otb", _TOKADV, _otb_sql(False))
def _w10(spark, sf):
    out = adv.estimate(token_series(spark, sf), "optimal_token_baseline").withColumnRenamed("advantages", "advantage")
    return per_token(out, "advantage", "returns")


@register("w10_adv_otb_zero_tail", _TOKADV, _otb_sql(True))
def _w10z(spark, sf):
    out = adv.estimate(token_series(spark, sf), "optimal_token_baseline", zero_tail=True)
    return per_token(out.withColumnRenamed("advantages", "advantage"), "advantage", "returns")


@register("w10_adv_otb_multi_turn", "vec_id:l t:l advantage:d", f"""
WITH {TOKEN_SQL}, hole AS (SELECT * REPLACE (CASE WHEN t % 5 = 0 THEN 0.0::DOUBLE ELSE m END AS m) FROM tok),
x AS (
  SELECT *, sum(reward * m) OVER (PARTITION BY vec_id ORDER BY t DESC) AS g,
    sum((1 - 2 * exp(old_lp) + sps) * m) OVER (PARTITION BY vec_id ORDER BY t) AS w,
    sum(m) OVER (PARTITION BY vec_id ORDER BY t) AS slot FROM hole),
b AS (SELECT uid, slot, sum(g * w) / (sum(w) + 1e-8::DOUBLE) AS b FROM x WHERE m = 1 GROUP BY uid, slot),
c AS (SELECT uid, count(DISTINCT vec_id) n FROM x GROUP BY uid)
SELECT x.vec_id, x.t, CASE WHEN m = 1 THEN g - CASE WHEN c.n > 1 THEN b ELSE 0 END ELSE 0 END AS advantage
FROM x LEFT JOIN b ON x.uid = b.uid AND x.slot = b.slot JOIN c ON x.uid = c.uid""")
def _w10m(spark, sf):
    df = token_series(spark, sf).withColumn(
        "mask", F.transform("mask", lambda m, i: F.when((i + 1) % 5 == 0, 0.0).otherwise(m))
    )
    out = adv.estimate(df, "tir_optimal_token_baseline").withColumnRenamed("advantages", "advantage")
    return per_token(out, "advantage")


@register("w11_is_weights", "vec_id:l t:l is_weight:d", f"""
WITH {TOKEN_SQL}, w AS (SELECT vec_id, t, m, least(exp(greatest(least(old_lp - roll_lp, 20), -20)) * m, 1.3::DOUBLE) AS w FROM tok)
SELECT vec_id, t, w / (sum(w * m) OVER () / (sum(m) OVER () + 1e-8::DOUBLE)) AS is_weight FROM w""")
def _w11(spark, sf):
    df = ro.with_log_ratio(token_series(spark, sf))
    return per_token(ro.is_weights(df, "token", 1.3, normalize=True), "is_weight")


@register("w11_is_weights_sequence", "vec_id:l t:l is_weight:d", f"""
WITH {TOKEN_SQL}, s AS (SELECT vec_id, sum((old_lp - roll_lp) * m) AS lr FROM tok GROUP BY vec_id)
SELECT tok.vec_id, t, least(exp(greatest(least(lr, 20), -20)) * m, 2) AS is_weight FROM tok JOIN s ON tok.vec_id = s.vec_id""")
def _w11s(spark, sf):
    return per_token(ro.is_weights(ro.with_log_ratio(token_series(spark, sf)), "sequence", 2.0), "is_weight")


_RS = "token_k1,token_k3,seq_mean_k2,seq_sum_k1,seq_max_k3"
_RS_T = "0.7_1.4,0.08,0.012,0.3_3.0,0.2"
_RS_SQL = f"""
WITH {TOKEN_SQL}, r AS (SELECT vec_id, t, m, greatest(least(old_lp - roll_lp, 20), -20) AS x FROM tok),
k AS (SELECT vec_id, t, m, -x AS k1, 0.5 * x * x AS k2, exp(x) - 1 - x AS k3 FROM r),
s AS (SELECT *, sum(k1 * m) OVER (PARTITION BY vec_id) AS sum1, sum(k2 * m) OVER (PARTITION BY vec_id) / (sum(m) OVER (PARTITION BY vec_id) + 1e-8::DOUBLE) AS mean2,
  max(CASE WHEN m = 1 THEN k3 END) OVER (PARTITION BY vec_id) AS max3 FROM k),
v AS (SELECT vec_id, t, m,
  CASE WHEN k1 BETWEEN ln(0.7::DOUBLE) AND ln(1.4::DOUBLE) THEN 1.0 ELSE 0.0 END AS keep1,
  CASE WHEN k3 <= 0.08 THEN 1.0 ELSE 0.0 END AS keep2,
  CASE WHEN mean2 <= 0.012 THEN 1.0 ELSE 0.0 END AS keep3,
  CASE WHEN sum1 BETWEEN ln(0.3::DOUBLE) AND ln(3.0::DOUBLE) THEN 1.0 ELSE 0.0 END AS keep4,
  CASE WHEN max3 <= 0.2 THEN 1.0 ELSE 0.0 END AS keep5 FROM s)"""


@register("w12_rejection_mask", "vec_id:l t:l rs_mask:d", _RS_SQL + """
SELECT vec_id, t, m * keep1 * keep2 * keep3 * keep4 * keep5 AS rs_mask FROM v""")
def _w12(spark, sf):
    return per_token(ro.rejection_mask(ro.with_log_ratio(token_series(spark, sf)), _RS, _RS_T), "rs_mask")


@register("w12_rejection_fractions", "option:s masked_fraction:d seq_masked_fraction:d", _RS_SQL + """,
q AS (SELECT option, vec_id, m, keep FROM (
  SELECT vec_id, m, keep1 AS token_k1, keep2 AS token_k3, keep3 AS seq_mean_k2, keep4 AS seq_sum_k1, keep5 AS seq_max_k3,
    keep1 * keep2 * keep3 * keep4 * keep5 AS "all" FROM v)
  UNPIVOT (keep FOR option IN (token_k1, token_k3, seq_mean_k2, seq_sum_k1, seq_max_k3, "all")))
SELECT a.option, masked_fraction, seq_masked_fraction FROM
 (SELECT option, sum((1 - keep) * m) / (sum(m) + 1e-8::DOUBLE) AS masked_fraction FROM q GROUP BY option) a JOIN
 (SELECT option, avg(hit) AS seq_masked_fraction FROM (SELECT option, vec_id, max(CASE WHEN m = 1 AND keep = 0 THEN 1 ELSE 0 END) hit FROM q GROUP BY ALL) GROUP BY option) b
 ON a.option = b.option""")
def _w12m(spark, sf):
    masked = ro.rejection_mask(ro.with_log_ratio(token_series(spark, sf)), _RS, _RS_T)
    long = ro.rejection_metrics(masked, _RS, _RS_T)
    return long.groupBy("option").agg(
        F.max(F.when(F.col("metric") == "masked_fraction", F.col("value"))).alias("masked_fraction"),
        F.max(F.when(F.col("metric") == "seq_masked_fraction", F.col("value"))).alias("seq_masked_fraction"),
    )


def _kl_sql(kind: str) -> str:
    d = "(old_lp - roll_lp)"
    r = f"greatest(least(-{d}, 20), -20)"
    return {
        "k1": d, "abs": f"abs({d})", "k2": f"0.5 * {d} * {d}",
        "k3": f"greatest(least(exp({r}) - {r} - 1, 10), -10)",
    }[kind]


@register("w13_kl_penalty", "kind:s vec_id:l kl_mean:d reward_total:d", f"""
WITH {TOKEN_SQL}, k AS (""" + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, vec_id, reward, m, ({_kl_sql(kind)}) * m AS kl FROM tok" for kind in ("k1", "abs", "k2", "k3")
) + """) SELECT kind, vec_id, sum(kl) / (sum(m) + 1e-8::DOUBLE) AS kl_mean, sum(reward - 0.05 * kl) AS reward_total FROM k GROUP BY kind, vec_id""")
def _w13(spark, sf):
    df = token_series(spark, sf).withColumnRenamed("rollout_log_prob", "ref_log_prob")
    df = df.withColumnRenamed("reward", "score_tokens")
    parts = [
        ro.kl_penalty(df, kind, 0.05).select(
            F.lit(kind).alias("kind"), "vec_id", "kl_mean", A.array_total(F.col("token_reward")).alias("reward_total")
        )
        for kind in ("k1", "abs", "k2", "k3")
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("w13_kl_coefficients", "step:l coef:d coef_after:d", f"""
WITH RECURSIVE {ROLLOUT_SQL}, s AS (SELECT step, avg(score) AS kl, count(*) AS n, row_number() OVER (ORDER BY step) AS i FROM rollouts GROUP BY step),
f AS (SELECT i, step, 0.2::DOUBLE AS coef, 0.2::DOUBLE * (1 + greatest(least(kl / 10.0::DOUBLE - 1, 0.2), -0.2) * n / 10000.0) AS coef_after FROM s WHERE i = 1
  UNION ALL SELECT s.i, s.step, f.coef_after, f.coef_after * (1 + greatest(least(kl / 10.0::DOUBLE - 1, 0.2), -0.2) * n / 10000.0)
  FROM s JOIN f ON s.i = f.i + 1)
SELECT step, coef, coef_after FROM f""")
def _w13c(spark, sf):
    steps = rollouts(spark, sf).groupBy("step").agg(F.avg("score").alias("kl"), F.count(F.lit(1)).alias("n"))
    return ro.kl_coefficients(steps, 0.2, 10.0, 10000.0)


@register("w14_overlong_penalty", "pos:l overlong_reward:d score:d", f"""
WITH {ROLLOUT_SQL}, p AS (SELECT pos, score, least(-(length - 20) / 10.0::DOUBLE * 0.5, 0) AS o FROM rollouts)
SELECT pos, o AS overlong_reward, score + o AS score FROM p""")
def _w14(spark, sf):
    return adv.overlong(rollouts(spark, sf), max_len=30, buffer=10, factor=0.5, reward="score")


_SOFT = """
s AS (SELECT vec_id, label, g.i AS i, CAST(embedding[g.i] AS DOUBLE) * 4 AS a, CAST(embedding[65 - g.i] AS DOUBLE) * 4 AS b FROM embeddings, range(1, 65) g(i)),
z AS (SELECT *, a - ln(sum(exp(a)) OVER (PARTITION BY vec_id)) AS st, b - ln(sum(exp(b)) OVER (PARTITION BY vec_id)) AS te FROM s),
"""
_TOP = """
top AS (SELECT vec_id, i, st, te FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY a DESC, i) AS r FROM z) WHERE r <= 16),
tail AS (SELECT vec_id, st, te FROM top UNION ALL SELECT vec_id, ln(1 - sum(exp(st))), ln(1 - sum(exp(te))) FROM top GROUP BY vec_id),
ren AS (SELECT vec_id, st - ln(sum(exp(st)) OVER (PARTITION BY vec_id)) AS st, te - ln(sum(exp(te)) OVER (PARTITION BY vec_id)) AS te FROM top),
mixed AS (SELECT 'tail' AS form, * FROM tail UNION ALL SELECT 'renorm' AS form, * FROM ren),
mm AS (SELECT *, ln(0.5 * exp(st) + 0.5 * exp(te)) AS mi FROM mixed)
"""


@register("w15_distill_divergence", "form:s vec_id:l forward_kl:d reverse_kl:d jsd:d", f"""
WITH {_SOFT} {_TOP}
SELECT form, vec_id, sum(exp(te) * (te - st)) AS forward_kl, sum(exp(st) * (st - te)) AS reverse_kl,
  sum(0.5 * exp(st) * (st - mi) + 0.5 * exp(te) * (te - mi)) AS jsd FROM mm GROUP BY form, vec_id""")
def _w15(spark, sf):
    df = token_series(spark, sf)

    def soft(x):
        return ro.renormalise(F.transform(x, lambda v: v * 4.0))

    df = df.select("vec_id", "reward", soft(F.col("reward")).alias("s"), soft(F.reverse("reward")).alias("t"))
    # The student's sixteen likeliest of all positions, and the teacher at the same ones.
    ranked = F.array_sort(F.transform(F.arrays_zip("reward", "s", "t"), lambda z, i: F.struct((-z["reward"]).alias("o"), i.alias("i"), z["s"].alias("s"), z["t"].alias("t"))))
    df = df.select("vec_id", F.slice(ranked, 1, 16).alias("top")).select("vec_id", F.col("top.s").alias("student"), F.col("top.t").alias("teacher"))
    parts = []
    for form in ("tail", "renorm"):
        d = [ro.divergence(F.col("student"), F.col("teacher"), a, form) for a in (0.0, 1.0, 0.5)]
        parts.append(df.select(F.lit(form).alias("form"), "vec_id", d[0].alias("forward_kl"), d[1].alias("reverse_kl"), d[2].alias("jsd")))
    return parts[0].unionByName(parts[1])


@register("w15_divergence_summary", "raw_token_mean:d weighted_token_mean:d num_tokens:d", f"""
WITH {_SOFT} d AS (SELECT vec_id, sum(exp(st) * (st - te)) AS d, any_value(CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE 1.0 END) AS m,
  least(exp(sum(CASE WHEN i = 1 THEN (a - b) * 0.25 END)), 1.2::DOUBLE) AS ratio FROM z GROUP BY vec_id)
SELECT sum(d * m) / sum(m) AS raw_token_mean, sum(d * ratio * m) / sum(m) AS weighted_token_mean, sum(m) AS num_tokens FROM d""")
def _w15s(spark, sf):
    df = token_series(spark, sf)

    def soft(x):
        return ro.renormalise(F.transform(x, lambda v: v * 4.0))

    df = df.select(
        "vec_id", soft(F.col("reward")).alias("student"), soft(F.reverse("reward")).alias("teacher"),
        F.element_at("reward", 1).alias("log_prob"), F.element_at("reward", -1).alias("old_log_prob"),
        F.when(F.col("vec_id") % 4 == 0, 0.0).otherwise(1.0).alias("m"),
    )
    return ro.divergence_summary(ro.distill_divergence(df, 1.0, tail=None, is_clip=1.2))


@register("g9_variance_proxy",
          "proxy1_signal_strength:d proxy2_total_power:d proxy3_pure_noise:d8 expected_a_squared:d8 expected_w:d", f"""
WITH {TOKEN_SQL}, s AS (SELECT vec_id, sum(reward * m) / (sum(m) + 1e-8::DOUBLE) AS a, sum((1 - 2 * exp(old_lp) + sps) * m) AS w FROM tok GROUP BY vec_id),
p AS (SELECT avg(a * a * greatest(w, 0)) AS p2, avg(a * a) AS ea, avg(w) AS ew, count(*) AS n FROM s)
SELECT 0.0001 AS proxy1_signal_strength, p2 AS proxy2_total_power, greatest((p2 - 0.0001::DOUBLE) / (n - 1), 0) AS proxy3_pure_noise,
  ea AS expected_a_squared, ew AS expected_w FROM p""")
def _g9(spark, sf):
    return ro.variance_proxy(token_series(spark, sf), gradient_norm=0.01, advantages="reward")


@register("g28_loss_modes", "mode:s loss:d", f"""
WITH {TOKEN_SQL}, q AS (SELECT vec_id, sum(value * mm) AS s, sum(mm) AS n FROM (SELECT *, CASE WHEN vec_id % 6 = 0 THEN 0.0 ELSE m END AS mm FROM tok) GROUP BY vec_id)
SELECT 'token-mean' AS mode, sum(s) / sum(n) AS loss FROM q
UNION ALL SELECT 'seq-mean-token-sum', avg(s) FROM q WHERE n > 0
UNION ALL SELECT 'seq-mean-token-mean', avg(s / (n + 1e-8::DOUBLE)) FROM q WHERE n > 0
UNION ALL SELECT 'seq-mean-token-sum-norm', sum(s) / 64 FROM q""")
def _g28(spark, sf):
    df = token_series(spark, sf).withColumnRenamed("value", "loss")
    df = df.withColumn("mask", F.transform("mask", lambda m: F.when(F.col("vec_id") % 6 == 0, 0.0).otherwise(m)))
    modes = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")
    return reduce(lambda a, b: a.unionByName(b), [ro.agg_tokens(df, m) for m in modes])


_OFF = ("training_ppl training_log_ppl kl k3_kl rollout_ppl rollout_log_ppl log_ppl_diff log_ppl_abs_diff "
        "log_ppl_diff_max log_ppl_diff_min ppl_ratio chi2_token chi2_seq").split()


@register("g29_offpolicy_metrics", " ".join(f"{c}:d" for c in _OFF), f"""
WITH {TOKEN_SQL}, s AS (SELECT vec_id, sum(m) AS n, sum(old_lp * m) / (sum(m) + 1e-8::DOUBLE) AS lt, sum(roll_lp * m) / (sum(m) + 1e-8::DOUBLE) AS lr,
  sum((old_lp - roll_lp) * m) AS d, sum((exp(old_lp - roll_lp) - (old_lp - roll_lp) - 1) * m) AS k3, sum(exp(2 * (old_lp - roll_lp)) * m) AS rho FROM tok GROUP BY vec_id)
SELECT avg(exp(-lt)) AS training_ppl, avg(-lt) AS training_log_ppl, -sum(d) / sum(n) AS kl, sum(k3) / sum(n) AS k3_kl,
  avg(exp(-lr)) AS rollout_ppl, avg(-lr) AS rollout_log_ppl, avg(lr - lt) AS log_ppl_diff, avg(abs(lr - lt)) AS log_ppl_abs_diff,
  max(lr - lt) AS log_ppl_diff_max, min(lr - lt) AS log_ppl_diff_min, avg(exp(lr - lt)) AS ppl_ratio, sum(rho) / sum(n) - 1 AS chi2_token,
  avg(exp(2 * greatest(least(d, 20), -20))) - 1 AS chi2_seq FROM s""")
def _g29(spark, sf):
    return ro.offpolicy_metrics(token_series(spark, sf))


_IS = ("is_mean is_max is_min fraction_high fraction_low is_std eff_sample_size seq_mean seq_std seq_max seq_min "
       "seq_max_deviation seq_fraction_high seq_fraction_low").split()


@register("g30_is_metrics", " ".join(f"{c}:d" for c in _IS), f"""
WITH {TOKEN_SQL}, w AS (SELECT vec_id, m, exp(greatest(least(old_lp - roll_lp, 20), -20)) * m AS w FROM tok),
c AS (SELECT *, greatest(least(w, 1.25::DOUBLE), 0.8::DOUBLE) AS c FROM w),
t AS (SELECT sum(w * m) / sum(m) AS is_mean, max(CASE WHEN m = 1 THEN w END) AS is_max, min(CASE WHEN m = 1 THEN w END) AS is_min,
  sum(CASE WHEN w > 1.25 THEN m ELSE 0 END) / sum(m) AS fraction_high, sum(CASE WHEN w < 0.8 THEN m ELSE 0 END) / sum(m) AS fraction_low,
  sum(c * m) / sum(m) AS cm, sum(c * c * m) / sum(m) AS c2 FROM c),
s AS (SELECT vec_id, sum(w * m) / (sum(m) + 1e-8::DOUBLE) AS q FROM w GROUP BY vec_id)
SELECT is_mean, is_max, is_min, fraction_high, fraction_low, sqrt(c2 - cm * cm) AS is_std, (cm + 1e-8::DOUBLE) * (cm + 1e-8::DOUBLE) / c2 AS eff_sample_size,
  avg(q) AS seq_mean, stddev_samp(q) AS seq_std, max(q) AS seq_max, min(q) AS seq_min, max(abs(q - 1)) AS seq_max_deviation,
  avg(CASE WHEN q > 1.25 THEN 1 ELSE 0 END) AS seq_fraction_high, avg(CASE WHEN q < 0.8 THEN 1 ELSE 0 END) AS seq_fraction_low
FROM s, t GROUP BY ALL""")
def _g30(spark, sf):
    return ro.is_metrics(ro.with_log_ratio(token_series(spark, sf)), "token", 1.25)


@register("p15_fit_length", "vec_id:l right_cut:s left_cut:s padded:s", """
SELECT vec_id, array_to_string(list_transform(embedding[1:5], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',') AS right_cut,
  array_to_string(list_transform(embedding[60:64], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)), ',') AS left_cut,
  array_to_string(list_concat(list_transform(range(0, 6 - vec_id % 4), lambda x: CAST(0 AS BIGINT)),
     list_transform(embedding[1:vec_id % 4], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT))), ',') AS padded
FROM embeddings""")
def _p15(spark, sf):
    df = token_series(spark, sf)

    def show(arr):
        return F.array_join(F.transform(arr, lambda x: F.round(x * 1000.0).cast("bigint").cast("string")), ",")

    short = F.slice("reward", F.lit(1), (F.col("vec_id") % 4).cast("int"))
    return df.select(
        "vec_id",
        show(A.fit_length(F.col("reward"), 5, F.lit(0.0))).alias("right_cut"),
        show(A.fit_length(F.col("reward"), 5, F.lit(0.0), truncate="left")).alias("left_cut"),
        show(A.fit_length(short, 6, F.lit(0.0), pad="left")).alias("padded"),
    )
