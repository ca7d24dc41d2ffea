"""Aggregation queries: G1-G8, G10-G23, G31."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import arrays as A
from scoreloom.operators import benchmarks as bm
from scoreloom.operators import metrics as mt
from scoreloom.plans.catalog import register
from scoreloom.plans.fixtures import EVAL_SQL, ROLLOUT_SQL, TOKEN_SQL, evals, rollouts, token_series

_LONG_SQL = f"""{ROLLOUT_SQL}, names AS (
  SELECT step, score, length, unnest(['actor/loss', 'perf/max_memory', 'timing_s/gen', 'timing_s/step', 'response/min', 'tokens/total',
    'training/global_step', 'perf/time_per_step', 'perf/total_num_tokens', 'perf/throughput',
    'global_seqlen/min', 'global_seqlen/max', 'global_seqlen/minmax_diff']) AS name, data_source FROM rollouts),
longm AS (SELECT name, step, avg(score) + length(name) AS value, count(*) AS samples FROM names GROUP BY name, step)
"""
_NAMES = ["actor/loss", "perf/max_memory", "timing_s/gen", "timing_s/step", "response/min", "tokens/total",
          "training/global_step", "perf/time_per_step", "perf/total_num_tokens", "perf/throughput",
          "global_seqlen/min", "global_seqlen/max", "global_seqlen/minmax_diff"]


def _long(spark, sf):
    r = rollouts(spark, sf).select("step", "score", F.explode(F.array(*[F.lit(n) for n in _NAMES])).alias("name"))
    return r.groupBy("name", "step").agg(
        (F.avg("score") + F.length("name")).alias("value"), F.count(F.lit(1)).alias("samples")
    )


@register("g1_reduce_metrics", "name:s aggregation:s value:d4", f"""
WITH {_LONG_SQL}
SELECT name, CASE WHEN name LIKE '%max%' THEN 'max' WHEN name LIKE '%min%' THEN 'min' ELSE 'mean' END AS aggregation,
  CASE WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END AS value
FROM longm GROUP BY name""")
def _g1(spark, sf):
    return mt.reduce_metrics(_long(spark, sf))


@register("g2_aggregate_steps", "name:s value:d4", f"""
WITH {_LONG_SQL}, a AS (SELECT name, CASE
   WHEN name IN ('timing_s/gen', 'timing_s/step', 'perf/time_per_step', 'tokens/total', 'perf/total_num_tokens') THEN sum(value)
   WHEN name = 'training/global_step' THEN arg_max(value, step)
   WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) ELSE avg(value) END AS value FROM longm GROUP BY name),
p AS (SELECT max(CASE WHEN name = 'global_seqlen/max' THEN value END) - max(CASE WHEN name = 'global_seqlen/min' THEN value END) AS gap,
  max(CASE WHEN name = 'perf/total_num_tokens' THEN value END) / (max(CASE WHEN name = 'perf/time_per_step' THEN value END) * 8) AS thr,
  max(CASE WHEN name = 'timing_s/gen' THEN value END) / max(CASE WHEN name = 'timing_s/step' THEN value END) AS idle FROM a)
SELECT name, CASE WHEN name = 'global_seqlen/minmax_diff' THEN gap WHEN name = 'perf/throughput' THEN thr ELSE value END AS value FROM a, p
UNION ALL SELECT 'trainer/idle_ratio', idle FROM p""")
def _g2(spark, sf):
    return mt.aggregate_steps(_long(spark, sf), workers=8, samples="samples")


_G3_SQL = f"""
WITH {ROLLOUT_SQL}, l AS (SELECT data_source, user_id, 'acc' AS variable, CASE WHEN score > 50 THEN 1.0 ELSE 0.0 END AS v FROM rollouts
  UNION ALL SELECT data_source, user_id, 'reward', score FROM rollouts),
u AS (SELECT data_source, variable, user_id, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY ALL),
g AS (SELECT data_source, variable, n, count(*) AS prompts, avg(m) AS m, avg(s) AS s FROM u GROUP BY ALL),
val AS (SELECT data_source, variable, prompts, 'mean@' || n AS metric, m AS value, n FROM g
  UNION ALL SELECT data_source, variable, prompts, 'std@' || n, s, n FROM g WHERE n > 1)
"""


def _validation(spark, sf):
    r = rollouts(spark, sf).withColumn("acc", (F.col("score") > 50).cast("double")).withColumn("reward", F.col("score"))
    return mt.validation_metrics(r, ["acc", "reward"], uid="user_id")


@register("g3_validation_metrics", "data_source:s variable:s metric:s prompts:l value:d", _G3_SQL + """
SELECT data_source, variable, metric, prompts, value FROM val""")
def _g3(spark, sf):
    return _validation(spark, sf)


@register("g4_best_at_n", "data_source:s n:l best_mean:d4 best_std:d4 worst_mean:d4 worst_std:d4", f"""
WITH {ROLLOUT_SQL}, r AS (SELECT data_source, user_id, score, row_number() OVER (PARTITION BY data_source, user_id ORDER BY score) AS i,
  count(*) OVER (PARTITION BY data_source, user_id) AS t FROM rollouts),
ns AS (SELECT r.*, n.n FROM r, (SELECT DISTINCT unnest([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]) AS n) n WHERE n.n < t
  UNION ALL SELECT r.*, t FROM r WHERE t > 1),
p AS (SELECT data_source, user_id, n,
  sum(score * (pow(i::DOUBLE / t, n) - pow((i - 1)::DOUBLE / t, n))) AS b1, sum(score * score * (pow(i::DOUBLE / t, n) - pow((i - 1)::DOUBLE / t, n))) AS b2,
  sum(score * (pow((t - i + 1)::DOUBLE / t, n) - pow((t - i)::DOUBLE / t, n))) AS w1, sum(score * score * (pow((t - i + 1)::DOUBLE / t, n) - pow((t - i)::DOUBLE / t, n))) AS w2
  FROM ns GROUP BY ALL)
SELECT data_source, n, avg(b1) AS best_mean, avg(sqrt(greatest(b2 - b1 * b1, 0))) AS best_std, avg(w1) AS worst_mean, avg(sqrt(greatest(w2 - w1 * w1, 0))) AS worst_std
FROM p GROUP BY data_source, n""")
def _g4(spark, sf):
    return mt.best_at_n(rollouts(spark, sf), uid="user_id")


_DRAWS = """
WITH """ + ROLLOUT_SQL + """, r AS (SELECT *, CAST(k % 4 AS VARCHAR) AS pred, row_number() OVER (PARTITION BY data_source, user_id ORDER BY pos) AS rn, count(*) OVER (PARTITION BY data_source, user_id) AS n FROM rollouts),
g AS (SELECT DISTINCT data_source, user_id, n FROM r),
d AS (SELECT data_source, user_id, draw, slot, CAST('0x' || substr(md5('42/' || data_source || '/' || user_id || '/' || draw || '/' || slot), 1, 12) AS BIGINT) % n + 1 AS rn FROM g, range(1, {n_draws}) a(draw), range(1, 5) b(slot)),
x AS (SELECT d.*, r.score, r.pred FROM d JOIN r ON d.data_source = r.data_source AND d.user_id = r.user_id AND d.rn = r.rn),"""


@register("g4_bootstrap_best", "data_source:s best_mean:d best_std:d worst_mean:d worst_std:d", _DRAWS.replace("{n_draws}", "41") + """
p AS (SELECT data_source, user_id, draw, max(score) AS hi, min(score) AS lo FROM x GROUP BY ALL),
u AS (SELECT data_source, user_id, avg(hi) AS bm, stddev_pop(hi) AS bs, avg(lo) AS wm, stddev_pop(lo) AS ws FROM p GROUP BY ALL)
SELECT data_source, avg(bm) AS best_mean, avg(bs) AS best_std, avg(wm) AS worst_mean, avg(ws) AS worst_std FROM u GROUP BY data_source""")
def _g4b(spark, sf):
    return mt.bootstrap_best(rollouts(spark, sf), 4, draws=40, uid="user_id")


@register("g5_majority_value", "data_source:s user_id:l vote:s value:d", f"""
WITH {ROLLOUT_SQL}, v AS (SELECT data_source, user_id, CAST(k % 4 AS VARCHAR) AS vote, count(*) AS c, min(pos) AS p, arg_min(score, pos) AS val FROM rollouts GROUP BY ALL)
SELECT data_source, user_id, vote, val AS value FROM v QUALIFY row_number() OVER (PARTITION BY data_source, user_id ORDER BY c DESC, p) = 1""")
def _g5(spark, sf):
    r = rollouts(spark, sf).withColumn("pred", (F.col("k") % 4).cast("string"))
    return mt.majority_value(r, ["data_source", "user_id"])


@register("g5_bootstrap_majority", "data_source:s maj_mean:d maj_std:d", _DRAWS.replace("{n_draws}", "31") + """
v AS (SELECT data_source, user_id, draw, pred, count(*) AS c, min(slot) AS s, arg_min(score, slot) AS val FROM x GROUP BY ALL),
m AS (SELECT data_source, user_id, draw, val FROM v QUALIFY row_number() OVER (PARTITION BY data_source, user_id, draw ORDER BY c DESC, s) = 1),
u AS (SELECT data_source, user_id, avg(val) AS a, stddev_pop(val) AS b FROM m GROUP BY ALL) SELECT data_source, avg(a) AS maj_mean, avg(b) AS maj_std FROM u GROUP BY data_source""")
def _g5b(spark, sf):
    r = rollouts(spark, sf).withColumn("pred", (F.col("k") % 4).cast("string"))
    return mt.bootstrap_majority(r, 4, draws=30, uid="user_id")


@register("g6_core_metric_names", "section:s name:s value:d", _G3_SQL + """, mx AS (SELECT data_source, variable, max(n) AS nmax FROM val GROUP BY ALL),
x AS (SELECT v.*, CASE WHEN v.variable = 'acc' AND v.metric LIKE 'mean%' AND position('@' || nmax IN v.metric) > 0 THEN 'val-core' ELSE 'val-aux' END AS section
  FROM val v JOIN mx ON v.data_source = mx.data_source AND v.variable = mx.variable)
SELECT section, section || '/' || data_source || '/' || variable || '/' || metric AS name, value FROM x""")
def _g6(spark, sf):
    return mt.label_core(_validation(spark, sf))


@register("g7_batch_stats", "metric:s value:d4", f"""
WITH {ROLLOUT_SQL}, b AS (SELECT length - 1 AS r, k AS p, score FROM rollouts)
SELECT unnest(['response_length/mean', 'response_length/max', 'response_length/min', 'response_length/clip_ratio',
  'response_length_non_aborted/mean', 'response_length_non_aborted/max', 'response_length_non_aborted/min', 'response_length_non_aborted/clip_ratio',
  'response/aborted_ratio', 'prompt_length/mean', 'prompt_length/max', 'prompt_length/min', 'prompt_length/clip_ratio',
  'critic/score/mean', 'critic/score/max', 'critic/score/min']) AS metric,
 unnest([avg(r), max(r), min(r), avg(CASE WHEN r = 36 THEN 1 ELSE 0 END),
  avg(r) FILTER (r <> 0), max(r) FILTER (r <> 0), min(r) FILTER (r <> 0), avg(CASE WHEN r = 36 THEN 1 ELSE 0 END) FILTER (r <> 0),
  avg(CASE WHEN r = 0 THEN 1 ELSE 0 END), avg(p), max(p), min(p), avg(CASE WHEN p = 99 THEN 1 ELSE 0 END),
  avg(score) FILTER (r <> 0), max(score) FILTER (r <> 0), min(score) FILTER (r <> 0)]) AS value FROM b""")
def _g7(spark, sf):
    b = rollouts(spark, sf).select((F.col("length") - 1).alias("response_length"), F.col("k").alias("prompt_length"), "score")
    return mt.melt_row(mt.batch_stats(b, max_response=36, max_prompt=99))


@register("g7_token_stats", "metric:s value:d", f"""
WITH {TOKEN_SQL}, x AS (SELECT reward AS a, sum(reward * m) OVER (PARTITION BY vec_id ORDER BY t DESC) AS r, value AS v, m FROM tok),
y AS (SELECT * FROM x WHERE m = 1)
SELECT unnest(['critic/advantages/mean', 'critic/advantages/max', 'critic/advantages/min', 'critic/returns/mean', 'critic/returns/max', 'critic/returns/min',
  'critic/values/mean', 'critic/values/max', 'critic/values/min', 'critic/vf_explained_var']) AS metric,
 unnest([avg(a), max(a), min(a), avg(r), max(r), min(r), avg(v), max(v), min(v), 1 - var_samp(r - v) / (var_samp(r) + 1e-5::DOUBLE)]) AS value FROM y""")
def _g7t(spark, sf):
    t = token_series(spark, sf).withColumn("returns", A.reverse_cumulative(A.times(F.col("reward"), F.col("mask"))))
    t = t.withColumn("response_length", F.col("n")).withColumn("prompt_length", F.col("n"))
    wide = mt.batch_stats(t, 64, 64, score=None, advantages="reward", returns="returns", values="value")
    return mt.melt_row(wide).filter(F.col("metric").startswith("critic"))


@register("g8_timing_metrics", "stage:s timing_s:d4 per_token_ms:d throughput:d4", f"""
WITH {ROLLOUT_SQL}, s AS (SELECT data_source AS d, sum(score) / 100 AS seconds FROM rollouts GROUP BY data_source),
st AS (SELECT CASE d WHEN 'view' THEN 'gen' WHEN 'click' THEN 'ref' WHEN 'error' THEN 'adv' WHEN 'signup' THEN 'step' ELSE 'reward' END AS stage, seconds FROM s),
t AS (SELECT sum(length) AS r, sum(length + k) AS a FROM rollouts)
SELECT stage, seconds AS timing_s, CASE WHEN stage = 'gen' THEN seconds * 1000 / r WHEN stage IN ('ref', 'adv') THEN seconds * 1000 / a END AS per_token_ms,
  CASE WHEN stage = 'step' THEN a / (seconds * 4) END AS throughput FROM st, t""")
def _g8(spark, sf):
    r = rollouts(spark, sf)
    d = F.col("data_source")
    stage = F.when(d == "view", "gen").when(d == "click", "ref").when(d == "error", "adv").when(d == "signup", "step").otherwise("reward")
    stages = r.groupBy(stage.alias("stage")).agg((F.sum("score") / 100).alias("seconds"))
    batch = r.select(F.col("length").alias("response_length"), F.col("k").alias("prompt_length"))
    return mt.timing_metrics(stages, batch, workers=4)


_MERGE = {"SIZED": ("SMALL", "MEDIUM", "LARGE")}


@register("g10_macro_score", "level:s name:s value:d n:l", f"""
WITH {EVAL_SQL}, t AS (SELECT type, avg(score) AS acc, count(*) AS n, sum(score) AS s, sum(answered) AS a FROM evals GROUP BY type),
v AS (SELECT CASE WHEN type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'SIZED' ELSE type END AS vote, avg(acc) AS acc, sum(n) AS n FROM t GROUP BY ALL)
SELECT 'type' AS level, type AS name, acc AS value, n FROM t UNION ALL SELECT 'vote', vote, acc, n FROM v
UNION ALL SELECT 'overall', 'overall', avg(acc), count(*) FROM v UNION ALL SELECT 'micro', 'micro', sum(s) / sum(n), sum(n) FROM t
UNION ALL SELECT 'answered', 'answered', sum(a) / sum(n), sum(n) FROM t""")
def _g10(spark, sf):
    return bm.macro_score(evals(spark, sf), _MERGE)


_HALVES = {"2d": ("SMALL", "MEDIUM"), "3d": ("LARGE",)}


@register("g11_weighted_score", "level:s name:s value:d n:l", f"""
WITH {EVAL_SQL}, s AS (SELECT type, avg(score) AS v, count(*) AS n FROM evals GROUP BY type),
h AS (SELECT '2d' AS name, avg(v) AS v, sum(n) AS n FROM s WHERE type IN ('SMALL', 'MEDIUM') UNION ALL SELECT '3d', avg(v), sum(n) FROM s WHERE type = 'LARGE')
SELECT 'source' AS level, type AS name, v AS value, n FROM s UNION ALL SELECT 'task', family, avg(score), count(*) FROM evals GROUP BY family
UNION ALL SELECT 'micro', 'micro', avg(score), count(*) FROM evals UNION ALL SELECT 'half', name, v, n FROM h
UNION ALL SELECT 'combined', 'combined', avg(v), sum(n) FROM h""")
def _g11(spark, sf):
    return bm.weighted_score(evals(spark, sf), _HALVES, source="type", task="family")


@register("g12_rollup_views", "budget:s level:s family:s views:l acc:d answered:d n:l tokens_mean:d tokens_median:d tokens_p95:d", f"""
WITH {EVAL_SQL}, g AS (SELECT budget, family, views, avg(score) AS acc, avg(answered) AS answered, count(*) AS n, grouping(family) AS gf, grouping(views) AS gv
  FROM evals GROUP BY GROUPING SETS ((budget), (budget, family), (budget, views), (budget, family, views))),
l AS (SELECT budget, avg(tokens) AS m, median(tokens) AS md, list_sort(list(tokens))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p FROM evals GROUP BY budget)
SELECT g.budget, CASE WHEN gf = 1 AND gv = 1 THEN 'overall' WHEN gv = 1 THEN 'family' WHEN gf = 1 THEN 'views' ELSE 'cell' END AS level, family, views, acc, answered, n,
  CASE WHEN gf = 1 AND gv = 1 THEN m END AS tokens_mean, CASE WHEN gf = 1 AND gv = 1 THEN md END AS tokens_median, CASE WHEN gf = 1 AND gv = 1 THEN p END AS tokens_p95
FROM g JOIN l ON g.budget = l.budget""")
def _g12(spark, sf):
    return bm.rollup_views(evals(spark, sf))


_LEVELS = {"low": ("SMALL", "ECONOMY"), "middle": ("MEDIUM", "STANDARD"), "high": ("LARGE",)}


@register("g13_level_score", "level:s name:s value:d n:l", f"""
WITH {EVAL_SQL}, t AS (SELECT type, avg(score) AS v, count(*) AS n FROM evals GROUP BY type),
x AS (SELECT *, CASE WHEN type IN ('SMALL', 'ECONOMY') THEN 'low' WHEN type IN ('MEDIUM', 'STANDARD') THEN 'middle' WHEN type = 'LARGE' THEN 'high' END AS lv FROM t)
SELECT 'task' AS level, type AS name, v AS value, n FROM t UNION ALL SELECT 'level', lv, avg(v), sum(n) FROM x WHERE lv IS NOT NULL GROUP BY lv
UNION ALL SELECT 'overall', 'overall', avg(v), sum(n) FROM t""")
def _g13(spark, sf):
    return bm.level_score(evals(spark, sf), _LEVELS, task="type")


@register("g14_marginal_accuracy", "dimension:s name:s acc:d answered:l", f"""
WITH {EVAL_SQL}
SELECT 'type' AS dimension, type AS name, 100 * avg(correct) AS acc, count(*) AS answered FROM evals GROUP BY type
UNION ALL SELECT 'family', family, 100 * avg(correct), count(*) FROM evals GROUP BY family
UNION ALL SELECT 'views', CAST(views AS VARCHAR), 100 * avg(correct), count(*) FROM evals GROUP BY views
UNION ALL SELECT 'extra', CAST(extra AS VARCHAR), 100 * avg(correct), count(*) FROM evals GROUP BY extra
UNION ALL SELECT 'overall', 'overall', 100 * avg(correct), count(*) FROM evals""")
def _g14(spark, sf):
    return bm.marginal_accuracy(evals(spark, sf), ["type", "family", "views", "extra"])


@register("g15_all_variants_accuracy", "category:s hit_rate:d n:l", f"""
WITH {EVAL_SQL}, x AS (SELECT l_orderkey + 1000000 * (views - 1) AS idx, answered AS hit, type AS category FROM evals),
q AS (SELECT idx % 1000000 AS q, bool_and(hit = 1) AS hit, max(CASE WHEN idx < 1000000 THEN category END) AS category FROM x GROUP BY ALL HAVING bool_or(idx < 1000000))
SELECT category, avg(CAST(hit AS INT)) AS hit_rate, count(*) AS n FROM q GROUP BY category UNION ALL SELECT 'overall', avg(CAST(hit AS INT)), count(*) FROM q""")
def _g15(spark, sf):
    e = evals(spark, sf).select(
        (F.col("l_orderkey") + (F.col("views") - 1) * 1000000).alias("index"), (F.col("answered") == 1).alias("hit"),
        F.col("type").alias("category"),
    )
    return bm.all_variants_acc(e)


@register("g16_detection_report", "level:s name:s precision:d recall:d f1:d", f"""
WITH {EVAL_SQL}, c AS (SELECT type, sum(correct * answered) AS tp, sum((1 - correct) * answered) AS fp, sum(1 - answered) AS fn FROM evals GROUP BY type),
m AS (SELECT type, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM c), f AS (SELECT type, p, r, 2 * p * r / (p + r) AS f1 FROM m)
SELECT 'class' AS level, type AS name, p AS precision, r AS recall, f1 FROM f
UNION ALL SELECT 'subset', 'sized', sum(p) / 4, sum(r) / 4, sum(f1) / 4 FROM f WHERE type IN ('SMALL', 'MEDIUM', 'LARGE')
UNION ALL SELECT 'subset', 'promo', avg(p), avg(r), avg(f1) FROM f WHERE type = 'PROMO'""")
def _g16(spark, sf):
    e = evals(spark, sf).select(
        F.col("type").alias("label"), (F.col("correct") * F.col("answered")).alias("tp"),
        ((1 - F.col("correct")) * F.col("answered")).alias("fp"), (1 - F.col("answered")).alias("fn"),
    )
    return bm.detection_report(e, {"sized": ("SMALL", "MEDIUM", "LARGE", "TINY"), "promo": ("PROMO",)})


@register("g16_iou_hit_rates", "iou_at_0_25:d iou_at_0_5:d", f"""
WITH {EVAL_SQL} SELECT avg(CASE WHEN score >= 0.25 THEN 1 ELSE 0 END) AS iou_at_0_25, avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS iou_at_0_5 FROM evals""")
def _g16i(spark, sf):
    return bm.iou_hit_rates(evals(spark, sf).withColumnRenamed("score", "iou"))


_G17 = ("type:s family:s rows:l scorable:l excluded_gold_unparsed:l acc:d answered_pct:d acc_of_answered:d truncated_pct:d "
        "median_output_tokens:d direction_complete_pct:d direction_axis_acc:d")


@register("g17_rollup_scored", _G17, f"""
WITH {EVAL_SQL}, r AS (SELECT type, family, tokens, truncated, score, extra,
  CASE WHEN extra <> 4 THEN 1 ELSE 0 END AS gold, answered, CASE WHEN type = 'PROMO' THEN 1 ELSE 0 END AS dir, views % 3 AS stated, CASE WHEN correct = 1 THEN views % 3 ELSE 0 END AS axok,
  views % 2 AS missing FROM evals)
SELECT type, family, count(*) AS rows, sum(gold) AS scorable, count(*) - sum(gold) AS excluded_gold_unparsed,
  100 * sum(score * gold) / sum(gold) AS acc, 100.0 * sum(gold * answered) / sum(gold) AS answered_pct, 100 * sum(score * gold) / sum(gold * answered) AS acc_of_answered,
  100.0 * sum(truncated) / count(*) AS truncated_pct, list_sort(list(tokens))[count(*) // 2 + 1] AS median_output_tokens,
  CASE WHEN sum(gold * answered * dir) > 0 THEN 100.0 * sum(gold * answered * dir * (1 - missing)) / sum(gold * answered * dir) END AS direction_complete_pct,
  CASE WHEN sum(gold * answered * dir) > 0 THEN coalesce(100.0 * sum(gold * answered * dir * axok) / nullif(sum(gold * answered * dir * stated), 0), 0) END AS direction_axis_acc
FROM r GROUP BY type, family""")
def _g17(spark, sf):
    e = evals(spark, sf)
    rows = e.select(
        "type", F.col("family").alias("brand"), "score", "answered", "truncated", F.col("tokens").alias("output_tokens"),
        (F.col("extra") != 4).cast("int").alias("gold_parsed"),
        F.when(F.col("type") == "PROMO", "direction").otherwise("numeric").alias("family"),
        (F.col("views") % 3).alias("axes_stated"),
        F.when(F.col("correct") == 1, F.col("views") % 3).otherwise(0).alias("axes_correct"),
        (F.col("views") % 2).alias("axes_missing"),
    )
    return bm.rollup_scored(rows, ["type", "brand"]).withColumnRenamed("brand", "family")


@register("g18_coverage", "type:s views:l n:l acc:d coverage:d acc_on_answered:d pred_letters:s gold_letters:s", f"""
WITH {EVAL_SQL}, b AS (SELECT type, views, count(*) AS n, 100 * avg(correct) AS acc, 100 * avg(answered) AS coverage, 100 * avg(CASE WHEN answered = 1 THEN correct END) AS aa FROM evals GROUP BY ALL),
p AS (SELECT type, views, string_agg(pred || ':' || c, ' ' ORDER BY pred) AS h FROM (SELECT type, views, pred, count(*) AS c FROM evals GROUP BY ALL) GROUP BY ALL),
g AS (SELECT type, views, string_agg(gold || ':' || c, ' ' ORDER BY gold) AS h FROM (SELECT type, views, gold, count(*) AS c FROM evals GROUP BY ALL) GROUP BY ALL)
SELECT b.type, b.views, n, acc, coverage, aa AS acc_on_answered, p.h AS pred_letters, g.h AS gold_letters FROM b
JOIN p ON b.type = p.type AND b.views = p.views JOIN g ON b.type = g.type AND b.views = g.views""")
def _g18(spark, sf):
    return bm.coverage(evals(spark, sf), ["type", "views"])


_REASON = "CASE WHEN score >= 1 THEN 'correct' WHEN truncated = 1 THEN 'truncation_error' WHEN answered = 0 THEN 'parse_error' WHEN score > 0 THEN 'partial_error' ELSE 'factual_error' END"


def _summary_rows(spark, sf):
    s = F.col("score")
    reason = (F.when(s >= 1, "correct").when(F.col("truncated") == 1, "truncation_error").when(F.col("answered") == 0, "parse_error")
              .when(s > 0, "partial_error").otherwise("factual_error"))
    return evals(spark, sf).select(
        "type", s.alias("final_score"), (s * F.col("answered")).alias("rule_score"), (s * (F.col("extra") % 2)).alias("boxed_score"),
        F.col("answered").alias("final_answered"), "truncated", (F.col("extra") % 2).alias("boxed_present"),
        F.col("tokens").alias("output_tokens"), reason.alias("failure_reason"),
    )


@register("g19_run_summary", "type:s n:l score:d rule_only_score:d boxed_score:d answered_pct:d truncated:l boxed_present_pct:d tokens_median:l tokens_p90:l tokens_p95:l tokens_p99:l tokens_max:l", f"""
WITH {EVAL_SQL}, t AS (SELECT type, count(*) AS n, 100 * avg(score) AS score, 100 * avg(score * answered) AS rule_only_score, 100 * avg(score * (extra % 2)) AS boxed_score,
  100 * avg(answered) AS answered_pct, sum(truncated) AS truncated, 100 * avg(extra % 2) AS boxed_present_pct, list_sort(list(tokens))[count(*) // 2 + 1] AS med FROM evals GROUP BY type),
l AS (SELECT list_sort(list(tokens)) AS x, count(*) AS c FROM evals),
q AS (SELECT x[least(CAST(floor(c * 0.5) AS BIGINT), c - 1) + 1] AS p50, x[least(CAST(floor(c * 0.9) AS BIGINT), c - 1) + 1] AS p90, x[least(CAST(floor(c * 0.95) AS BIGINT), c - 1) + 1] AS p95,
  x[least(CAST(floor(c * 0.99) AS BIGINT), c - 1) + 1] AS p99, x[c] AS mx FROM l),
o AS (SELECT 100 * avg(answered) AS ap, sum(truncated) AS tr, 100 * avg(extra % 2) AS bp, count(*) AS n FROM evals)
SELECT type, n, score, rule_only_score, boxed_score, answered_pct, truncated, boxed_present_pct, med AS tokens_median, NULL AS tokens_p90, NULL AS tokens_p95, NULL AS tokens_p99, NULL AS tokens_max FROM t
UNION ALL SELECT 'overall', any_value(o.n), avg(score), avg(rule_only_score), avg(boxed_score), any_value(ap), any_value(tr), any_value(bp), any_value(p50), any_value(p90), any_value(p95), any_value(p99), any_value(mx) FROM t, q, o""")
def _g19(spark, sf):
    return bm.run_summary(_summary_rows(spark, sf))


@register("g19_failure_counts", "type:s failure_reason:s n:l", f"""
WITH {EVAL_SQL}, r AS (SELECT type, {_REASON} AS failure_reason FROM evals)
SELECT type, failure_reason, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'overall', failure_reason, count(*) FROM r GROUP BY failure_reason""")
def _g19f(spark, sf):
    return bm.failure_counts(_summary_rows(spark, sf))


@register("g20_sweep_curve", "type:s extra:l rows:l acc:d answered_pct:d mean_views:d", f"""
WITH {EVAL_SQL} SELECT type, extra, count(*) AS rows, 100 * avg(score) AS acc, 100 * avg(answered) AS answered_pct, avg(views) AS mean_views FROM evals GROUP BY type, extra""")
def _g20(spark, sf):
    return bm.curve(evals(spark, sf), ["type", "extra"])


@register("g20_sweep_delta", "type:s low_acc:d high_acc:d delta:d", f"""
WITH {EVAL_SQL} SELECT type, 100 * avg(CASE WHEN extra = 0 THEN score END) AS low_acc, 100 * avg(CASE WHEN extra = 4 THEN score END) AS high_acc,
 100 * avg(CASE WHEN extra = 4 THEN score END) - 100 * avg(CASE WHEN extra = 0 THEN score END) AS delta FROM evals GROUP BY type""")
def _g20d(spark, sf):
    return bm.curve_delta(evals(spark, sf), "extra", 0, 4, kind="type")


@register("g21_batch_composition", "metric:s value:d", f"""
WITH {ROLLOUT_SQL}, b AS (SELECT uid, user_id, data_source AS source, k % 4 AS k_views, length, score, k % 2 AS sensitive FROM rollouts)
SELECT 'num_sequences' AS metric, count(*)::DOUBLE AS value FROM b UNION ALL SELECT 'num_prompts', count(DISTINCT uid) FROM b UNION ALL SELECT 'num_unique_samples', count(DISTINCT user_id) FROM b
UNION ALL SELECT 'k_views/mean', avg(k_views) FROM b UNION ALL SELECT 'sensitive/frac', avg(sensitive) FROM b
UNION ALL SELECT 'source/' || source || '/frac', count(*) / (SELECT count(*) FROM b) FROM b GROUP BY source
UNION ALL SELECT 'k_views/' || k_views || '/frac', count(*) / (SELECT count(*) FROM b) FROM b GROUP BY k_views
UNION ALL SELECT 'source/' || source || '/response_length/mean', avg(length) FROM b GROUP BY source
UNION ALL SELECT 'source/' || source || '/score/mean', avg(score) FROM b GROUP BY source""")
def _g21(spark, sf):
    b = rollouts(spark, sf).select(
        "uid", F.col("user_id").alias("sample_id"), F.col("data_source").alias("source"), (F.col("k") % 4).alias("k_views"),
        "length", "score", (F.col("k") % 2).alias("sensitive"),
    )
    return mt.composition(b, ["source", "k_views"], means=["k_views"], flags=["sensitive"])


def _nulls(spark, sf):
    e = evals(spark, sf).withColumn(
        "response", F.concat(F.when(F.col("extra") == 0, "Based on it, ").otherwise(" So "), F.col("pred"))
    ).withColumn("n_choices", F.col("views") % 3 + 2)
    return bm.null_baselines(e, _HALVES, source="type")


_NULL_SQL = f"""
WITH {EVAL_SQL}, l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'F']) AS letter),
a AS (SELECT letter, type, avg(CASE WHEN gold = letter THEN 1 ELSE 0 END) AS acc FROM evals, l GROUP BY ALL),
c AS (SELECT 'constant ' || letter AS rule, 100 * ((max(CASE WHEN type = 'SMALL' THEN acc END) + max(CASE WHEN type = 'MEDIUM' THEN acc END)) / 2 + max(CASE WHEN type = 'LARGE' THEN acc END)) / 2 AS score FROM a GROUP BY letter)"""


@register("g22_null_baselines", "rule:s score:d", _NULL_SQL + """,
b AS (SELECT type, avg(CASE WHEN extra = 0 AND gold = 'B' THEN 1 ELSE 0 END) AS acc FROM evals GROUP BY type)
SELECT * FROM c UNION ALL SELECT 'opens with Based', 100 * ((max(CASE WHEN type = 'SMALL' THEN acc END) + max(CASE WHEN type = 'MEDIUM' THEN acc END)) / 2 + max(CASE WHEN type = 'LARGE' THEN acc END)) / 2 FROM b
UNION ALL SELECT 'random', 100 * avg(1.0::DOUBLE / (views % 3 + 2)) FROM evals""")
def _g22(spark, sf):
    return _nulls(spark, sf)


@register("g22_best_constant", "rule:s score:d", _NULL_SQL + " SELECT * FROM c ORDER BY score DESC, rule LIMIT 1")
def _g22b(spark, sf):
    return bm.best_constant(_nulls(spark, sf))


_RESP = "CASE extra WHEN 0 THEN '(' || pred || ')' WHEN 1 THEN pred || '. the ' || family WHEN 2 THEN 'I think it is ' || pred WHEN 3 THEN '  ' ELSE 'Look:' || chr(10) || family END"


def _responses(spark, sf):
    x, p, fam = F.col("extra"), F.col("pred"), F.col("family")
    resp = (F.when(x == 0, F.concat(F.lit("("), p, F.lit(")"))).when(x == 1, F.concat(p, F.lit(". the "), fam))
            .when(x == 2, F.concat(F.lit("I think it is "), p)).when(x == 3, F.lit("  ")).otherwise(F.concat(F.lit("Look:\n"), fam)))
    return evals(spark, sf).withColumn("response", resp).withColumn("pred", F.when(x == 3, "").otherwise(p))


@register("g23_response_shape", "type:s rows:l bare_letter:d letter_then_text:d prose:d empty:d parse_fail:d spurious:d words:d", f"""
WITH {EVAL_SQL} SELECT type, count(*) AS rows, 100 * avg(CASE WHEN extra = 0 THEN 1 ELSE 0 END) AS bare_letter, 100 * avg(CASE WHEN extra = 1 THEN 1 ELSE 0 END) AS letter_then_text,
  100 * avg(CASE WHEN extra IN (2, 4) THEN 1 ELSE 0 END) AS prose, 100 * avg(CASE WHEN extra = 3 THEN 1 ELSE 0 END) AS empty, 100 * avg(CASE WHEN extra = 3 THEN 1 ELSE 0 END) AS parse_fail,
  100 * avg(CASE WHEN extra IN (2, 4) THEN 1 ELSE 0 END) AS spurious, avg(CASE extra WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 0 ELSE 2 END) AS words FROM evals GROUP BY type""")
def _g23(spark, sf):
    return bm.response_shape(_responses(spark, sf), ["type"])


@register("g23_top_openings", "type:s rank:l head:s c:l", f"""
WITH {EVAL_SQL}, h AS (SELECT type, replace(substr(trim({_RESP}), 1, 40), chr(10), '\\n') AS head FROM evals), c AS (SELECT type, head, count(*) AS c FROM h GROUP BY ALL)
SELECT type, row_number() OVER (PARTITION BY type ORDER BY c DESC, head) AS rank, head, c FROM c QUALIFY rank <= 6""")
def _g23t(spark, sf):
    return bm.top_openings(_responses(spark, sf), ["type"])


@register("g31_staleness_stats", "avg:d4 max:d4 min:d4 tp50:d4 tp95:d4 tp99:d4 total_partial_num:l partial_ratio:d max_partial_span:l param_version_diversity:l stale_samples:l stale_trajectories:l", f"""
WITH {ROLLOUT_SQL}, x AS (SELECT score, step AS v, step + k % 3 AS e, (SELECT max(step) FROM rollouts) AS cur FROM rollouts)
SELECT avg(score) AS avg, max(score) AS max, min(score) AS min, quantile_cont(score, 0.5) AS tp50, quantile_cont(score, 0.95) AS tp95, quantile_cont(score, 0.99) AS tp99,
 sum(CASE WHEN e <> v THEN 1 ELSE 0 END) AS total_partial_num, avg(CASE WHEN e <> v THEN 1 ELSE 0 END) AS partial_ratio, max(e - v) AS max_partial_span,
 count(DISTINCT v) AS param_version_diversity, sum(CASE WHEN cur - v >= 1 THEN 1 ELSE 0 END) AS stale_samples, sum(CASE WHEN cur - e >= 1 THEN 1 ELSE 0 END) AS stale_trajectories FROM x""")
def _g31(spark, sf):
    r = rollouts(spark, sf)
    now = r.agg(F.max("step").alias("s")).scalar()
    df = r.select(
        F.col("score").alias("processing_time"), F.col("step").alias("param_version"), F.col("step").alias("param_version_start"),
        (F.col("step") + F.col("k") % 3).alias("param_version_end"),
    )
    return mt.staleness_stats(df, now)
