"""Corpus queries: G24-G27, G32."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import corpus as cp
from scoreloom.plans.catalog import register, table
from scoreloom.plans.fixtures import EVAL_SQL, ROLLOUT_SQL, evals, rollouts


@register("g24_likelihood_statistics", "source:s mean:d perplexity:d weighted_perplexity:d bits_per_byte:d", """
WITH l AS (SELECT source, -1 - doc_id % 7 / 10.0::DOUBLE AS v, 1 + doc_id % 5 AS w FROM documents)
SELECT source, avg(v) AS mean, exp(-avg(v)) AS perplexity, exp(-sum(v) / sum(w)) AS weighted_perplexity, -sum(v) / sum(w) / ln(2) AS bits_per_byte FROM l GROUP BY source""")
def _g24(spark, sf):
    d = table(spark, sf, "documents").select("source", (F.lit(-1.0) - F.col("doc_id") % 7 / 10.0).alias("value"), (F.col("doc_id") % 5 + 1).alias("weight"))
    parts = [cp.mean_like(d, n, keys=["source"]) for n in ("mean", "perplexity", "weighted_perplexity", "bits_per_byte")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "source")
    return out


@register("g24_middle_element", "median:d", "SELECT value AS median FROM events ORDER BY event_id LIMIT 1 OFFSET (SELECT count(*) // 2 FROM events)")
def _g24m(spark, sf):
    return cp.middle_element(table(spark, sf, "events"), "value", "event_id")


@register("g24_binary_scores", "type:s f1:d mcc:d", f"""
WITH {EVAL_SQL}, c AS (SELECT type, sum(correct * answered)::DOUBLE AS tp, sum((1 - correct) * answered)::DOUBLE AS fp, sum(correct * (1 - answered))::DOUBLE AS fn, sum((1 - correct) * (1 - answered))::DOUBLE AS tn FROM evals GROUP BY type)
SELECT type, 2 * tp / (2 * tp + fp + fn) AS f1, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM c""")
def _g24b(spark, sf):
    return cp.binary_scores(evals(spark, sf).withColumn("gold", F.col("correct")).withColumn("pred", F.col("answered")), keys=["type"])


@register("g24_brier_score", "label:l brier_score:d", """
WITH p AS (SELECT vec_id, label, i - 1 AS i, abs(CAST(embedding[i] AS DOUBLE)) AS a FROM embeddings, range(1, 65) t(i)), n AS (SELECT *, a / sum(a) OVER (PARTITION BY vec_id) AS q FROM p),
b AS (SELECT vec_id, label, sum(pow(q - CASE WHEN i = label THEN 1 ELSE 0 END, 2)) AS e FROM n GROUP BY ALL) SELECT label, avg(e) AS brier_score FROM b GROUP BY label""")
def _g24s(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    e = e.withColumn("t", total).select("label", F.transform("a", lambda x: x / F.col("t")).alias("probs"))
    return cp.brier(e, gold="label", keys=["label"])


_CAP_SQL = """
cap AS (SELECT conv_id * 100 + turn AS id, text, text AS p, [substr(text, 20), substr(text, 60)] AS r, turn % 4 AS q FROM conversations),
txt AS (SELECT id, -1 AS ref, CASE WHEN q < 3 THEN p ELSE '' END AS t FROM cap UNION ALL SELECT id, i - 1, r[i] FROM cap, range(1, 3) g(i)),
tok AS (SELECT id, ref, list_filter(regexp_split_to_array('sos ' || lower(replace(replace(t, '.', ' . '), ',', ' , ')) || ' eos', '\\s+'), lambda w: w <> '') AS w FROM txt),
gr AS (SELECT id, ref, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tok, range(1, 5) z(k))),
gc AS (SELECT id, ref, k, gram, count(*) AS c FROM gr GROUP BY ALL)
"""


def _captions(spark, sf):
    c = table(spark, sf, "conversations", spread=True)
    df = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("pred"), F.array(F.expr("substr(text, 20)"), F.expr("substr(text, 60)")).alias("refs"),
                  F.when(F.col("turn") % 4 < 3, 0.6).otherwise(0.2).alias("iou"))
    return cp.caption_tokens(df, "pred", "refs", "iou")


@register("g25_ngram_document_frequency", "k:l gram:s df:l", f"""
WITH {_CAP_SQL} SELECT k, gram, count(DISTINCT id) AS df FROM gc WHERE ref >= 0 GROUP BY k, gram""")
def _g25(spark, sf):
    return cp.document_frequency(_captions(spark, sf), "id")


@register("g25_corpus_bleu", "bleu_1:d bleu_2:d bleu_3:d bleu_4:d", f"""
WITH {_CAP_SQL}, b AS (SELECT id, k, gram, max(c) AS cap FROM gc WHERE ref >= 0 GROUP BY ALL),
m AS (SELECT h.k, sum(least(h.c, b.cap)) AS m FROM gc h JOIN b ON h.id = b.id AND h.k = b.k AND h.gram = b.gram WHERE h.ref = -1 GROUP BY h.k),
l AS (SELECT id, ref, len(w) AS n FROM tok),
c AS (SELECT h.id, h.n AS hn, min(struct_pack(d := abs(r.n - h.n), l := r.n)).l AS rn FROM l h JOIN l r ON h.id = r.id AND r.ref >= 0 WHERE h.ref = -1 GROUP BY h.id, h.n),
s AS (SELECT sum(hn)::DOUBLE AS t, sum(rn)::DOUBLE AS r, sum(greatest(hn, 0)) AS g1, sum(greatest(hn - 1, 0)) AS g2, sum(greatest(hn - 2, 0)) AS g3, sum(greatest(hn - 3, 0)) AS g4 FROM c),
x AS (SELECT t / r AS ratio, (SELECT m FROM m WHERE k = 1) / (g1 + 1e-9::DOUBLE) AS p1, (SELECT m FROM m WHERE k = 2) / (g2 + 1e-9::DOUBLE) AS p2, (SELECT m FROM m WHERE k = 3) / (g3 + 1e-9::DOUBLE) AS p3, (SELECT m FROM m WHERE k = 4) / (g4 + 1e-9::DOUBLE) AS p4 FROM s),
y AS (SELECT *, CASE WHEN ratio < 1 THEN exp(1 - 1 / ratio) ELSE 1 END AS bp FROM x)
SELECT p1 * bp AS bleu_1, pow(p1 * p2, 0.5::DOUBLE) * bp AS bleu_2, pow(p1 * p2 * p3, 1.0::DOUBLE / 3) * bp AS bleu_3, pow(p1 * p2 * p3 * p4, 0.25::DOUBLE) * bp AS bleu_4 FROM y""")
def _g25b(spark, sf):
    return cp.corpus_bleu(_captions(spark, sf), "id")


@register("g25_cider", "id:l cider:d", f"""
WITH {_CAP_SQL}, d AS (SELECT k, gram, count(DISTINCT id) AS df FROM gc WHERE ref >= 0 GROUP BY k, gram), n AS (SELECT ln(count(*)::DOUBLE) AS logn FROM cap),
w AS (SELECT gc.*, c * (logn - ln(greatest(coalesce(df, 0), 1)::DOUBLE)) AS w FROM gc LEFT JOIN d ON gc.k = d.k AND gc.gram = d.gram, n),
nm AS (SELECT id, ref, k, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL), ln_ AS (SELECT id, ref, sum(CASE WHEN k = 2 THEN c ELSE 0 END) AS len FROM gc GROUP BY ALL),
dt AS (SELECT h.id, r.ref, h.k, sum(least(h.w, r.w) * r.w) AS dot FROM w h JOIN w r ON h.id = r.id AND h.k = r.k AND h.gram = r.gram AND r.ref >= 0 WHERE h.ref = -1 GROUP BY ALL),
s AS (SELECT dt.id, CASE WHEN hn.norm <> 0 AND rn.norm <> 0 THEN dot / (hn.norm * rn.norm) ELSE dot END * exp(-pow(hl.len - rl.len, 2) / 72.0::DOUBLE) AS s FROM dt
  JOIN nm rn ON dt.id = rn.id AND dt.ref = rn.ref AND dt.k = rn.k JOIN nm hn ON dt.id = hn.id AND hn.ref = -1 AND dt.k = hn.k JOIN ln_ rl ON dt.id = rl.id AND dt.ref = rl.ref JOIN ln_ hl ON dt.id = hl.id AND hl.ref = -1)
SELECT cap.id, coalesce(sum(s), 0) / 4 / 2 * 10 AS cider FROM cap LEFT JOIN s ON cap.id = s.id GROUP BY cap.id""")
def _g25c(spark, sf):
    return cp.cider(_captions(spark, sf), "id")


@register("g25_chrf", "chrf:d", """
WITH c AS (SELECT conv_id * 100 + turn AS id, regexp_replace(text, '\\s+', '', 'g') AS h, regexp_replace(substr(text, 20), '\\s+', '', 'g') AS r FROM conversations),
g AS (SELECT id, k, h[i:i + k - 1] AS gram, 1 AS h, 0 AS r FROM (SELECT *, unnest(range(1, length(h) - k + 2)) AS i FROM c, range(1, 7) z(k)) UNION ALL
      SELECT id, k, r[i:i + k - 1], 0, 1 FROM (SELECT *, unnest(range(1, length(r) - k + 2)) AS i FROM c, range(1, 7) z(k))),
s AS (SELECT id, k, gram, sum(h) AS h, sum(r) AS r FROM g GROUP BY ALL), k AS (SELECT k, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM s GROUP BY k),
p AS (SELECT avg(m / h) AS p, avg(m / r) AS q FROM k WHERE h > 0 AND r > 0) SELECT 100 * 5 * p * q / (4 * p + q) AS chrf FROM p""")
def _g25f(spark, sf):
    c = table(spark, sf, "conversations", spread=True).select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("hyp"), F.expr("substr(text, 20)").alias("ref"))
    return cp.corpus_chrf(c, "id")


@register("g25_metrics_by_name", "metric:s value:d", f"""
WITH {_CAP_SQL}, b AS (SELECT id, k, gram, max(c) AS cap FROM gc WHERE ref >= 0 GROUP BY ALL),
m AS (SELECT sum(least(h.c, b.cap)) AS m FROM gc h JOIN b ON h.id = b.id AND h.k = b.k AND h.gram = b.gram WHERE h.ref = -1 AND h.k = 1),
l AS (SELECT id, ref, len(w) AS n FROM tok),
c AS (SELECT h.id, h.n AS hn, min(struct_pack(d := abs(r.n - h.n), l := r.n)).l AS rn FROM l h JOIN l r ON h.id = r.id AND r.ref >= 0 WHERE h.ref = -1 GROUP BY h.id, h.n),
s AS (SELECT sum(hn)::DOUBLE AS t, sum(rn)::DOUBLE AS r FROM c)
SELECT 'bleu' AS metric, (SELECT m FROM m) / t * CASE WHEN t / r < 1 THEN exp(1 - r / t) ELSE 1 END AS value FROM s
UNION ALL SELECT 'rows', (SELECT count(*) FROM cap)::DOUBLE""")
def _g25n(spark, sf):
    from scoreloom.operators.metrics import METRICS, compute_metrics, register_metric

    if "rows" not in METRICS:
        register_metric("rows")(lambda df, **_: df.agg(F.count(F.lit(1)).alias("rows")))
    found = compute_metrics(_captions(spark, sf), ["bleu", "rows"], id_col="id")
    return found["bleu"].select(F.lit("bleu").alias("metric"), F.col("bleu_1").alias("value")).unionByName(
        found["rows"].select(F.lit("rows").alias("metric"), F.col("rows").cast("double").alias("value")))


@register("g25_rouge_l", "id:l rouge_l:d", f"""
WITH RECURSIVE {_CAP_SQL}, sp AS (SELECT id, ref, string_split('sos ' || lower(replace(replace(t, '.', ' . '), ',', ' , ')) || ' eos', ' ') AS w FROM txt),
pr AS (SELECT h.id, r.ref, h.w AS c, r.w AS r FROM sp h JOIN sp r ON h.id = r.id AND r.ref >= 0 WHERE h.ref = -1),
dp AS (SELECT id, ref, c, r, 0 AS i, list_transform(range(0, len(r) + 1), lambda x: CAST(0 AS BIGINT)) AS row FROM pr
  UNION ALL SELECT id, ref, c, r, i + 1, list_reduce(list_transform(range(1, len(r) + 1), lambda j: [j]),
    lambda acc, x: list_append(acc, CASE WHEN r[x[1]] = c[i + 1] THEN row[x[1]] + 1 ELSE greatest(acc[x[1]], row[x[1] + 1]) END), [CAST(0 AS BIGINT)]) FROM dp WHERE i < len(c)),
f AS (SELECT id, ref, row[len(r) + 1] / len(c)::DOUBLE AS p, row[len(r) + 1] / len(r)::DOUBLE AS q FROM dp WHERE i = len(c)), m AS (SELECT id, max(p) AS p, max(q) AS q FROM f GROUP BY id)
SELECT id, CASE WHEN p <> 0 AND q <> 0 THEN (1 + 1.2::DOUBLE * 1.2) * p * q / (q + 1.2::DOUBLE * 1.2 * p) ELSE 0 END AS rouge_l FROM m""")
def _g25r(spark, sf):
    c = _captions(spark, sf)
    return c.select("id", cp.rouge_l(F.col("hyp"), F.col("ref_list")).alias("rouge_l"))


_SUB_SQL = f"{EVAL_SQL}, sub AS (SELECT type, row_number() OVER (ORDER BY type) AS pos, avg(score) AS metric, stddev_samp(score) / sqrt(count(*)) AS stderr, count(*) AS size FROM evals GROUP BY type)"


def _subtasks(spark, sf):
    from pyspark.sql import Window

    s = evals(spark, sf).groupBy("type").agg(
        F.avg("score").alias("metric"), (F.stddev_samp("score") / F.sqrt(F.count(F.lit(1)))).alias("stderr"), F.count(F.lit(1)).alias("size"))
    return s.withColumn("pos", F.row_number().over(Window.orderBy("type")))


@register("g26_sample_stderr", "type:s stderr:d8", f"WITH {EVAL_SQL} SELECT type, stddev_samp(score) / sqrt(count(*)) AS stderr FROM evals GROUP BY type")
def _g26(spark, sf):
    return cp.stderr(evals(spark, sf), "score", ["type"])


@register("g26_pooled_stderr", "pooled_stderr:d8", f"WITH {_SUB_SQL} SELECT sqrt(sum((size - 1) * stderr * stderr * size) / (sum(size) - count(*)) / sum(size)) AS pooled_stderr FROM sub")
def _g26p(spark, sf):
    return cp.pooled_stderr(_subtasks(spark, sf))


@register("g26_combined_stderr", "combined_stderr:d8", f"""
WITH RECURSIVE {_SUB_SQL}, f AS (SELECT pos, metric AS m, stderr * stderr AS v, size::DOUBLE AS n0 FROM sub WHERE pos = 1
  UNION ALL SELECT s.pos, (f.m * n0 + s.metric * s.size) / (n0 + s.size),
   ((n0 - 1) * v + (s.size - 1) * s.stderr * s.stderr) / (n0 + s.size - 1) + n0 * s.size / ((n0 + s.size) * (n0 + s.size - 1)) * pow((f.m * n0 + s.metric * s.size) / (n0 + s.size) - s.metric, 2), n0
  FROM sub s JOIN f ON s.pos = f.pos + 1) SELECT sqrt(v) AS combined_stderr FROM f ORDER BY pos DESC LIMIT 1""")
def _g26c(spark, sf):
    return cp.combined_stderr(_subtasks(spark, sf))


# Running sums of the Poisson(1) probabilities, written out by the same recurrence in SQL.
_POISSON = "len(list_filter(list_transform(range(0, 18), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-1.0::DOUBLE) / gamma(j + 1)))), lambda t: u >= t))"


@register("g26_bootstrap_stderr", "data_source:s stderr:d", f"""
WITH {ROLLOUT_SQL}, d AS (SELECT data_source, rep, score, CAST('0x' || substr(md5('0/' || pos || '/' || rep), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM rollouts, range(1, 41) t(rep)),
w AS (SELECT data_source, rep, score, {_POISSON} AS w FROM d), s AS (SELECT data_source, rep, sum(score * w) / sum(w) AS m FROM w GROUP BY ALL)
SELECT data_source, stddev_samp(m) AS stderr FROM s GROUP BY data_source""")
def _g26b(spark, sf):
    mean = lambda w: F.sum(F.col("score") * w) / F.sum(w)
    return cp.bootstrap_stderr(rollouts(spark, sf), "pos", mean, replicates=40, keys=["data_source"])


@register("g27_group_metrics", "group_name:s metric:s value:d samples:l stderr:d8", f"""
WITH {EVAL_SQL}, r AS (SELECT type AS task, 'acc' AS metric, avg(correct) AS value, count(*) AS size, stddev_samp(correct) / sqrt(count(*)) AS se FROM evals GROUP BY type
  UNION ALL SELECT type, 'score', avg(score), count(*), stddev_samp(score) / sqrt(count(*)) FROM evals GROUP BY type),
e AS (SELECT * FROM (VALUES ('all', 'SMALL'), ('all', 'LARGE'), ('all', 'PROMO'), ('all', 'ECONOMY'), ('sized', 'SMALL'), ('sized', 'LARGE')) t(g, task))
SELECT g AS group_name, metric, sum(value * size) / sum(size) AS value, sum(size) AS samples, sqrt(sum((size - 1) * se * se * size) / (sum(size) - count(*)) / sum(size)) AS stderr FROM r JOIN e ON r.task = e.task GROUP BY g, metric""")
def _g27(spark, sf):
    e = evals(spark, sf)
    pairs = F.array(F.struct(F.lit("acc").alias("metric"), F.col("correct").cast("double").alias("v")), F.struct(F.lit("score").alias("metric"), F.col("score").alias("v")))
    r = e.select(F.col("type").alias("task"), F.inline(pairs)).groupBy("task", "metric").agg(
        F.avg("v").alias("value"), F.count(F.lit(1)).alias("size"), (F.stddev_samp("v") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    tree = {"all": {"sized": {"SMALL": None, "LARGE": None}, "PROMO": None, "ECONOMY": None}}
    return cp.group_metrics(r, tree, se="se").withColumnRenamed("group", "group_name")


_LOG_SQL = f"""{ROLLOUT_SQL}, c AS (SELECT step, k % 4 AS kk, count(*) AS c FROM rollouts GROUP BY ALL),
sh AS (SELECT step, kk, round(c / sum(c) OVER (PARTITION BY step), 6) AS x FROM c), m AS (SELECT step, round(avg(score) / 10, 6) AS metric, round(avg(length), 4) AS len FROM rollouts GROUP BY step)"""


def _log_lines(spark, sf):
    r = rollouts(spark, sf)
    c = r.groupBy("step", (F.col("k") % 4).alias("kk")).agg(F.count(F.lit(1)).alias("c"))
    t = r.groupBy("step").agg(F.round(F.avg("score") / 10, 6).alias("m"), F.round(F.avg("length"), 4).alias("len"), F.count(F.lit(1)).alias("n"))
    dec = lambda col: col.cast("decimal(18,6)").cast("string")
    part = F.concat(F.lit("data/step/k_views/"), F.col("kk").cast("string"), F.lit("/frac:"), dec(F.round(F.col("c") / F.col("n"), 6)))
    j = c.join(t, "step").groupBy("step", "m", "len").agg(F.array_join(F.array_sort(F.collect_list(part)), " - ").alias("p"))
    return j.select(F.concat(F.lit("step:"), F.col("step").cast("string"), F.lit(" - actor/loss:"), dec(F.col("m")), F.lit(" - response_length/mean:"),
                             dec(F.col("len")), F.lit(" - "), F.col("p")).alias("value"))


def _steps(spark, sf):
    log = cp.parse_step_log(_log_lines(spark, sf), "actor/loss", r"k_views/(\d+)/frac", {"length": "response_length/mean"})
    return cp.detrend(log)


@register("g32_parse_and_detrend", "step:l metric:d length:d detrended:d shares:s", f"""
WITH {_LOG_SQL}, s AS (SELECT step, string_agg(kk || '=' || CAST(CAST(x AS DECIMAL(18,6)) AS VARCHAR), ' ' ORDER BY kk) AS shares FROM sh GROUP BY step)
SELECT m.step, metric, len AS length, metric - median(metric) OVER (ORDER BY m.step ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS detrended, shares FROM m JOIN s ON m.step = s.step""")
def _g32(spark, sf):
    s = _steps(spark, sf)
    shown = F.array_join(F.transform(F.array_sort("shares"), lambda e: F.concat(e["key"], F.lit("="), e["x"].cast("decimal(18,6)").cast("string"))), " ")
    return s.withColumn("shares", shown)


@register("g32_composition_regression", "key:s slope:d r2:d mean_share:d")
def _g32r(spark, sf):
    return cp.composition_regression(_steps(spark, sf), replicates=20)


@register("g32_two_share_regression", "key:s slope:d r2:d mean_share:d", f"""
WITH {_LOG_SQL}, d AS (SELECT step, metric - median(metric) OVER (ORDER BY step ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS y FROM m),
x AS (SELECT d.step, y, (SELECT max(x) FROM sh WHERE sh.step = d.step) AS c FROM d),
r AS (SELECT covar_pop(y, c) / var_pop(c) AS b, var_pop(c) AS vc, var_pop(y) AS vy, avg(c) AS mc FROM x)
-- The two shares add up to one: of all solutions the smallest has opposite slopes, each half of the simple regression's.
SELECT 'largest' AS key, b / 2 AS slope, b * b * vc / vy AS r2, mc AS mean_share FROM r
UNION ALL SELECT 'rest', -b / 2, b * b * vc / vy, 1 - mc FROM r""")
def _g32t(spark, sf):
    largest = F.array_max(F.transform("shares", lambda e: e["x"]))
    two = F.array(F.struct(F.lit("largest").alias("key"), largest.alias("x")), F.struct(F.lit("rest").alias("key"), (1 - largest).alias("x")))
    return cp.composition_regression(_steps(spark, sf).withColumn("shares", two))
