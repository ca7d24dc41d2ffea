"""Sampling and view queries: SMP1-SMP7, V1-V8, W16, W17, O6."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import ranking as rk
from scoreloom.operators import sampling as sm
from scoreloom.operators import views as vw
from scoreloom.plans.catalog import register, table
from scoreloom.plans.fixtures import EVAL_SQL, PLAN_SQL, ROLLOUT_SQL, csv, evals, plans, rollouts

_H = "md5('0/' || CAST({} AS VARCHAR))"


@register("smp1_draw_exact", "o_orderkey:l o_orderpriority:s", f"""
WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_H.format('o_orderkey')}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderkey, o_orderpriority FROM r WHERE rn <= floor(n * 0.6::DOUBLE)""")
def _smp1(spark, sf):
    return sm.draw_exact(table(spark, sf, "orders"), 0.6, "o_orderkey", ["o_orderpriority"])


_STRAT = f"""
WITH t AS (SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY event_type ORDER BY {_H.format('event_id')}, event_id) AS rn FROM events),
f AS (SELECT *, CASE WHEN rn <= round_even(n * 480.0::DOUBLE / total, 0) THEN 0 ELSE 1 END AS f FROM t)
SELECT event_id, event_type FROM f ORDER BY f, {_H.format('event_id')}, event_id LIMIT 480"""


@register("smp2_stratified", "event_id:l event_type:s", _STRAT)
def _smp2(spark, sf):
    return sm.stratified(table(spark, sf, "events"), "event_type", 480, "event_id")


@register("smp2_quota_per_type", "event_id:l event_type:s", f"""
SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_H.format('event_id')}, event_id) <= 100""")
def _smp2q(spark, sf):
    return sm.quota_per_type(table(spark, sf, "events"), "event_type", 100, "event_id")


@register("smp3_spot_check", "event_id:l bucket:s", f"""
WITH e AS (SELECT event_id, value, event_type, {_H.format('event_id')} AS h FROM events),
a AS (SELECT event_id, h FROM e WHERE value > 150 ORDER BY h, event_id LIMIT 15),
b AS (SELECT event_id, h FROM e WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id FROM a) ORDER BY h, event_id LIMIT 20),
c AS (SELECT event_id, h FROM e WHERE event_id NOT IN (SELECT event_id FROM a) AND event_id NOT IN (SELECT event_id FROM b) ORDER BY h, event_id LIMIT 50),
u AS (SELECT 0 AS o, 'high' AS bucket, * FROM a UNION ALL SELECT 1, 'error', * FROM b UNION ALL SELECT 2, 'fill', * FROM c)
SELECT event_id, bucket FROM u ORDER BY o, h, event_id LIMIT 50""")
def _smp3(spark, sf):
    e = table(spark, sf, "events")
    return sm.spot_check(e, [("high", F.col("value") > 150, 15), ("error", F.col("event_type") == "error", 20)], "event_id", 50)


_UNIT = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


@register("smp4_audit_sample", "event_id:l", f"SELECT event_id FROM events WHERE value > 1 AND {_UNIT.format("'0/' || event_id")} < 0.02")
def _smp4(spark, sf):
    return sm.audit_sample(table(spark, sf, "events"), 0.02, "event_id", F.col("value") > 1)


@register("smp5_limit_first", "o_orderkey:l", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 777")
def _smp5(spark, sf):
    return sm.limit_rows(table(spark, sf, "orders"), 777, "first", "o_orderkey")


@register("smp5_limit_random", "o_orderkey:l", f"SELECT o_orderkey FROM orders ORDER BY {_H.format('o_orderkey')}, o_orderkey LIMIT 777")
def _smp5r(spark, sf):
    return sm.limit_rows(table(spark, sf, "orders"), 777, "random", "o_orderkey")


@register("smp5_limit_stride", "o_orderkey:l", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM r WHERE row % greatest(n // 777, 1) = 0 AND row // greatest(n // 777, 1) < 777""")
def _smp5s(spark, sf):
    return sm.limit_rows(table(spark, sf, "orders"), 777, "stride", "o_orderkey")


@register("smp5_shuffle", "o_orderkey:l", "SELECT o_orderkey FROM orders")
def _smp5h(spark, sf):
    return sm.shuffle_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=7)


@register("smp6_resample_weights", "how:s pos:l weight:d4", f"""
WITH {ROLLOUT_SQL}, m AS (SELECT max(score) AS hi, min(score) AS lo FROM rollouts)
SELECT 'pow' AS how, pos, score * score + 1e-8::DOUBLE AS weight FROM rollouts
UNION ALL SELECT 'max_min', pos, CASE WHEN score = hi OR score = lo THEN 1 ELSE 0 END + 1e-8::DOUBLE FROM rollouts, m
UNION ALL SELECT 'max_random', pos, CASE WHEN score = hi THEN 0.4 ELSE 0.1 END + 1e-8::DOUBLE FROM rollouts, m""")
def _smp6(spark, sf):
    r = rollouts(spark, sf)
    parts = [sm.resample_weights(r, how).select(F.lit(how).alias("how"), "pos", "weight") for how in ("pow", "max_min", "max_random")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("smp6_resample_draws", "draw:l pos:l score:d", f"""
WITH {ROLLOUT_SQL}, c AS (SELECT pos, score, sum(score + 1e-8::DOUBLE) OVER (ORDER BY pos) AS hi FROM rollouts), t AS (SELECT max(hi) AS t FROM c),
d AS (SELECT pos AS draw, {_UNIT.format("'0/' || pos")} * t AS u FROM rollouts, t)
SELECT d.draw, c.pos, c.score FROM d ASOF JOIN c ON d.u < c.hi""")
def _smp6d(spark, sf):
    r = sm.resample_weights(rollouts(spark, sf).select("pos", "score"), "pow", 1.0)
    return sm.resample_weighted(r, "pos")


_HOLD_SQL = f"""
WITH {PLAN_SQL}, s AS (SELECT source, scene, min(id) AS f FROM plan GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f) AS r, count(*) OVER (PARTITION BY source) AS n FROM s),
h AS (SELECT p.id, row_number() OVER (PARTITION BY p.source ORDER BY p.id) AS rn FROM plan p JOIN k ON p.source = k.source AND p.scene = k.scene WHERE r <= greatest(n // 20, 1))
"""


@register("smp7_holdout_by_scene", "id:l source:s split:s", _HOLD_SQL + """
SELECT p.id, p.source, CASE WHEN h.rn <= 40 THEN 'holdout' ELSE 'train' END AS split FROM plan p LEFT JOIN h ON p.id = h.id""")
def _smp7(spark, sf):
    return sm.holdout_by_scene(plans(spark, sf), pos="id", cap=40)


def _order_sql(seed: int, views: str = "range(0, n_views)") -> str:
    """Required views ascending, then the others in hash order, as a list."""
    return f"""list_concat(list_sort(list_distinct(required)), list_transform(list_sort(list_transform(
      list_filter(CAST({views} AS INTEGER[]), lambda v: NOT list_contains(required, v)),
      lambda v: {{'h': md5('{seed}/' || CAST(id AS VARCHAR) || '/' || CAST(v AS VARCHAR)), 'v': v}})), lambda e: e.v))"""


def _budget_sql(seed: int, menu: str, high: str) -> str:
    legal = f"list_filter({menu}, lambda k: k >= greatest(len(list_distinct(required)), 1) AND k < {high})"
    u = f"CAST('0x' || substr(md5('{seed}/' || CAST(id AS VARCHAR) || '/budget'), 1, 8) AS BIGINT)"
    return f"CASE WHEN len({legal}) > 0 THEN {legal}[{u} % len({legal}) + 1] END"


@register("v1_choose_views", "id:l k_views:l views:s", f"""
WITH {PLAN_SQL}, k AS (SELECT *, {_budget_sql(0, '[1, 2, 4]', 'n_views')} AS k_views FROM plan)
SELECT id, k_views, CASE WHEN k_views IS NOT NULL THEN array_to_string(list_sort(({_order_sql(0)})[1:k_views]), ',') END AS views FROM k""")
def _v1(spark, sf):
    return vw.choose_views(plans(spark, sf)).withColumn("views", csv(F.col("view_indices")))


@register("v2_nested_views", "id:l half:s quarter:s", f"""
WITH {PLAN_SQL}, o AS (SELECT id, n_views, {_order_sql(0)} AS o FROM plan WHERE n_views >= 1 AND greatest(n_views // 4, 1) >= len(required))
SELECT id, array_to_string(list_sort(o[1:greatest(n_views // 2, 1)]), ',') AS half, array_to_string(list_sort(o[1:greatest(n_views // 4, 1)]), ',') AS quarter FROM o""")
def _v2(spark, sf):
    n = F.col("n_views")
    p = plans(spark, sf).filter((n >= 1) & (F.greatest(F.floor(n / 4), F.lit(1)) >= F.size("required")))
    out = vw.nested_views(p, {"half": n / 2, "quarter": n / 4})
    return out.select("id", csv(F.col("half")).alias("half"), csv(F.col("quarter")).alias("quarter"))


_RENUM = """CASE WHEN body LIKE 'From%' THEN 'From the first image, see Frame-' || (list_position({v}, 0) - 1) || ' here.'
  WHEN body LIKE 'Compare%' THEN 'Compare Frame-' || (list_position({v}, 1) - 1) || ' with Frame-' || (list_position({v}, n_views - 1) - 1) || ' and Frame-' || (list_position({v}, 1) - 1) || '.' ELSE body END"""


@register("v3_retarget", "id:l reason:s teacher:s student:s teacher_body:s student_body:s", f"""
WITH {PLAN_SQL}, t AS (SELECT *, CASE WHEN n_views <= 4 THEN CAST(range(0, n_views) AS INTEGER[]) ELSE list_sort(({_order_sql(0)})[1:4]) END AS tv FROM plan),
k AS (SELECT *, {_budget_sql(1, '[2, 3]', 'len(tv)')} AS k_views FROM t),
s AS (SELECT *, CASE WHEN k_views IS NOT NULL THEN list_sort(({_order_sql(1, 'tv')})[1:k_views]) END AS sv FROM k)
SELECT id, CASE WHEN k_views IS NULL THEN 'no_legal_k_for_this_album' END AS reason, array_to_string(tv, ',') AS teacher,
  CASE WHEN sv IS NOT NULL THEN array_to_string(sv, ',') END AS student, {_RENUM.format(v='tv')} AS teacher_body,
  CASE WHEN sv IS NOT NULL THEN {_RENUM.format(v='sv')} END AS student_body FROM s""")
def _v3(spark, sf):
    out = vw.retarget(plans(spark, sf), 4, [2, 3])
    return out.withColumn("teacher", csv(F.col("teacher_views"))).withColumn("student", csv(F.col("student_views")))


@register("v3_retarget_stats", "source:s samples:l truncated_albums:l mean_k:d mean_teacher_views:d mean_ratio:d student_tokens_mean:d teacher_tokens_max:l", f"""
WITH {PLAN_SQL}, t AS (SELECT *, least(n_views, 6) AS t FROM plan), k AS (SELECT *, t // 2 AS k FROM t WHERE t // 2 >= greatest(len(required), 1))
SELECT source, count(*) AS samples, sum(CASE WHEN t < n_views THEN 1 ELSE 0 END) AS truncated_albums, avg(k) AS mean_k, avg(t) AS mean_teacher_views, avg(t / k) AS mean_ratio,
  avg(k) * 192 AS student_tokens_mean, max(t) * 192 AS teacher_tokens_max FROM k GROUP BY source""")
def _v3s(spark, sf):
    return vw.retarget_stats(vw.retarget(plans(spark, sf), 6, [], student="half"), ["source"])


def _far(taken: str, pool: str) -> str:
    return f"""-(list_max(list_transform({pool}, lambda v: {{'d': list_min(list_transform({taken}, lambda o: abs(v - o))), 'neg': -v}})).neg)"""


@register("v4_farthest_extras", "id:l extras:s", f"""
WITH {PLAN_SQL}, p0 AS (SELECT id, required AS t0, list_filter(CAST(range(0, n_views) AS INTEGER[]), lambda v: NOT list_contains(required, v)) AS q0 FROM plan WHERE len(required) > 0),
p1 AS (SELECT id, t0, q0, CASE WHEN len(q0) > 0 THEN {_far('t0', 'q0')} END AS e1 FROM p0),
p2 AS (SELECT *, list_append(t0, e1) AS t1, list_filter(q0, lambda v: v <> e1) AS q1 FROM p1),
p3 AS (SELECT *, CASE WHEN len(q1) > 0 THEN {_far('t1', 'q1')} END AS e2 FROM p2),
p4 AS (SELECT *, list_append(t1, e2) AS t2, list_filter(q1, lambda v: v <> e2) AS q2 FROM p3),
p5 AS (SELECT *, CASE WHEN len(q2) > 0 THEN {_far('t2', 'q2')} END AS e3 FROM p4)
SELECT id, concat_ws(',', e1, e2, e3) AS extras FROM p5""")
def _v4(spark, sf):
    p = plans(spark, sf).filter("size(required) > 0")
    pool = F.filter(vw.album(F.col("n_views")), lambda v: ~F.array_contains(F.col("required"), v))
    return p.select("id", csv(vw.farthest_extras(F.col("required"), pool, F.lit(3))).alias("extras"))


@register("v5_sweep", "sweep_id:s budget:l views:s", f"""
WITH {PLAN_SQL}, s AS (SELECT id, n_views, unnest([1, 2, 4]) AS budget FROM plan WHERE n_views > 0)
SELECT id || '@' || budget AS sweep_id, budget, array_to_string(CASE WHEN budget >= n_views THEN CAST(range(0, n_views) AS INTEGER[])
  WHEN budget = 1 THEN [0] ELSE list_transform(range(0, budget), lambda i: CAST(floor(i * (n_views - 1) / (budget - 1)) AS INTEGER)) END, ',') AS views FROM s""")
def _v5(spark, sf):
    return vw.sweep(plans(spark, sf).filter("n_views > 0"), [1, 2, 4]).withColumn("views", csv(F.col("view_indices")))


@register("v5_duplicate_groups", "sweep_group:l sweep_arm:s n:l", f"""
WITH {PLAN_SQL} SELECT id % 12000 AS sweep_group, arm AS sweep_arm, count(*) AS n FROM plan, (SELECT unnest(['full', 'key']) AS arm) WHERE n_views > 1 GROUP BY ALL HAVING count(*) > 1""")
def _v5d(spark, sf):
    p = plans(spark, sf).filter("n_views > 1").withColumn("id", F.col("id") % 12000)
    arms = vw.sweep_arms(p, {"full": vw.album(F.col("n_views")), "key": F.array(F.lit(0))})
    return vw.duplicate_groups(arms, "sweep_group", "sweep_arm")


@register("v6_repeat_rows", "o_orderkey:l repeat:l slot:l", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders)
SELECT o_orderkey, i AS repeat, row * 3 + i AS slot FROM r, range(0, 3) t(i)""")
def _v6(spark, sf):
    return vw.repeat_rows(table(spark, sf, "orders").select("o_orderkey"), 3, "o_orderkey")


@register("v6_repeat_blocked", "o_orderkey:l repeat:l slot:l", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, i AS repeat, i * n + row AS slot FROM r, range(0, 2) t(i)""")
def _v6b(spark, sf):
    return vw.repeat_rows(table(spark, sf, "orders").select("o_orderkey"), 2, "o_orderkey", interleave=False)


@register("v7_build_requests", "doc_id:l idx:l choice:s repeats:l", """
WITH c AS (SELECT o_orderkey AS doc_id, [o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR)] AS ch FROM orders WHERE o_orderkey % 4 = 1)
SELECT doc_id, i AS idx, ch[i + 1] AS choice, 2 AS repeats FROM c, range(0, 3) t(i)""")
def _v7(spark, sf):
    d = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.array("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("choices")
    )
    return vw.build_requests(d, repeats=2, rank=1, world=4)


@register("v8_fewshot_first", "doc_id:l context:s", """
SELECT p_partkey AS doc_id, (SELECT string_agg(p_name, chr(10) || chr(10) ORDER BY p_partkey) FROM (SELECT p_partkey, p_name FROM part q WHERE q.p_partkey <> p.p_partkey AND q.p_partkey <= 3 ORDER BY p_partkey LIMIT 3)) AS context FROM part p""")
def _v8(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    pool = d.select(F.col("doc_id").alias("pool_id"), F.col("p_name").alias("example"))
    return vw.fewshot(d, pool, 3)


@register("v8_fewshot_random", "doc_id:l context:s", """
WITH n AS (SELECT p_partkey AS id, p_name, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS total FROM part),
w AS (SELECT id AS doc_id, slot, (CAST('0x' || substr(md5('0/' || id), 1, 12) AS BIGINT) % total + slot) % total + 1 AS r FROM n, range(0, 4) t(slot)),
g AS (SELECT w.doc_id, p_name, slot, row_number() OVER (PARTITION BY w.doc_id ORDER BY slot) AS k FROM w JOIN n ON w.r = n.r WHERE n.id <> w.doc_id)
SELECT doc_id, string_agg(p_name, chr(10) || chr(10) ORDER BY slot) AS context FROM g WHERE k <= 3 GROUP BY doc_id""")
def _v8r(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), "p_name")
    pool = d.select(F.col("doc_id").alias("pool_id"), F.col("p_name").alias("example"))
    return vw.fewshot(d, pool, 3, how="random")


@register("w16_take_first_k", "pos:l uid:s rn:l", f"""
WITH {ROLLOUT_SQL} SELECT pos, uid, row_number() OVER (PARTITION BY uid ORDER BY pos) AS rn FROM rollouts QUALIFY rn <= 3""")
def _w16(spark, sf):
    return rk.take_first_k(rollouts(spark, sf), ["uid"], "pos", 3)


@register("w16_pick_choice", "doc:l pred:l pred_norm:l pred_mutual:l", """
WITH c AS (SELECT vec_id AS doc, i, CAST(embedding[i] AS DOUBLE) AS ll, CAST(embedding[i + 32] AS DOUBLE) AS u, 3 + i * i % 7 AS len FROM embeddings, range(1, 33) t(i))
SELECT doc, arg_min(i, ll) - 1 AS pred, arg_min(i, ll / len) - 1 AS pred_norm, arg_max(i, ll - u) - 1 AS pred_mutual FROM c GROUP BY doc""")
def _w16p(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.col("embedding").cast("array<double>")
    flat = e.select(F.col("vec_id").alias("doc"), F.posexplode(F.slice(v, 1, 32)).alias("idx", "ll"), F.slice(v, 33, 32).alias("us"))
    flat = flat.withColumn("unconditional", F.get("us", F.col("idx"))).withColumn("length", 3 + (F.col("idx") + 1) * (F.col("idx") + 1) % 7)
    return rk.pick_choice(flat, ["doc"], "idx", "ll", "length", "unconditional")


@register("w17_best_steps", "step:l score:d rank:l", f"""
WITH {ROLLOUT_SQL}, s AS (SELECT step, CASE WHEN step % 3 <> 1 THEN round(avg(score) / 5) END AS score FROM rollouts GROUP BY step),
f AS (SELECT step, last_value(score IGNORE NULLS) OVER (ORDER BY step) AS score FROM s),
r AS (SELECT step, score, row_number() OVER (ORDER BY score DESC NULLS LAST, step DESC) AS rank FROM f WHERE score IS NOT NULL)
SELECT step, score, rank FROM r WHERE rank <= 5""")
def _w17(spark, sf):
    s = rollouts(spark, sf).groupBy("step").agg(F.round(F.avg("score") / 5).alias("v"))
    return rk.best_steps(s.select("step", F.when(F.col("step") % 3 != 1, F.col("v")).alias("score")), 5)


@register("o6_top_rows", "doc_id:l n_chars:l", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def _o6(spark, sf):
    return rk.top_rows(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 25)


@register("o6_tail_rows", "source:s doc_id:l n_chars:l", """
WITH q AS (SELECT source, list_sort(list(n_chars))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS p FROM documents GROUP BY source)
SELECT d.source, doc_id, n_chars FROM documents d JOIN q ON d.source = q.source WHERE n_chars >= p""")
def _o6t(spark, sf):
    return rk.tail_rows(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", 0.95)


@register("o6_examples_per_bucket", "type:s extra:l views:l tokens:l l_orderkey:l", f"""
WITH {EVAL_SQL} SELECT type, extra, views, tokens, l_orderkey FROM (SELECT DISTINCT type, extra, views, tokens, l_orderkey FROM evals)
QUALIFY row_number() OVER (PARTITION BY type, extra ORDER BY tokens DESC, l_orderkey, views) <= 2""")
def _o6e(spark, sf):
    e = evals(spark, sf).select("type", "extra", "views", "tokens", "l_orderkey").distinct()
    return rk.top_k(e, ["type", "extra"], [F.col("tokens").desc(), F.col("l_orderkey"), F.col("views")], 2)
