"""Join queries: J1-J14, U1, U2."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import scoring as sc
from scoreloom.functions.hashing import stable_hash
from scoreloom.operators import automaton as au
from scoreloom.operators import intervals as iv
from scoreloom.operators import joins as jn
from scoreloom.plans.catalog import register, table
from scoreloom.plans.fixtures import EVAL_SQL, ROLLOUT_SQL, evals, rollouts


@register("j1_attach_prompt", "doc_id:l prompt:s quality:l", """
SELECT l.doc_id, CASE WHEN l.doc_id % 3 = 0 THEN '' ELSE coalesce(d.text, '') END AS prompt, quality FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id""")
def _j1(spark, sf):
    docs = table(spark, sf, "documents").filter("doc_id % 3 <> 0").select("doc_id", F.col("text").alias("prompt"))
    return jn.attach_prompt(table(spark, sf, "labels"), docs, "doc_id")


@register("j2_strict_join", "o_orderkey:l o_custkey:l c_name:s seg:s", """
SELECT o_orderkey, o_custkey, c_name, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey""")
def _j2(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.array(F.col("o_custkey") % 7, F.col("o_custkey") % 3).alias("parts"),
        (F.col("o_custkey") % 2).alias("letter"),
    )
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.array(F.col("c_custkey") % 7, F.col("c_custkey") % 3).alias("parts"),
        "c_name", F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % 2).alias("gold_letter"),
    )
    return jn.strict_join(o, c, ["o_custkey", "parts"], agree=("letter", "gold_letter"))


_J3_SQL = """
WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, o_orderkey AS lp, o_orderstatus AS lg FROM orders),
b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS rn, o_orderkey AS rp, CASE WHEN o_orderkey % 97 = 5 THEN 'X' ELSE o_orderstatus END AS rg FROM orders WHERE o_orderkey % 1000 <> 999),
j AS (SELECT coalesce(a.rn, b.rn) AS row_number, lp, rp, lg, rg, lg IS NOT DISTINCT FROM rg AND lp IS NOT NULL AND rp IS NOT NULL AS agrees FROM a FULL JOIN b ON a.rn = b.rn)
"""


def _aligned(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("lk"), F.col("o_orderstatus").alias("lg"))
    b = a.filter("lk % 1000 <> 999").select(F.col("lk").alias("rk"), F.when(F.col("lk") % 97 == 5, "X").otherwise(F.col("lg")).alias("rg"))
    return jn.align_positional(a, b, "lk", "rk", "lg", "rg")


@register("j3_align_positional", "row_number:l left_pos:l right_pos:l agrees:b", _J3_SQL + "SELECT row_number, lp AS left_pos, rp AS right_pos, agrees FROM j")
def _j3(spark, sf):
    return _aligned(spark, sf)


@register("j3_alignment_report", "left_rows:l right_rows:l mismatched:l first_mismatch:l", _J3_SQL + """
SELECT count(lp) AS left_rows, count(rp) AS right_rows, sum(CASE WHEN agrees THEN 0 ELSE 1 END) AS mismatched, min(CASE WHEN NOT agrees THEN row_number END) AS first_mismatch FROM j""")
def _j3r(spark, sf):
    return jn.alignment_report(_aligned(spark, sf))


@register("j4_paired_arms", "user_id:l view_score:d click_score:d view_k:l click_k:l delta:d", f"""
WITH {ROLLOUT_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY user_id, data_source ORDER BY pos DESC) AS rn FROM rollouts WHERE step < 12)
SELECT v.user_id, v.score AS view_score, c.score AS click_score, v.k AS view_k, c.k AS click_k, c.score - v.score AS delta
FROM l v JOIN l c ON v.user_id = c.user_id AND v.data_source = 'view' AND c.data_source = 'click' AND v.rn = 1 AND c.rn = 1""")
def _j4(spark, sf):
    r = rollouts(spark, sf).filter("step < 12")
    return jn.paired_arms(r, "user_id", "data_source", ("view", "click"), ["score", "k"], "pos", "score")


@register("j5_replay_parity", "shared:l identical:l a_score_pct:d b_score_pct:d a_answered_pct:d b_answered_pct:d a_truncated_pct:d b_truncated_pct:d a_median_tokens:l b_median_tokens:l a_p95_tokens:l b_p95_tokens:l score_delta:d", """
WITH a AS (SELECT doc_id, text AS response, CASE WHEN n_chars % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN n_chars % 5 = 0 THEN 0 ELSE 1 END AS answered, n_chars AS tokens, CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS truncated FROM documents),
b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN response || '.' ELSE response END AS response, CASE WHEN doc_id % 9 = 0 THEN 0.5::DOUBLE ELSE score END AS score, answered, tokens + doc_id % 4 AS tokens, truncated FROM a WHERE doc_id % 2 = 0),
j AS (SELECT a.response AS ar, b.response AS br, a.score AS asc_, b.score AS bsc, a.answered AS aa, b.answered AS ba, a.truncated AS tra, b.truncated AS trb, a.tokens AS ak, b.tokens AS bk FROM a JOIN b ON a.doc_id = b.doc_id)
SELECT count(*) AS shared, sum(CASE WHEN ar = br THEN 1 ELSE 0 END) AS identical, 100 * avg(asc_) AS a_score_pct, 100 * avg(bsc) AS b_score_pct, 100 * avg(aa) AS a_answered_pct, 100 * avg(ba) AS b_answered_pct,
 100 * avg(tra) AS a_truncated_pct, 100 * avg(trb) AS b_truncated_pct,
 list_sort(list(ak))[least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) + 1] AS a_median_tokens, list_sort(list(bk))[least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) + 1] AS b_median_tokens,
 list_sort(list(ak))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS a_p95_tokens, list_sort(list(bk))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS b_p95_tokens,
 100 * avg(bsc) - 100 * avg(asc_) AS score_delta FROM j""")
def _j5(spark, sf):
    n = F.col("n_chars")
    a = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_index"), F.col("text").alias("response"), (n % 3 == 0).cast("double").alias("score"),
        (n % 5 != 0).cast("int").alias("answered"), n.alias("output_tokens"), (n > 5000).cast("int").alias("truncated"),
    )
    i = F.col("row_index")
    b = a.filter(i % 2 == 0).select(
        "row_index", F.when(i % 4 == 0, F.concat("response", F.lit("."))).otherwise(F.col("response")).alias("response"),
        F.when(i % 9 == 0, 0.5).otherwise(F.col("score")).alias("score"), "answered",
        (F.col("output_tokens") + i % 4).alias("output_tokens"), "truncated",
    )
    return jn.parity(a, b)


@register("j6_remaining_work", "doc_id:l source:s", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _j6(spark, sf):
    return jn.remaining(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "source")


@register("j7_compact_dump", "uid:s pos:l first_pos:l ok:b", """
WITH d AS (SELECT event_id AS pos, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, event_type,
   CASE WHEN event_id % 3 = 0 THEN '[API_ERROR] x' WHEN event_id % 7 = 0 THEN '  ' ELSE 'ans ' || event_id END AS answer FROM events),
u AS (SELECT *, CASE WHEN user_id IS NOT NULL THEN 'bench:uid:' || user_id || event_type ELSE 'sha1:' || sha1('{"benchmark":"bench","event_type":"' || event_type || '"}') END AS uid,
   NOT (trim(answer) = '' OR starts_with(answer, '[API_ERROR]')) AS ok FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ok DESC, pos DESC) AS rn, min(pos) OVER (PARTITION BY uid) AS first_pos FROM u)
SELECT uid, pos, first_pos, ok FROM r WHERE rn = 1""")
def _j7(spark, sf):
    i = F.col("event_id")
    d = table(spark, sf, "events").select(
        i.alias("pos"), "event_type",
        F.when(i % 10 != 0, F.concat(F.col("user_id").cast("string"), "event_type")).alias("uid"),
        F.when(i % 3 == 0, "[API_ERROR] x").when(i % 7 == 0, "  ").otherwise(F.concat(F.lit("ans "), i.cast("string"))).alias("answer"),
    )
    d = d.withColumn("uid", jn.sample_uid(d, "bench", ["event_type"]))
    out = jn.compact_dump(d, "uid", "answer", "pos")
    return out.withColumn("ok", ~jn.needs_retry(F.col("answer")))


@register("j8_leak_scan", "source:s responses:l hint_pattern:l exact_gt_copy:l copy_pct:d", """
WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 6 = 0 THEN text || ' see the Reference solution' ELSE text END AS text, text AS body,
 CASE WHEN doc_id % 5 = 0 THEN 'nowhere to be found' WHEN doc_id % 4 = 0 THEN trim(substr(text, 3, 6)) ELSE trim(substr(text, 3, 20)) END AS gold0 FROM documents),
g AS (SELECT r.doc_id, r.source, r.text, CASE WHEN l.doc_id IS NULL THEN CASE WHEN r.doc_id % 3 = 0 THEN trim(body) END
  WHEN gold0 <> '' THEN gold0 ELSE 'an earlier answer' END AS gold FROM r LEFT JOIN labels l ON r.doc_id = l.doc_id WHERE trim(r.text) <> '')
SELECT source, count(*) AS responses, sum(CASE WHEN regexp_matches(text, '(?i)reference solution') OR regexp_matches(text, '\\bHint\\b') THEN 1 ELSE 0 END) AS hint_pattern,
 sum(CASE WHEN length(gold) >= 8 AND contains(text, gold) THEN 1 ELSE 0 END) AS exact_gt_copy,
 100.0 * sum(CASE WHEN length(gold) >= 8 AND contains(text, gold) THEN 1 ELSE 0 END) / count(*) AS copy_pct FROM g GROUP BY source""")
def _j8(spark, sf):
    i = F.col("doc_id")
    docs = table(spark, sf, "documents", spread=True)
    resp = docs.select(
        i.alias("sample_id"), "source",
        F.when(i % 6 == 0, F.concat("text", F.lit(" see the Reference solution"))).otherwise(F.col("text")).alias("response"),
        F.when(i % 3 == 0, F.col("text")).alias("own_answer"),
    )
    answer = F.when(i % 5 == 0, "nowhere to be found").otherwise(F.substring("text", F.lit(3), F.when(i % 4 == 0, 6).otherwise(20)))
    # Every labelled row has an earlier gold, a padded later one, and some a blank last one.
    golds = F.array(F.lit("an earlier answer"), F.concat(F.lit("  "), answer, F.lit(" ")), F.when(i % 7 == 0, F.lit("   ")))
    gold = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        i.alias("sample_id"), F.posexplode(golds).alias("pos", "answer"),
    )
    return jn.leak_rates(jn.scan_leak(resp, gold, fallback="own_answer", min_len=8, gold_pos="pos"), ["source"])


@register("j8_contained_passages", "doc_id:l item_id:l", """
SELECT doc_id, item_id FROM documents d JOIN benchmark p ON contains(d.text, p.text)""")
def _j8c(spark, sf):
    return au.contained_passages(table(spark, sf, "documents", spread=True), table(spark, sf, "benchmark"), "doc_id", "item_id")


@register("j9_exclude_scenes", "o_orderkey:l o_custkey:l", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _j9(spark, sf):
    bad = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return jn.exclude_scenes(table(spark, sf, "orders"), bad, "o_custkey")


def _demo_sql(self_out: bool) -> str:
    own = "AND s.pos <> r.pos" if self_out else ""
    return f"""
WITH {ROLLOUT_SQL} SELECT r.pos, (SELECT arg_min(s.pos, s.pos) FROM rollouts s WHERE s.uid = r.uid AND s.score >= 80 {own}) AS demo,
  CASE WHEN r.k % 4 = 0 THEN 'fb ' || r.k END AS feedback FROM rollouts r"""


def _demo(spark, sf, self_out):
    r = rollouts(spark, sf).withColumn("response", F.col("pos").cast("string")).withColumn(
        "feedback", F.when(F.col("k") % 4 == 0, F.concat(F.lit("fb "), F.col("k").cast("string"))).otherwise(" ")
    )
    return jn.pick_demo(r, 80.0, feedback="feedback", exclude_self=self_out)


@register("j10_pick_demo", "pos:l demo:l feedback:s", _demo_sql(False))
def _j10(spark, sf):
    return _demo(spark, sf, False)


@register("j10_pick_demo_not_self", "pos:l demo:l feedback:s", _demo_sql(True))
def _j10s(spark, sf):
    return _demo(spark, sf, True)


@register("j11_interval_join", "interval_id:l event_id:l", """
WITH e AS (SELECT event_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
i AS (SELECT event_id AS interval_id, t AS s, t + 60 * (k + 1) AS e FROM e WHERE event_type = 'purchase')
SELECT interval_id, event_id FROM i JOIN e ON e.t BETWEEN i.s AND i.e WHERE event_type = 'click'""")
def _j11(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "event_type", (F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")) / 1000000.0).alias("t"), F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )
    spans = e.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("interval_id"), F.col("t").alias("s"), (F.col("t") + 60 * (F.col("k") + 1)).alias("e")
    )
    return iv.interval_join(e.filter("event_type = 'click'").select("event_id", "t"), spans, [], "t", "s", "e")


@register("j11_spans_of_any_length", "interval_id:l event_id:l user_id:l", """
WITH i AS (SELECT event_id AS interval_id, user_id, ts AS s, ts + CASE WHEN event_id % 400 = 0 THEN INTERVAL 20 DAY WHEN event_id % 20 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 1 SECOND END AS e FROM events)
SELECT interval_id, e.event_id, user_id FROM events e JOIN i USING (user_id) WHERE e.ts BETWEEN i.s AND i.e""")
def _j11l(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    day = 86_400
    seconds = F.when(F.col("event_id") % 400 == 0, 20 * day).otherwise(F.when(F.col("event_id") % 20 == 0, day).otherwise(1))
    spans = e.select(
        F.col("event_id").alias("interval_id"), "user_id", F.col("ts").alias("s"), F.timestamp_add("SECOND", seconds, F.col("ts")).alias("e"))
    return iv.interval_join(e, spans, ["user_id"], "ts", "s", "e")


@register("j11_subtitle_frames", "conv_id:l block:l start:l end_frame:l text:s", """
WITH b AS (SELECT conv_id, turn, conv_id % 3 + 0.5 AS s, turn * 2 + 3 AS d, replace(text, chr(10), ' ') AS t FROM conversations)
SELECT conv_id, rank() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS block, CAST(floor((turn * 60 + 5 + 0.25::DOUBLE) * 2) AS BIGINT) AS start,
 CAST(floor((turn * 60 + 5 + d + 0.5::DOUBLE) * 2) AS BIGINT) AS end_frame, t AS text FROM b""")
def _j11s(spark, sf):
    c = table(spark, sf, "conversations")
    turn = F.col("turn").cast("string")
    block = F.concat(
        turn, F.lit("\n00:0"), turn, F.lit(":05,250 --> 00:0"), turn, F.lit(":"), F.lpad((F.col("turn") * 2 + 8).cast("string"), 2, "0"),
        F.lit(",500\n"), F.replace("text", F.lit("\n"), F.lit(" ")),
    )
    subs = c.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda e: e["b"]), "\n\n").alias("subs"))
    out = jn.parse_subtitles(subs.withColumn("fps", F.lit(2.0)), "conv_id", "subs", "fps")
    return out.withColumnRenamed("end", "end_frame")


def _boxes(spark, sf):
    li = table(spark, sf, "lineitem", spread=True).select(
        F.floor(F.col("l_orderkey") / 8).alias("image"), F.col("l_returnflag").alias("label"),
        F.unhex(stable_hash("l_orderkey", "l_partkey", "l_linenumber")).alias("h"),
        F.array(
            (F.col("l_quantity") % 10).cast("double"), (F.col("l_suppkey") % 3).cast("double"), F.lit(0.0),
            3.0 + F.col("l_discount") * 20, 3.0 + F.col("l_tax") * 20, F.lit(2.0),
        ).alias("bbox"), "l_linestatus",
    )
    from pyspark.sql import Window

    # Dealt by the keys of the matching, so that numbering, comparison and crowd counts share one shuffle of the boxes.
    w = Window.partitionBy("image", "label", "l_linestatus").orderBy("h")
    return li.repartition("image", "label").withColumn("pos", F.row_number().over(w)).drop("h")


@register("j12_match_boxes", "image:l label:s tp:l fp:l fn:l", """
WITH RECURSIVE b AS (SELECT l_orderkey // 8 AS image, l_returnflag AS label, l_linestatus AS side, CAST(l_quantity AS BIGINT) % 10::DOUBLE AS x, (l_suppkey % 3)::DOUBLE AS y,
  3.0::DOUBLE + CAST(l_discount AS DOUBLE) * 20 AS dx, 3.0::DOUBLE + CAST(l_tax AS DOUBLE) * 20 AS dy, 2.0::DOUBLE AS dz,
  row_number() OVER (PARTITION BY l_orderkey // 8, l_returnflag, l_linestatus ORDER BY md5('0/' || l_orderkey || '/' || l_partkey || '/' || l_linenumber)) AS pos FROM lineitem),
o AS (SELECT p.image, p.label, p.pos AS p, g.pos AS g, greatest(least(p.x + p.dx / 2, g.x + g.dx / 2) - greatest(p.x - p.dx / 2, g.x - g.dx / 2), 0::DOUBLE)
   * greatest(least(p.y + p.dy / 2, g.y + g.dy / 2) - greatest(p.y - p.dy / 2, g.y - g.dy / 2), 0::DOUBLE) * 2.0::DOUBLE AS inter,
  p.dx * p.dy * p.dz AS vp, g.dx * g.dy * g.dz AS vg FROM b p JOIN b g ON p.image = g.image AND p.label = g.label WHERE p.side = 'F' AND g.side = 'O'),
e AS (SELECT *, inter / (vp + vg - inter) AS iou FROM o WHERE inter / (vp + vg - inter) > 0.25),
c AS (SELECT image, label, p, list(g ORDER BY iou DESC, g) AS gs, row_number() OVER (PARTITION BY image, label ORDER BY p) AS i FROM e GROUP BY image, label, p),
f AS (SELECT DISTINCT image, label, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used FROM c
  UNION ALL SELECT f.image, f.label, f.i + 1, list_concat(f.used, list_filter(c.gs, lambda v: NOT list_contains(f.used, v))[1:1]) FROM f JOIN c ON c.image = f.image AND c.label = f.label AND c.i = f.i + 1),
t AS (SELECT image, label, max(len(used)) AS tp FROM f GROUP BY image, label),
n AS (SELECT image, label, sum(CASE WHEN side = 'F' THEN 1 ELSE 0 END) AS np, sum(CASE WHEN side = 'O' THEN 1 ELSE 0 END) AS ng FROM b GROUP BY image, label)
SELECT n.image, n.label, coalesce(tp, 0) AS tp, np - coalesce(tp, 0) AS fp, ng - coalesce(tp, 0) AS fn FROM n LEFT JOIN t ON n.image = t.image AND n.label = t.label""")
def _j12(spark, sf):
    b = _boxes(spark, sf)
    pred, gold = b.filter("l_linestatus = 'F'"), b.filter("l_linestatus = 'O'")
    return jn.match_counts(jn.match_boxes(pred, gold), pred, gold)


@register("j13_judge_queue", "kind:s n:l", f"""
WITH {EVAL_SQL} SELECT CASE WHEN views % 2 = 0 THEN 'mca' ELSE 'na' END AS kind, count(*) AS n FROM evals
WHERE CASE WHEN views % 2 = 0 THEN score < 1 ELSE answered = 0 END GROUP BY 1""")
def _j13q(spark, sf):
    e = evals(spark, sf).select(F.when(F.col("views") % 2 == 0, "mca").otherwise("na").alias("kind"),
                                F.col("answered").alias("rule_answered"), F.col("score").alias("rule_score"))
    return jn.judge_queue(e, scope="rule_wrong").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register("j13_merge_judge", "pos:l final_score:d final_answered:b judge_source:s judge_recovered:b", f"""
WITH {ROLLOUT_SQL}, d AS (SELECT pos, CASE WHEN k % 2 = 0 THEN 'mca' ELSE 'na' END AS kind, length % 3 <> 0 AS ra, CASE WHEN length % 3 = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rs, score AS gold, k FROM rollouts),
m AS (SELECT pos, kind, ra, rs, k % 5 <> 4 AS has, CASE k % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'UNPARSED' END AS verdict, CASE WHEN k % 7 = 0 THEN NULL ELSE gold + k % 4 END AS num, gold FROM d),
x AS (SELECT *, NOT ra AND has AS asked FROM m),
y AS (SELECT *, asked AND CASE WHEN kind = 'mca' THEN verdict <> 'UNPARSED' ELSE num IS NOT NULL END AS usable,
  CASE WHEN kind = 'mca' THEN CASE WHEN verdict = 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE
    len(list_filter([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.8999999999999999, 0.95]::DOUBLE[], lambda th: abs(num - gold) / abs(gold) <= 1 - th)) / 10.0::DOUBLE END AS new FROM x)
SELECT pos, CASE WHEN usable THEN new ELSE rs END AS final_score, usable OR ra AS final_answered,
  CASE WHEN NOT asked THEN 'rule' WHEN NOT usable AND kind = 'mca' THEN 'judge_unparsed' WHEN NOT usable THEN 'judge_no_number' WHEN kind = 'mca' THEN 'judge_verdict' ELSE 'judge_extract' END AS judge_source,
  rs < 1 AND (CASE WHEN usable THEN new ELSE rs END) >= 1 AS judge_recovered FROM y""")
def _j13(spark, sf):
    k = F.col("k")
    d = rollouts(spark, sf).select(
        F.col("pos").alias("row_index"), F.when(k % 2 == 0, "mca").otherwise("na").alias("kind"),
        (F.col("length") % 3 != 0).alias("rule_answered"), (F.col("length") % 3 == 1).cast("double").alias("rule_score"),
        F.col("score").alias("gold"), "k",
    )
    replies = d.filter(k % 5 != 4).select(
        "row_index", F.lit(1).alias("reply_pos"),
        F.when(k % 3 == 0, "Yes").when(k % 3 == 1, "No").otherwise("UNPARSED").alias("verdict"),
        F.when(k % 7 != 0, F.col("gold") + k % 4).alias("number"),
    )
    out = jn.merge_judge(d, replies, sc.relative_accuracy(F.col("number"), F.col("gold")))
    return out.withColumnRenamed("row_index", "pos")


@register("j14_compare_rules", "type:s n:l fallback_acc:d strict_acc:d fallback_answered:d strict_answered:d delta:d recovered_fraction:d", f"""
WITH {EVAL_SQL}, j AS (SELECT type, score AS rs, answered AS ra, CASE WHEN extra = 1 THEN 1.0::DOUBLE WHEN extra = 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS js, CASE WHEN extra IN (1, 2, 3) THEN 1 ELSE 0 END AS ja FROM evals),
t AS (SELECT type, count(*) AS n, 100 * avg(CASE WHEN ra = 1 THEN rs ELSE js END) AS fa, 100 * avg(CASE WHEN ra = 1 THEN rs ELSE 0 END) AS sa,
  100 * avg(CASE WHEN ra = 1 THEN 1 ELSE ja END) AS fan, 100 * avg(ra) AS san, sum(1 - ra) AS un, sum(CASE WHEN ra = 0 AND js > 0 THEN 1 ELSE 0 END) AS rec FROM j GROUP BY type),
a AS (SELECT * FROM t UNION ALL SELECT 'overall', sum(n), avg(fa), avg(sa), sum(fan * n) / sum(n), sum(san * n) / sum(n), sum(un), sum(rec) FROM t)
SELECT type, n, fa AS fallback_acc, sa AS strict_acc, fan AS fallback_answered, san AS strict_answered, fa - sa AS delta, rec / un AS recovered_fraction FROM a""")
def _j14(spark, sf):
    x = F.col("extra")
    e = evals(spark, sf).select(
        "type", F.col("score").alias("rule_score"), F.col("answered").alias("rule_answered"),
        F.when(x == 1, 1.0).when(x == 2, 0.3).otherwise(0.0).alias("judge_score"), x.isin(1, 2, 3).cast("int").alias("judge_answered"),
    )
    return jn.compare_rules(e)


@register("u1_union_all", "doc_id:l quality:l source:s", """
SELECT doc_id, NULL AS quality, source FROM documents UNION ALL SELECT doc_id, quality, NULL FROM labels""")
def _u1(spark, sf):
    return jn.union_all(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels").select("doc_id", "quality"))


@register("u1_except_ids", "o_orderkey:l", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _u1e(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return jn.except_ids(table(spark, sf, "orders"), li, "o_orderkey")


@register("u1_id_set_diff", "left_ids:l right_ids:l only_left:l only_right:l", """
WITH a AS (SELECT DISTINCT o_orderkey AS i FROM orders), b AS (SELECT DISTINCT l_orderkey + 2 AS i FROM lineitem)
SELECT (SELECT count(*) FROM a) AS left_ids, (SELECT count(*) FROM b) AS right_ids, (SELECT count(*) FROM a WHERE i NOT IN (SELECT i FROM b)) AS only_left,
 (SELECT count(*) FROM b WHERE i NOT IN (SELECT i FROM a)) AS only_right""")
def _u1d(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"))
    return jn.id_set_diff(a, table(spark, sf, "lineitem").select((F.col("l_orderkey") + 2).alias("i")), "i")


@register("u2_split_rows", "chunk:l n:l first:l last:l", """
WITH r AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 777 AS chunk FROM events)
SELECT chunk, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY chunk""")
def _u2(spark, sf):
    out = jn.split_rows(table(spark, sf, "events").select("event_id"), "event_id", size=777)
    return out.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@register("u2_equal_chunks", "chunk:l n:l first:l last:l", """
WITH r AS (SELECT event_id, ntile(5) OVER (ORDER BY event_id) - 1 AS chunk FROM events)
SELECT chunk, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY chunk""")
def _u2c(spark, sf):
    out = jn.split_rows(table(spark, sf, "events").select("event_id"), "event_id", chunks=5)
    return out.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@register("u2_slice_rows", "o_orderkey:l row:l", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders)
SELECT o_orderkey, row FROM r WHERE row >= 100 AND row < 12000 AND (row - 100) % 7 = 0""")
def _u2s(spark, sf):
    return jn.slice_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100, 12000, 7)


@register("u2_select_rows", "slot:l o_orderkey:l", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM orders)
SELECT event_id AS slot, o_orderkey FROM events JOIN r ON row = (user_id * 31 + event_id) % 1000""")
def _u2x(spark, sf):
    picks = table(spark, sf, "events").select(((F.col("user_id") * 31 + F.col("event_id")) % 1000).alias("index"), F.col("event_id").alias("slot"))
    return jn.select_rows(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", picks, order="slot")
