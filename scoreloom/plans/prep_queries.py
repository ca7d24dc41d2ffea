"""Preparation queries: P1-P14, P16, P17."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.functions import geometry as geo
from scoreloom.functions import text as tx
from scoreloom.operators import prep as pp
from scoreloom.plans.catalog import register, table
from scoreloom.plans.fixtures import PLAN_SQL, csv, plans

_REASONED_SQL = f"""{PLAN_SQL}, bad AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS scene FROM customer WHERE c_custkey % 50 = 7),
x AS (SELECT p.*, len(list_distinct(required)) AS rq, b.scene IS NOT NULL AS leaked FROM plan p LEFT JOIN bad b ON p.scene = b.scene),
reasoned AS (SELECT *, CASE WHEN n_views < 2 THEN 'single_view_no_gap' WHEN question_type = 'P' THEN 'excluded_type:P'
  WHEN answer LIKE '%Frame-%' THEN 'answer_references_frame_index' WHEN answer = 'the second view' THEN 'answer_references_view_ordinal'
  WHEN len(list_filter([1, 2, 4], lambda k: k >= greatest(rq, 1) AND k < n_views)) = 0 AND rq >= n_views THEN 'zero_privilege_all_views_required'
  WHEN len(list_filter([1, 2, 4], lambda k: k >= greatest(rq, 1) AND k < n_views)) = 0 THEN 'required_views_exceed_k_budget'
  WHEN leaked THEN 'scene_leak' END AS reason FROM x)
"""


def _reasoned(spark, sf):
    bad = table(spark, sf, "customer").filter("c_custkey % 50 = 7").select(F.col("c_custkey").cast("string").alias("scene"))
    p = pp.flag_scenes(plans(spark, sf), bad)
    return pp.with_exclusion(p, pp.plan_rules([1, 2, 4], ["P"], leaked="leaked"))


@register("p1_with_exclusion", "id:l reason:s", f"WITH {_REASONED_SQL} SELECT id, reason FROM reasoned")
def _p1(spark, sf):
    return _reasoned(spark, sf)


@register("p2_exclusion_report", "dimension:s value:s reason:s n:l", f"""
WITH {_REASONED_SQL} SELECT 'source' AS dimension, source AS value, reason, count(*) AS n FROM reasoned GROUP BY source, reason
UNION ALL SELECT 'question_type', question_type, NULL, count(*) FROM reasoned WHERE reason IS NULL GROUP BY question_type
UNION ALL SELECT 'n_views', CAST(n_views AS VARCHAR), NULL, count(*) FROM reasoned WHERE reason IS NULL GROUP BY n_views""")
def _p2(spark, sf):
    return pp.exclusion_report(_reasoned(spark, sf), "source", ["source", "question_type", "n_views"])


@register("p2_view_reference_counts", "expanded:l unique_files:l", f"""
WITH {PLAN_SQL} SELECT count(*) AS expanded, count(DISTINCT scene || '/' || v) AS unique_files FROM (SELECT scene, unnest(range(0, n_views)) AS v FROM plan) x""")
def _p2v(spark, sf):
    p = plans(spark, sf).filter("n_views > 0").withColumn(
        "frames", F.transform(F.sequence(F.lit(0), F.col("n_views") - 1), lambda v: F.concat_ws("/", F.col("scene"), v.cast("string"))))
    return pp.view_reference_counts(p, "frames")


@register("p3_view_references", "id:l refs:s anchor:b", f"""
WITH {PLAN_SQL} SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(body, 'Frame-(\\d+)', 1), lambda x: CAST(x AS INTEGER)))), ',') AS refs,
 contains(lower(body), 'first image') AS anchor FROM plan""")
def _p3(spark, sf):
    return plans(spark, sf).select("id", csv(tx.frame_refs(F.col("body"))).alias("refs"), tx.needs_anchor(F.col("body")).alias("anchor"))


@register("p3_renumber_refs", "id:l frames:s images:s", f"""
WITH {PLAN_SQL}, k AS (SELECT *, list_filter(CAST(range(0, n_views) AS INTEGER[]), lambda v: v % 2 = 1 OR v = 0) AS kept FROM plan),
i AS (SELECT *, n_views - 1 AS l, list_position(kept, CAST(n_views - 1 AS INTEGER)) AS pl FROM k)
SELECT id, CASE WHEN body LIKE 'From%' THEN 'From the first image, see Frame-0 here.'
  WHEN body LIKE 'Compare%' THEN CASE WHEN pl > 0 THEN 'Compare Frame-1 with Frame-' || (pl - 1) || ' and Frame-1.' END ELSE body END AS frames,
 CASE WHEN n_views >= 2 THEN CASE WHEN pl > 0 THEN 'In image 1 and Image ' || pl || ' of 3' END ELSE 'none' END AS images FROM i""")
def _p3r(spark, sf):
    n = F.col("n_views")
    p = plans(spark, sf).withColumn("kept", F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda v: (v % 2 == 1) | (v == 0)))
    txt = F.when(n >= 2, F.concat(F.lit("In image 1 and Image "), n.cast("string"), F.lit(" of 3"))).otherwise("none")
    return p.select("id", tx.renumber_frames(F.col("body"), F.col("kept")).alias("frames"), tx.renumber_images(txt, F.col("kept")).alias("images"))


@register("p4_prompt_header", "id:l style:s prompt:s body:s", f"""
WITH {PLAN_SQL}, s AS (SELECT id, n_views, body, CASE id % 3 WHEN 0 THEN 'frame_labels' WHEN 1 THEN 'bare' ELSE 'concat' END AS style FROM plan),
h AS (SELECT *, CASE style WHEN 'frame_labels' THEN array_to_string(list_transform(range(0, n_views), lambda i: 'Frame-' || i || ': <image>'), chr(10))
  WHEN 'bare' THEN array_to_string(list_transform(range(0, n_views), lambda i: '<image>'), chr(10)) ELSE repeat('<image>', n_views) END AS h FROM s)
SELECT id, style, replace(h || chr(10) || body, '<image>' || chr(10), '<image>') AS prompt, CASE WHEN n_views > 0 THEN body END AS body FROM h""")
def _p4(spark, sf):
    i = F.col("id") % 3
    p = plans(spark, sf).withColumn("style", F.when(i == 0, "frame_labels").when(i == 1, "bare").otherwise("concat"))
    p = p.withColumn("prompt", tx.build_prompt(F.col("style"), F.col("n_views"), F.concat(F.lit("\n"), F.col("body"))))
    return p.select("id", "style", "prompt", tx.split_header(F.col("prompt"))[1].alias("body"))


_Q = ("'[Task]' || chr(10) || 'Your task is to analyze the spatial arrangement of objects in the scene by examining the provided images, "
      "which show the scene from different viewpoints.' || chr(10) || '[Question]' || chr(10)")


@register("p5_parse_question", "p_partkey:l template:s obj:s labels:s anchor:l parse_error:s rewritten:s", f"""
WITH q AS (SELECT p_partkey, p_name, p_partkey % 5 AS t, CASE WHEN p_size % 3 = 0 THEN 'From image 2, where?' ELSE 'Where is it?' END AS clause, {_Q} AS head FROM part),
x AS (SELECT *, replace(head, 'images, which show the scene from different viewpoints.', 'image, which shows the scene from one viewpoint.') AS one, clause LIKE 'From%' AS a FROM q)
SELECT p_partkey, CASE t WHEN 0 THEN 'among4' WHEN 1 THEN 'around3' WHEN 2 THEN 'pair' WHEN 3 THEN 'rotation_opposing' END AS template,
 CASE t WHEN 0 THEN p_name WHEN 4 THEN NULL ELSE '' END AS obj, CASE t WHEN 0 THEN 'front,left,back,right' WHEN 1 THEN 'front,left,right' WHEN 2 THEN '' WHEN 3 THEN 'front,back' END AS labels,
 CASE WHEN a AND t < 4 THEN 1 END AS anchor, CASE t WHEN 1 THEN NULL WHEN 4 THEN 'no template matches' END AS parse_error,
 CASE t WHEN 0 THEN CASE WHEN a THEN one || 'Based on this image (image 1) showing ' || p_name || ' from one viewpoint (left), with the camera aligned with room walls and partially capturing the surroundings: From image 1, where?'
     ELSE one || 'Based on this image (image 1) showing ' || p_name || ' from one viewpoint (left), with the camera aligned with room walls and partially capturing the surroundings: ' || clause END
   WHEN 1 THEN CASE WHEN a THEN one || 'Based on this image (image 1) showing the same scene from one viewpoint (left): From image 1, where?' ELSE one || 'Based on this image (image 1) showing the same scene from one viewpoint (left): ' || clause END
   WHEN 2 THEN head || 'Based on these two views showing the same scene: ' || clause
   WHEN 3 THEN one || 'Based on this view (back) of the same scene captured during rotation: ' || CASE WHEN a THEN 'From image 1, where?' ELSE clause END END AS rewritten FROM x""")
def _p5(spark, sf):
    t = F.col("p_partkey") % 5
    head = F.lit(f"[Task]\n{pp.TASK_MANY}\n[Question]\n")
    clause = F.when(F.col("p_size") % 3 == 0, "From image 2, where?").otherwise("Where is it?")
    prefix = (
        F.when(t == 0, F.concat(F.lit("Based on these four images (image 1, 2, 3, and 4) showing "), F.col("p_name"), F.lit(
            " from different viewpoints (front, left, back, and right), with each camera aligned with room walls and partially capturing the surroundings: ")))
        .when(t == 1, "Based on these three images (image 1, 2, and 3) showing the same scene from different viewpoints (front, left, and right): ")
        .when(t == 2, "Based on these two views showing the same scene: ")
        .when(t == 3, "Based on these two opposing views (front and back) of the same scene captured during rotation: ")
        .otherwise("Something else: ")
    )
    n = F.when(t == 0, 4).when(t == 1, 3).otherwise(2)
    df = table(spark, sf, "part").select("p_partkey", F.concat(head, prefix, clause).alias("body"), n.alias("n_views"))
    out = pp.parse_question(df).withColumn("views", F.array(F.lit(1)))
    out = pp.rewrite_question(out, name="rewritten")
    return out.withColumn("labels", F.array_join("labels", ","))


@register("p6_parse_options", "p_partkey:l question:s options:s", """
SELECT p_partkey, 'Which ' || p_brand || ' fits C. or so?' AS question, 'A=' || p_name || '|B=size ' || p_size || ' D. odd|C=' || p_type AS options FROM part""")
def _p6(spark, sf):
    text = F.concat(
        F.lit("Which "), F.col("p_brand"), F.lit(" fits C. or so? A. "), F.col("p_name"), F.lit(" B. size "),
        F.col("p_size").cast("string"), F.lit(" D. odd C. "), F.col("p_type"), F.lit(" "),
    )
    out = table(spark, sf, "part").select("p_partkey", pp.parse_options(text).alias("o"))
    flat = F.array_join(F.transform("o.options", lambda e: F.concat(e["letter"], F.lit("="), e["body"])), "|")
    return out.select("p_partkey", F.col("o.question").alias("question"), flat.alias("options"))


@register("p6_prompt_options", "p_partkey:l options:s", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'A. ' || p_name || '|B. ' || p_type || '|C. last ' || p_size END AS options FROM part""")
def _p6p(spark, sf):
    four = F.col("p_size") % 4 == 0
    text = F.when(four, F.concat(F.lit("Only one A. "), F.col("p_name"))).otherwise(F.concat(
        F.lit("Frame A) here. Pick:\nA. "), F.col("p_name"), F.lit("\nB. "), F.col("p_type"), F.lit("\nC. last "),
        F.col("p_size").cast("string"), F.lit("\nAnswer with the option's letter. B. x")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(pp.prompt_options(text), "|").alias("options"))


@register("p7_visual_tokens", "p_partkey:l aspect:s budget:s aspect_tokens:l budget_tokens:l", """
WITH s AS (SELECT p_partkey, CAST(p_size * 40 + 100 AS DOUBLE) AS w, CAST(p_partkey % 900 + 60 AS DOUBLE) AS h FROM part),
a AS (SELECT *, least(round_even(h * (518.0::DOUBLE / w) / 14, 0) * 14, 518) AS ah, greatest(32, round_even(w / 32, 0) * 32) AS wb, greatest(32, round_even(h / 32, 0) * 32) AS hb FROM s),
b AS (SELECT *, CAST(ah - ah % 32 AS INTEGER) AS fh,
  CAST(CASE WHEN wb * hb > 200000 THEN greatest(32, floor(w / sqrt(h * w / 200000) / 32) * 32) WHEN wb * hb < 60000 THEN ceil(w * sqrt(60000 / (h * w)) / 32) * 32 ELSE wb END AS INTEGER) AS bw,
  CAST(CASE WHEN wb * hb > 200000 THEN greatest(32, floor(h / sqrt(h * w / 200000) / 32) * 32) WHEN wb * hb < 60000 THEN ceil(h * sqrt(60000 / (h * w)) / 32) * 32 ELSE hb END AS INTEGER) AS bh FROM a)
SELECT p_partkey, '512x' || fh AS aspect, bw || 'x' || bh AS budget, (512 // 16) * (fh // 16) // 4 AS aspect_tokens, (bw // 16) * (bh // 16) // 4 AS budget_tokens FROM b""")
def _p7(spark, sf):
    w, h = (F.col("p_size") * 40 + 100).cast("double"), (F.col("p_partkey") % 900 + 60).cast("double")
    aw, ah = geo.aspect_size(w, h)
    bw, bh = geo.budget_size(w, h, 60000, 200000)
    x = lambda a, b: F.concat(a.cast("string"), F.lit("x"), b.cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", x(aw, ah).alias("aspect"), x(bw, bh).alias("budget"), geo.visual_tokens(aw, ah).alias("aspect_tokens"),
        geo.visual_tokens(bw, bh).alias("budget_tokens"),
    )


@register("p8_frame_indices", "doc_id:l frames:s", """
WITH t AS (SELECT doc_id, n_chars AS total, greatest(least(CAST(round_even(n_chars / 30.0::DOUBLE / 2, 0) AS INTEGER), 8), 4) AS k FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(range(0, k), lambda i: CAST(floor(CASE WHEN i = k - 1 THEN (total - 1)::DOUBLE ELSE i * ((total - 1)::DOUBLE / (k - 1)) END) AS BIGINT)))), ',') AS frames FROM t""")
def _p8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", csv(geo.frame_indices(F.col("n_chars"), F.lit(30.0))).alias("frames"))


@register("p9_answer_hint", "o_orderkey:l hint:s last:s needs_fallback:b", """
WITH a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '  ' ELSE o_orderpriority END AS gt FROM orders),
b AS (SELECT *, CASE WHEN gt IS NULL AND o_orderkey % 2 = 0 THEN 'from extra' ELSE gt END AS g FROM a), c AS (SELECT *, CASE WHEN trim(g) = '' THEN NULL ELSE g END AS h FROM b)
SELECT o_orderkey, h AS hint, 'Q ' || o_orderstatus || CASE WHEN h IS NULL THEN '' ELSE ' Hint: ' || h || '.' END AS last, h IS NULL AS needs_fallback FROM c""")
def _p9(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.array(F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content")),
                F.struct(F.lit("user").alias("role"), F.concat(F.lit("Q "), F.col("o_orderstatus")).alias("content"))).alias("prompt"),
        F.when(k % 3 == 0, None).when(k % 7 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("ground_truth"),
        F.when(k % 2 == 0, "from extra").alias("answer"), F.lit(2).alias("si"), F.lit(2).alias("ti"),
    )
    out = pp.answer_hint(df, " Hint: {answer}.", student_images="si", teacher_images="ti")
    return out.select("o_orderkey", F.col("hint_answer").alias("hint"), F.element_at("teacher_messages", -1)["content"].alias("last"), "needs_fallback")


@register("p10_strip_thinking", "doc_id:l text:s", """
SELECT doc_id, 'Start ' || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '<think>open' END || text AS text FROM documents""")
def _p10(spark, sf):
    even = F.col("doc_id") % 2 == 0
    text = F.concat(F.lit("Start "), F.when(even, F.concat(F.lit("<think>a\nb"), F.substring("text", 1, 9), F.lit("</think>  <THINK>x</THINK>\n")))
                    .otherwise("<think>open"), F.col("text"))
    docs = table(spark, sf, "documents")
    stripped = tx.strip_thinking(text)
    return docs.select("doc_id", stripped.alias("text"))


@register("p11_union_columns", "o_orderkey:l o_custkey:l status:s price:d2", """
SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice AS price FROM orders""")
def _p11(spark, sf):
    o = table(spark, sf, "orders")
    a = o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    b = o.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"))
    return pp.union_columns(a, b, "o_orderkey")


@register("p12_build_messages", "conv_id:l roles:s parts:l first_type:s text_chars:l", """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, sum(CASE WHEN turn % 2 = 0 THEN 2 ELSE 3 END) AS parts,
 CASE WHEN min(turn) % 2 = 0 THEN 'image' ELSE 'text' END AS first_type, sum(length(text)) + 4 * sum(turn % 2) AS text_chars FROM t GROUP BY conv_id""")
def _p12(spark, sf):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<image>"), F.col("text"))).otherwise(F.concat(F.col("text"), F.lit("<video>tail")))
    out = pp.build_messages(table(spark, sf, "conversations").withColumn("text", t))
    parts = F.flatten(F.transform("messages", lambda m: m["content"]))
    return out.select(
        "conv_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.size(parts).alias("parts"),
        F.get(parts, F.lit(0))["type"].alias("first_type"),
        F.aggregate(parts, F.lit(0), lambda a, p: a + F.coalesce(F.length(p["text"]), F.lit(0))).alias("text_chars"),
    )


@register("p12_turn_pairs", "conv_id:l turn:l prompt:s response:s", """
SELECT a.conv_id, a.turn, u.text AS prompt, a.text AS response FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant' AND u.role = 'user'""")
def _p12t(spark, sf):
    return pp.turn_pairs(table(spark, sf, "conversations"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@register("p13_filter_overlong", "doc_id:l", f"SELECT doc_id FROM documents WHERE doc_id % 50 <> 0 AND {_WORDS} <= 300")
def _p13(spark, sf):
    n = F.when(F.col("doc_id") % 50 != 0, pp.token_count(F.col("text")))
    return pp.filter_overlong(table(spark, sf, "documents", spread=True), 300, n)


@register("p13_length_audit", "lang:s rows:l min:l p50:l p99:l max:l over_prompt:l over_model:l", f"""
WITH w AS (SELECT lang, {_WORDS} AS n FROM documents)
SELECT lang, count(*) AS rows, min(n) AS min, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(n, 0.99)) AS BIGINT) AS p99, max(n) AS max,
 sum(CASE WHEN n > 300 THEN 1 ELSE 0 END) AS over_prompt, sum(CASE WHEN n + 50 > 400 THEN 1 ELSE 0 END) AS over_model FROM w GROUP BY lang""")
def _p13a(spark, sf):
    return pp.length_audit(table(spark, sf, "documents", spread=True), pp.token_count(F.col("text")), 300, 50, 400, ["lang"])


@register("p14_sample_length", "conv_id:l length:l signed:l", f"""
SELECT conv_id, sum({_WORDS}) + 252 * (conv_id % 4) AS length, (sum({_WORDS}) + 252 * (conv_id % 4)) * CASE WHEN conv_id % 3 = 0 THEN 1 ELSE -1 END AS signed FROM conversations GROUP BY conv_id""")
def _p14(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(pp.token_count(F.col("text"))).alias("w"))
    images, tag = F.col("conv_id") % 4, F.when(F.col("conv_id") % 3 == 0, "3d").when(F.col("conv_id") % 3 == 1, "2d")
    return c.select("conv_id", pp.sample_length(F.col("w"), images).alias("length"), pp.sample_length(F.col("w"), images, tag).alias("signed"))


@register("p16_preference_pairs", "prompt:l chosen:l rejected:l", """
WITH l AS (SELECT l_orderkey AS prompt, l_partkey * 10 + l_linenumber AS r, l_quantity AS s, l_partkey * 1000 + l_suppkey * 10 + l_linenumber AS pos FROM lineitem),
g AS (SELECT prompt, arg_max(r, struct_pack(a := s, b := -pos)) AS chosen, arg_min(r, struct_pack(a := s, b := pos)) AS rejected, max(s) AS hi, min(s) AS lo FROM l GROUP BY prompt)
SELECT prompt, chosen, rejected FROM g WHERE hi > lo""")
def _p16(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("prompt"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("r"), F.col("l_quantity").alias("s"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return pp.preference_pairs(li, "prompt", "r", "s", "pos")


_AUDIT_SQL = f"""WITH {PLAN_SQL}, f AS (SELECT id, source, (id * 7 + v) % 2000 AS k FROM (SELECT id, source, unnest(range(0, n_views)) AS v FROM plan)),
v AS (SELECT p_partkey AS k, CASE WHEN p_size % 10 = 0 THEN 500 ELSE 32 * (p_size % 20 + 2) END AS w, 32 * (p_partkey % 12 + 2) AS h FROM part WHERE p_partkey % 97 <> 1),
a AS (SELECT id, source, count(*) AS views, sum(CASE WHEN w IS NULL THEN 1 ELSE 0 END) AS missing,
 sum(CASE WHEN w IS NOT NULL AND NOT (w % 32 = 0 AND h % 32 = 0 AND w * h BETWEEN 4096 AND 16777216) THEN 1 ELSE 0 END) AS misaligned,
 sum(coalesce((w // 16) * (h // 16) // 4, 0)) AS tokens FROM f LEFT JOIN v ON f.k = v.k GROUP BY id, source)"""


def _audit(spark, sf):
    n = F.col("n_views")
    p = plans(spark, sf).filter("n_views > 0").withColumn("frames", F.transform(F.sequence(F.lit(0), n - 1), lambda v: (F.col("id") * 7 + v) % 2000))
    views = table(spark, sf, "part").filter("p_partkey % 97 <> 1").select(
        F.col("p_partkey").alias("cache"), F.when(F.col("p_size") % 10 == 0, 500).otherwise(32 * (F.col("p_size") % 20 + 2)).alias("width"),
        (32 * (F.col("p_partkey") % 12 + 2)).alias("height"),
    )
    return pp.view_audit(p, views, cap=900)


@register("p17_view_audit", "id:l views:l missing:l misaligned:l tokens:l over:b", _AUDIT_SQL + " SELECT id, views, missing, misaligned, tokens, tokens > 900 AS over FROM a")
def _p17(spark, sf):
    return _audit(spark, sf)


@register("p17_audit_summary", "source:s rows:l missing:l misaligned:l peak:l rows_over:l", _AUDIT_SQL + """
SELECT source, count(*) AS rows, sum(missing) AS missing, sum(misaligned) AS misaligned, max(tokens) AS peak, sum(CASE WHEN tokens > 900 THEN 1 ELSE 0 END) AS rows_over FROM a GROUP BY source""")
def _p17s(spark, sf):
    return pp.audit_summary(_audit(spark, sf))


@register("p17_truncation_audit", "n_views:l n:l total_len:d label_tokens:d kept_len:d kept_label:d lost_pct:d", f"""
WITH {PLAN_SQL}, t AS (SELECT n_views, n_views * 192 + id % 50 AS t, id % 17 + 1 AS l FROM plan), k AS (SELECT *, least(greatest(600 - (t - l), 0), l) AS k FROM t)
SELECT n_views, count(*) AS n, avg(t) AS total_len, avg(l) AS label_tokens, avg(least(t, 600)) AS kept_len, avg(k) AS kept_label, 100 * (1 - avg(k) / avg(l)) AS lost_pct FROM k GROUP BY n_views""")
def _p17t(spark, sf):
    return pp.truncation_audit(plans(spark, sf), ["n_views"], F.col("n_views") * 192 + F.col("id") % 50, F.col("id") % 17 + 1, 600)


@register("p9_typed_parts_hint", "o_orderkey:l parts:l last_type:s last_text:s needs_fallback:b", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS parts, 'text' AS last_type,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Q ' || o_orderstatus ELSE ' Hint: ' || o_orderpriority || '.' END AS last_text, o_orderkey % 3 = 0 AS needs_fallback FROM orders""")
def _p9t(spark, sf):
    k = F.col("o_orderkey")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    image = part("image", F.lit(None).cast("string"))
    content = F.array(image, part("text", F.concat(F.lit("Q "), F.col("o_orderstatus"))))
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        F.when(k % 3 != 0, F.col("o_orderpriority")).alias("ground_truth"), F.lit(None).cast("string").alias("answer"),
    )
    out = pp.answer_hint(df, " Hint: {answer}.")
    last = F.element_at(F.element_at("teacher_messages", -1)["content"], -1)
    return out.select(
        "o_orderkey", F.size(F.element_at("teacher_messages", -1)["content"]).alias("parts"), last["type"].alias("last_type"),
        last["text"].alias("last_text"), "needs_fallback",
    )


@register("p9_teacher_view", "o_orderkey:l images:s message:s needs_fallback:b", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 's0' ELSE 't0,t' || o_custkey END AS images,
  CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 THEN 'own' ELSE 'teacher ' || o_orderstatus END AS message, o_orderkey % 4 = 0 AS needs_fallback FROM orders""")
def _p9v(spark, sf):
    k = F.col("o_orderkey")
    message = lambda text: F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.array(F.lit("s0")).alias("images"), message(F.lit("own")).alias("prompt"),
        F.when(k % 8 == 0, F.array().cast("array<string>")).when(k % 4 != 0, F.array(F.lit("t0"), F.concat(F.lit("t"), F.col("o_custkey")))).alias("teacher_images"),
        F.when(k % 5 != 0, message(F.concat(F.lit("teacher "), F.col("o_orderstatus")))).alias("teacher_prompt"),
    )
    out = pp.teacher_view(df, "teacher_images", teacher_messages="teacher_prompt")
    return out.select("o_orderkey", F.array_join("images", ",").alias("images"), F.element_at("teacher_messages", -1)["content"].alias("message"), "needs_fallback")


@register("p15_pad_to_divisor", "o_orderkey:l slot:l padded:b", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders), m AS (SELECT *, (4096 - n % 4096) % 4096 AS missing FROM r)
SELECT o_orderkey, r AS slot, FALSE AS padded FROM m
UNION ALL SELECT o_orderkey, n + k * n + r, TRUE FROM m, range(0, 4096) t(k) WHERE r + k * n < missing""")
def _p15p(spark, sf):
    return pp.pad_to_divisor(table(spark, sf, "orders").select("o_orderkey"), 4096, "o_orderkey")


@register("p15_unpad", "o_orderkey:l", "SELECT o_orderkey FROM orders")
def _p15u(spark, sf):
    return pp.unpad(pp.pad_to_divisor(table(spark, sf, "orders").select("o_orderkey"), 4096, "o_orderkey"))
