"""Source and sink queries: S1-S9."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import joins as jn
from scoreloom.operators import sampling as sm
from scoreloom.operators import views as vw
from scoreloom.plans.catalog import register, table
from scoreloom.plans.fixtures import PLAN_SQL, ROLLOUT_SQL, plans, rollouts
from scoreloom.plans.sampling_queries import _budget_sql, _order_sql
from scoreloom.session import scratch_path
from scoreloom.sources import dumps, tables, training


@register("s1_read_tables", "source_no:l rows:l docs:l labels:l max_row:l", """
SELECT 0 AS source_no, count(*) AS rows, count(doc_id) AS docs, count(NULL) AS labels, count(*) - 1 AS max_row FROM documents
UNION ALL SELECT 1, count(*), count(doc_id), count(quality), count(*) - 1 FROM labels""")
def _s1(spark, sf):
    df = tables.read_tables(spark, [f"{sf}/documents.parquet", f"{sf}/labels.parquet"])
    return df.groupBy("source_no").agg(
        F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("docs"), F.count("quality").alias("labels"), F.max("row_no").alias("max_row"))


@register("s1_read_jsonl", "o_orderkey:l o_orderstatus:s", "SELECT o_orderkey, o_orderstatus FROM orders")
def _s1j(spark, sf):
    path = scratch_path(spark, "orders") + ".jsonl"
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").write.json(path)
    return tables.read_tables(spark, [path], schema="o_orderkey bigint, o_orderstatus string")


def _dump_lines(spark, sf):
    i = F.col("doc_id")
    t = F.col("text")
    j = lambda *c: F.to_json(F.struct(*c))
    sid = F.concat(F.lit("s"), i.cast("string"))
    line = (
        F.when(i % 6 == 0, j(t.alias("response"), sid.alias("sample_id")))
        .when(i % 6 == 1, j(F.lit(" ").alias("response"), t.alias("output"), F.struct(sid.alias("index")).alias("extra_info"), F.lit("zz").alias("uid")))
        .when(i % 6 == 2, j(t.alias("completion"), i.alias("index"), F.col("lang").alias("ground_truth")))
        .when(i % 6 == 3, F.lit("{broken")).when(i % 6 == 4, F.lit("  ")).otherwise(j(F.lit("").alias("text"), sid.alias("uid")))
    )
    return table(spark, sf, "documents").select("doc_id", line.alias("value"))


@register("s2_read_dump", "doc_id:l response:s sample_id:s ground_truth:s", """
SELECT doc_id, text AS response, CASE WHEN doc_id % 6 = 2 THEN CAST(doc_id AS VARCHAR) ELSE 's' || doc_id END AS sample_id, CASE WHEN doc_id % 6 = 2 THEN lang END AS ground_truth
FROM documents WHERE doc_id % 6 < 3 AND trim(text) <> ''""")
def _s2(spark, sf):
    return dumps.parse_dump_lines(_dump_lines(spark, sf))


@register("s2_read_json_dump", "response:s sample_id:s", """
SELECT text AS response, 's' || doc_id AS sample_id FROM documents WHERE trim(text) <> ''""")
def _s2j(spark, sf):
    # Documents of 500 records each: an array, or an object with the records under one key or another.
    i = F.col("doc_id")
    record = F.to_json(F.struct(F.when(i % 2 == 0, F.col("text")).alias("response"), F.when(i % 2 == 1, F.col("text")).alias("output"),
                                F.concat(F.lit("s"), i.cast("string")).alias("sample_id")))
    part = F.floor(i / 500)
    listed = table(spark, sf, "documents").groupBy(part.alias("part")).agg(F.array_join(F.collect_list(record), ",\n").alias("items"))
    head = F.when(F.col("part") % 3 == 0, "[").when(F.col("part") % 3 == 1, '{"note": {"of": ["}"]}, "samples": [').otherwise('{"data": [')
    tail = F.when(F.col("part") % 3 == 0, "]").when(F.col("part") % 3 == 1, '], "end": {"x": 1}}').otherwise("]}")
    path = scratch_path(spark, "dump") + ".json"
    listed.select("part", F.concat(head, "items", tail).alias("value")).repartition("part").write.partitionBy("part").text(path)
    return dumps.read_dump(spark, path)


@register("s2_corrupt_lines", "lines:l blank:l corrupt:l", """
SELECT count(*) AS lines, sum(CASE WHEN doc_id % 6 = 4 THEN 1 ELSE 0 END) AS blank, sum(CASE WHEN doc_id % 6 = 3 THEN 1 ELSE 0 END) AS corrupt FROM documents""")
def _s2c(spark, sf):
    return dumps.corrupt_lines(_dump_lines(spark, sf))


@register("s3_normalise_samples", "id:l question_type:s ground_truth:s response:s output_tokens:l truncated:b dialect:s", """
SELECT doc_id AS id, lang AS question_type, source AS ground_truth, text AS response, CASE WHEN doc_id % 2 = 1 THEN n_chars END AS output_tokens,
 doc_id % 2 = 1 AND n_chars > 5000 AS truncated, CASE WHEN doc_id % 2 = 0 THEN 'harness' ELSE 'inference' END AS dialect FROM documents""")
def _s3(spark, sf):
    d = table(spark, sf, "documents")
    text = F.col("text")
    even = d.filter("doc_id % 2 = 0").select(F.to_json(F.struct(
        F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("question_type"), F.col("source").alias("ground_truth")).alias("doc"),
        F.array(text, F.lit("second")).alias("filtered_resps"))).alias("value"))
    odd = d.filter("doc_id % 2 = 1").select(F.to_json(F.struct(
        F.col("doc_id").alias("id"), F.col("lang").alias("question_type"), F.col("source").alias("ground_truth"), text.alias("response"),
        F.col("n_chars").alias("output_tokens"), (F.col("n_chars") > 5000).alias("truncated"))).alias("value"))
    lines = even.unionByName(odd)
    return dumps.normalise_samples(lines.select(F.from_json("value", dumps.SAMPLE_DDL).alias("r")).select("r.*"))


def _training(spark, sf):
    # The kept plan feeds the scene ranking, the holdout and the rows: it is written once instead of being derived three times.
    p = jn.cut_lineage(spark, vw.choose_views(plans(spark, sf)).filter("k_views is not null"), "plan")
    p = sm.holdout_by_scene(p, pos="id", cap=40)
    n = F.col("n_views")
    frame = lambda v: F.struct(F.concat_ws("/", F.lit("m"), "scene", v.cast("string")).alias("src"), F.concat_ws("/", "scene", v.cast("string")).alias("cache"),
                               F.lit(False).alias("marked"), F.lit(None).cast("int").alias("frame_index"))
    p = p.withColumn("frames", F.transform(F.sequence(F.lit(0), n - 1), frame))
    for c, v in {"dataset": "orders", "subset": "all", "header_style": "frame_labels", "view_selection": "hash", "privilege_bucket": "strong"}.items():
        p = p.withColumn(c, F.lit(v))
    p = p.withColumn("teacher_views", F.lit(None).cast("array<int>")).withColumn("teacher_body", F.lit(None).cast("string"))
    p = p.withColumn("student_body", F.lit("\nWhere?")).withColumn("body", F.concat(F.lit("\n"), F.col("body")))
    return training.training_rows(p.withColumn("answer_view_sensitive", F.lit(False)), "cache")


_TRAIN_SQL = f"""
WITH {PLAN_SQL}, k AS (SELECT * FROM (SELECT *, {_budget_sql(0, '[1, 2, 4]', 'n_views')} AS k_views FROM plan) WHERE k_views IS NOT NULL),
v AS (SELECT *, list_sort(({_order_sql(0)})[1:k_views]) AS sv FROM k),
s AS (SELECT source, scene, min(id) AS f FROM k GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f) AS r, count(*) OVER (PARTITION BY source) AS n FROM s),
h AS (SELECT p.id, row_number() OVER (PARTITION BY p.source ORDER BY p.id) AS rn FROM k p JOIN o ON p.source = o.source AND p.scene = o.scene WHERE r <= greatest(n // 20, 1)),
a AS (SELECT v.*, arm, CASE WHEN h.rn <= 40 THEN 'holdout' ELSE 'train' END AS split FROM v LEFT JOIN h ON v.id = h.id, (SELECT unnest(['main', 'noprivilege']) AS arm)),
t AS (SELECT *, CASE WHEN arm = 'main' THEN n_views ELSE k_views END AS tn FROM a)
"""


@register("s4_training_rows", "arm:s split:s sample_id:s n_teacher:l k_student:l first_image:s last_teacher_image:s student_prompt:s teacher_chars:l bucket:s", _TRAIN_SQL + """
SELECT arm, split, CAST(id AS VARCHAR) AS sample_id, tn AS n_teacher, k_views AS k_student, 'cache/' || scene || '/' || sv[1] AS first_image,
 'cache/' || scene || '/' || CASE WHEN arm = 'main' THEN n_views - 1 ELSE sv[k_views] END AS last_teacher_image,
 array_to_string(list_transform(range(0, k_views), lambda i: 'Frame-' || i || ': <image>'), chr(10)) || 'Where?' AS student_prompt,
 length(array_to_string(list_transform(range(0, tn), lambda i: 'Frame-' || i || ': <image>'), chr(10))) - (tn - 1) + CASE WHEN arm = 'main' THEN length(body) ELSE 6 END AS teacher_chars,
 CASE WHEN arm = 'main' THEN 'strong' ELSE 'none' END AS bucket FROM t""".replace(
    "array_to_string(list_transform(range(0, k_views), lambda i: 'Frame-' || i || ': <image>'), chr(10)) || 'Where?' AS student_prompt",
    "array_to_string(list_transform(range(0, k_views), lambda i: 'Frame-' || i || ': <image>'), '') || 'Where?' AS student_prompt"))
def _s4(spark, sf):
    t = _training(spark, sf)
    return t.select(
        "arm", "split", "extra_info.sample_id", F.col("extra_info.n_views_teacher").alias("n_teacher"), F.col("extra_info.k_views_student").alias("k_student"),
        F.get("images", F.lit(0))["path"].alias("first_image"), F.element_at("teacher_images", -1)["path"].alias("last_teacher_image"),
        F.get("prompt", F.lit(0))["content"].alias("student_prompt"), F.length(F.get("teacher_prompt", F.lit(0))["content"]).alias("teacher_chars"),
        F.col("extra_info.privilege_bucket").alias("bucket"),
    )


@register("s4_write_training", "arm:s split:s rows:l images:l", _TRAIN_SQL + "SELECT arm, split, count(*) AS rows, sum(k_views) AS images FROM t GROUP BY arm, split")
def _s4w(spark, sf):
    out = scratch_path(spark, "training")
    training.write_training(_training(spark, sf), out)
    return spark.read.parquet(out).groupBy("arm", "split").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("images")).alias("images"))


@register("s5_dump_rollouts", "step:l rows:l score:d4", f"WITH {ROLLOUT_SQL} SELECT step, count(*) AS rows, avg(score) AS score FROM rollouts GROUP BY step")
def _s5(spark, sf):
    r = rollouts(spark, sf).select(F.col("uid").alias("input"), F.col("k").cast("string").alias("output"), "score", "step")
    out = scratch_path(spark, "dump")
    dumps.dump_rollouts(r, out)
    back = spark.read.schema("input string, output string, score double, step bigint").json(out)
    return back.groupBy("step").agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("score"))


@register("s5_dump_samples", "failure_reason:s rows:l", f"""
WITH {ROLLOUT_SQL} SELECT CASE WHEN k % 3 = 0 THEN 'correct' WHEN k % 3 = 1 THEN 'parse_error' ELSE 'factual_error' END AS failure_reason, count(*) AS rows FROM rollouts GROUP BY 1""")
def _s5s(spark, sf):
    k = F.col("k") % 3
    r = rollouts(spark, sf).select("pos", "score", F.when(k == 0, "correct").when(k == 1, "parse_error").otherwise("factual_error").alias("failure_reason"))
    out = scratch_path(spark, "samples")
    dumps.dump_samples(r, out)
    back = spark.read.schema("pos bigint, score double, failure_reason string").json(f"{out}/by_failure_reason")
    return back.groupBy("failure_reason").agg(F.count(F.lit(1)).alias("rows"))


@register("s6_build_eval_rows", "id:l data_source:s images:l prompt_chars:l options_json:s num_options:l gold:s", """
WITH f AS (SELECT l_suppkey % 50 AS scene, max(l_linenumber) AS n FROM lineitem WHERE l_suppkey % 50 <> 7 GROUP BY 1)
SELECT o_orderkey AS id, 'bench/' || o_orderstatus AS data_source, n AS images, 7 * n + length('Q of ' || o_orderpriority) + 5 AS prompt_chars,
 CASE WHEN o_orderkey % 2 = 0 THEN '["A. yes","B. no"]' ELSE '[]' END AS options_json, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS num_options, o_orderstatus AS gold
FROM orders JOIN f ON o_custkey % 50 = scene""")
def _s6(spark, sf):
    o = table(spark, sf, "orders")
    docs = o.select(
        F.col("o_orderkey").alias("id"), F.lit("d").alias("dataset"), (F.col("o_custkey") % 50).alias("scene_name"), F.col("o_orderstatus").alias("question_type"),
        F.concat(F.lit("Q of "), F.col("o_orderpriority")).alias("question"), F.col("o_orderstatus").alias("ground_truth"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("A. yes"), F.lit("B. no"))).alias("options"),
    )
    frames = table(spark, sf, "lineitem").filter("l_suppkey % 50 <> 7").groupBy((F.col("l_suppkey") % 50).alias("scene_name")).agg(F.max("l_linenumber").alias("n"))
    frames = frames.select(F.lit("d").alias("dataset"), "scene_name", F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("f"), i.cast("string"))).alias("paths"))
    e = training.build_eval_rows(docs, frames, "bench", suffix=" Box.")
    return e.select(
        "extra_info.id", "data_source", F.size("images").alias("images"), F.length(F.get("prompt", F.lit(1))["content"]).alias("prompt_chars"),
        "extra_info.options_json", "extra_info.num_options", F.col("reward_model.ground_truth").alias("gold"),
    )


@register("s7_load_mix", "dataset:s tag:s key:l", """
WITH d AS (SELECT doc_id AS key, row_number() OVER (ORDER BY md5('0/' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents),
p AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY md5('0/' || p_partkey), p_partkey) AS rn, count(*) OVER () AS n FROM part)
SELECT 'docs' AS dataset, '2d' AS tag, key FROM d WHERE rn <= floor(n * 0.6::DOUBLE) UNION ALL SELECT 'parts', '3d', key FROM p WHERE rn <= floor(n * 0.25::DOUBLE) UNION ALL SELECT 'bench', '2d', item_id FROM benchmark""")
def _s7(spark, sf):
    reg = {
        "docs": tables.MixSource(lambda s: table(s, sf, "documents").select(F.col("doc_id").alias("key"), "text"), "key", "media/docs", "2d"),
        "parts": tables.MixSource(lambda s: table(s, sf, "part").select(F.col("p_partkey").alias("key")), "key", "media/parts", "3d"),
        "bench": tables.MixSource(lambda s: table(s, sf, "benchmark").select(F.col("item_id").alias("key"), "text"), "key", "media/bench", "2d"),
    }
    return tables.load_mix(spark, "docs%60,parts%25,bench", reg).select("dataset", "tag", "key")


@register("s8_merge_shards", "id:l price:d2", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def _s8(spark, sf):
    out = scratch_path(spark, "shards")
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")).repartition(4, "id").write.json(out)
    return tables.merge_shards(spark, f"{out}/part-*.json", 4, schema="id bigint, price double")


def _media(spark, sf):
    n, i = F.col("n_views"), F.col("id")
    p = plans(spark, sf).filter("n_views > 0")
    frame = lambda v: F.struct(
        F.concat(F.lit("src/"), F.col("scene"), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), v.cast("string")))).alias("src"),
        F.concat_ws("/", F.when(i % 3 == 0, "v").when((i % 3 == 1) & (v == 0), F.concat(F.lit("m"), i.cast("string"))).otherwise("i"), "scene", v.cast("string")).alias("cache"),
        ((i % 3 == 1) & (v == 0)).alias("marked"), F.when(i % 3 == 0, v).alias("frame_index"), F.lit("aspect").alias("geometry"))
    p = p.withColumn("frames", F.transform(F.sequence(F.lit(0), n - 1), frame))
    done = table(spark, sf, "customer").select(F.concat(F.lit("i/"), (F.col("c_custkey") % 400).cast("string"), F.lit("/1")).alias("cache")).filter(F.col("c_custkey") % 3 == 0)
    return training.plan_media_jobs(p, done)


_MEDIA_SQL = f"""WITH {PLAN_SQL}, f AS (SELECT id, scene, unnest(range(0, n_views)) AS v FROM plan), done AS (SELECT DISTINCT 'i/' || (c_custkey % 400) || '/1' AS cache FROM customer WHERE c_custkey % 3 = 0)"""


@register("s9_image_jobs", "cache:s src:s", _MEDIA_SQL + """
SELECT DISTINCT 'i/' || scene || '/' || v AS cache, 'src/' || scene || '/' || v AS src FROM f WHERE id % 3 <> 0 AND NOT (id % 3 = 1 AND v = 0) AND 'i/' || scene || '/' || v NOT IN (SELECT cache FROM done)""")
def _s9(spark, sf):
    return _media(spark, sf)["image"]


@register("s9_video_jobs", "src:s frames:s", _MEDIA_SQL + """
SELECT 'src/' || scene AS src, string_agg(v || '=v/' || scene || '/' || v, ' ' ORDER BY v) AS frames FROM (SELECT DISTINCT scene, v FROM f WHERE id % 3 = 0) GROUP BY scene""")
def _s9v(spark, sf):
    w = F.map_entries("wanted")
    return _media(spark, sf)["video"].select("src", F.array_join(F.transform(w, lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), " ").alias("frames"))


@register("s9_marker_jobs", "id:l targets:l", _MEDIA_SQL + " SELECT id, count(*) AS targets FROM f WHERE id % 3 = 1 AND v = 0 GROUP BY id")
def _s9m(spark, sf):
    return _media(spark, sf)["marker"].select("id", F.size("targets").alias("targets"))


