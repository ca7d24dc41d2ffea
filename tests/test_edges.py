"""Edge rows and refusals."""

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import scoring as sc
from scoreloom.functions import text as tx
from scoreloom.operators import advantage as adv
from scoreloom.operators import automaton as au
from scoreloom.operators import joins as jn
from scoreloom.operators import metrics as mt
from scoreloom.operators import packing as pk
from scoreloom.operators import prep as pp
from scoreloom.operators import rollout as ro
from scoreloom.operators import views as vw
from scoreloom.sources import dumps, tables, training
from scoreloom.streaming import rollouts as st


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text,options,want", [
    ("B", None, "B"),
    ("x\n(c)", None, "C"),
    ("A. right", ["A. right", "B. left"], "A"),
    ("A. left", ["A. right", "B. left"], None),
    ("the lamp is left", ["A. right", "B. left"], "B"),
    ("I choose b\nImage 178: Kitchen.", ["A. x", "B. y"], "B"),
    ("The answer is E", ["A. x", "B. y"], None),
    ("<think>C</think>", None, None),
    ("just a guess", None, None),
    ("", None, None),
])
def test_option_lastline(spark, text, options, want):
    opts = None if options is None else F.array(*[F.lit(o) for o in options])
    assert one(spark, sc.option_lastline(F.lit(text), opts)) == want


@pytest.mark.parametrize("text,want", [
    ("about 2,500 cm", 2500.0), ("see Frame-4", None), ("1, 2, 3, 4, 5", None), ("10^2 and 7", 7.0), ("Image 3: 9", None),
    ("the answer is 1.5\nImage 4: sofa", 1.5), ("v1.2.3", None), ("-3", -3.0),
])
def test_number_lastline(spark, text, want):
    assert one(spark, sc.number_lastline(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [
    (r"\boxed{1/2}", "0.5"), (r"\boxed{\frac{3}{4}}", "0.75"), (r"\boxed{\text{left}}", "left"), (r"\boxed{4 \, m}", "4   m"), (r"\boxed{3", None),
    (r"\boxed{8/2}", "4"), ("none", None),
])
def test_boxed(spark, text, want):
    assert one(spark, sc.normalise_boxed(sc.boxed(F.lit(text)))) == want


@pytest.mark.parametrize("pred,gold,want", [(1.1, 1.0, 0.8), (9.0, 10.0, 0.8), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (10.0, 10.0, 1.0), (4.0, 10.0, 0.0)])
def test_relative_accuracy(spark, pred, gold, want):
    ths = sc.MRA_THRESHOLDS
    exact = float(pred == 0) if gold == 0 else sum(abs(pred - gold) / abs(gold) <= 1 - t for t in ths) / 10
    got = one(spark, sc.relative_accuracy(F.lit(pred), F.lit(gold)))
    assert got == pytest.approx(exact) and abs(got - want) <= 0.1001


def test_unanswered_is_not_wrong(spark):
    rows = [("mixed/x", "no letter", "A", "mca"), ("mixed/x", "B", "A", "mca"), ("mixed/x", "A", "A", "mca"), ("mixed/x", "", "A", "mca")]
    df = spark.createDataFrame(rows, "data_source string, response string, gold string, kind string")
    got = [(r["score"], r["answered"]) for r in sc.score_rows(df, {"mixed/": "mixed"}, kind="kind").collect()]
    assert got == [(0.0, 0), (0.0, 1), (1.0, 1), (0.0, 0)]


def test_unknown_kind_fails(spark):
    df = spark.createDataFrame([("mixed/x", "A", "A", "odd")], "data_source string, response string, gold string, kind string")
    with pytest.raises(Exception, match="unknown question kind"):
        sc.score_rows(df, {"mixed/": "mixed"}, kind="kind").collect()


def test_singletons(spark):
    df = spark.createDataFrame([(0, "a", 2.0, 3)], "pos long, uid string, score double, length long")
    get = lambda name, **o: adv.estimate(df, name, **o).first()["advantage"]
    assert get("grpo") == pytest.approx(2.0 / (1 + 1e-6))
    assert get("rloo") == 2.0 and get("rloo_vectorized") == 0.0 and get("opo") == 2.0
    with pytest.raises(Exception, match="at least two responses"):
        adv.estimate(df, "grpo_passk").collect()
    with pytest.raises(ValueError):
        adv.estimate(df, "nothing")


def test_registry_rejects_a_second_meaning():
    import scoreloom.operators.corpus  # noqa: F401

    with pytest.raises(ValueError):
        adv.register_estimator("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        mt.register_metric("bleu")(lambda df: df)


def test_strict_join_gates(spark):
    a = spark.createDataFrame([(1, "x")], "k int, l string")
    ok = spark.createDataFrame([(1, "x")], "k int, r string")
    assert jn.strict_join(a, ok, ["k"], agree=("l", "r")).count() == 1
    with pytest.raises(Exception, match="not unique"):
        jn.strict_join(a, ok.unionAll(ok), ["k"]).collect()
    with pytest.raises(Exception, match="no row matches"):
        jn.strict_join(a, ok.filter("k > 5"), ["k"]).collect()
    with pytest.raises(Exception, match="disagree"):
        jn.strict_join(a, spark.createDataFrame([(1, "y")], "k int, r string"), ["k"], agree=("l", "r")).collect()


def test_compaction_keeps_success(spark):
    rows = [("u", 0, "good"), ("u", 1, "[API_ERROR]"), ("v", 2, ""), ("v", 3, "[API_ERROR] b"), ("w", 4, "one"), ("w", 5, "two")]
    df = spark.createDataFrame(rows, "uid string, pos int, answer string")
    got = {r["uid"]: (r["answer"], r["first_pos"]) for r in jn.compact_dump(df, "uid", "answer", "pos").collect()}
    assert got == {"u": ("good", 0), "v": ("[API_ERROR] b", 2), "w": ("two", 4)}


def test_union_columns_refuses_differences(spark):
    a = spark.createDataFrame([(1, "x")], "id int, c string")
    with pytest.raises(Exception, match="differs"):
        pp.union_columns(a, spark.createDataFrame([(1, "y")], "id int, c string"), "id").collect()


def test_dangling_reference_is_null(spark):
    text, kept = F.lit("see Frame-3 and Frame-1"), F.array(F.lit(1), F.lit(2))
    assert one(spark, tx.renumber_frames(text, kept)) is None
    assert one(spark, tx.renumber_frames(F.lit("see Frame-2 and Frame-1, Frame-2"), kept)) == "see Frame-1 and Frame-0, Frame-1"


def test_formats_and_mix(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_tables(spark, [str(tmp_path / "a.csv")])
    with pytest.raises(ValueError, match="unknown dataset"):
        tables.load_mix(spark, "nothing%50", {})
    assert tables.parse_mix("a%60, b") == [("a", 0.6), ("b", 1.0)]


def test_read_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"samples": [{"output": "yes", "index": "7"}, {"text": " "}]}')
    (tmp_path / "e.json").write_text('[{"pred": "p", "extra_info": {"sample_id": "s"}}]')
    got = [tuple(r) for r in dumps.read_dump(spark, str(tmp_path / "d.json")).collect() + dumps.read_dump(spark, str(tmp_path / "e.json")).collect()]
    assert got == [("yes", "7", None), ("p", "s", None)]


def test_shard_checks(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    df.repartition(2).write.json(str(tmp_path / "s"))
    glob = str(tmp_path / "s" / "part-*.json")
    assert [r["id"] for r in tables.merge_shards(spark, glob, 2, schema="id bigint, v bigint").collect()] == list(range(10))
    with pytest.raises(ValueError, match="expected 3 shards"):
        tables.merge_shards(spark, glob, 3, schema="id bigint, v bigint")
    df.coalesce(1).write.json(str(tmp_path / "t"))
    df.coalesce(1).write.mode("append").json(str(tmp_path / "t"))
    with pytest.raises(Exception, match="duplicate ids"):
        tables.merge_shards(spark, str(tmp_path / "t" / "part-*.json"), 2, schema="id bigint, v bigint").collect()


def test_geometry_conflict_fails(spark):
    ddl = "id int, frames array<struct<src:string,cache:string,marked:boolean,frame_index:int,geometry:string>>"
    df = spark.createDataFrame([(1, [("a", "c", False, None, "x")]), (2, [("a", "c", False, None, "y")])], ddl)
    with pytest.raises(Exception, match="two geometries"):
        training.plan_media_jobs(df)["image"].collect()


def test_rejection_thresholds():
    assert ro.parse_rs_thresholds(["token_k1", "seq_max_k2"], "0.5_2, 3") == {"token_k1": (0.5, 2.0), "seq_max_k2": (None, 3.0)}
    assert ro.parse_rs_thresholds(["token_k1"], 2.0) == {"token_k1": (0.5, 2.0)}
    for spec in ("1,2,3", "-1"):
        with pytest.raises(ValueError):
            ro.parse_rs_thresholds(["token_k1", "token_k2"], spec)


def test_mixed_metric_kinds_fail(spark):
    df = spark.createDataFrame([("a", 1.0, "sum"), ("a", 2.0, "mean")], "name string, value double, kind string")
    with pytest.raises(Exception, match="mixed aggregation"):
        mt.reduce_metrics(df, kind="kind").collect()


def test_weighted_average_rule(spark):
    df = spark.createDataFrame([("m", 1, 1.0, 1.0, "weighted_avg"), ("m", 2, 4.0, 2.0, "weighted_avg")], "name string, step int, value double, n double, rule string")
    assert mt.aggregate_steps(df, rule="rule", samples="n").first()["value"] == pytest.approx(3.0)


def test_judge_never_reopens(spark):
    rows = [(1, "mca", True, 1.0, "No", None), (2, "mca", False, 0.0, "Yes", None), (3, "na", False, 0.0, "NONE", None)]
    df = spark.createDataFrame([r[:4] for r in rows], "row_index int, kind string, rule_answered boolean, rule_score double")
    rep = spark.createDataFrame([(r[0], 0, r[4], r[5]) for r in rows], "row_index int, reply_pos int, verdict string, number double")
    got = {r["row_index"]: (r["final_score"], r["judge_source"]) for r in jn.merge_judge(df, rep, F.col("number")).collect()}
    assert got == {1: (1.0, "rule"), 2: (1.0, "judge_verdict"), 3: (0.0, "judge_no_number")}


def _plan_row(spark, student_body):
    return spark.sql(f"""SELECT 1 AS id, 's' AS source, 'd' AS dataset, 'x' AS subset, 'sc' AS scene, 'q' AS question_type, 3 AS n_views,
        array(0, 2) AS view_indices, cast(null AS array<int>) AS teacher_views, '\\nWhere?' AS body, '{student_body}' AS student_body,
        cast(null AS string) AS teacher_body, 'left' AS answer, 'bare' AS header_style, 'hash' AS view_selection, 'weak' AS privilege_bucket,
        false AS answer_view_sensitive, 'train' AS split,
        transform(sequence(0, 2), v -> named_struct('cache', concat('c', v))) AS frames""")


def test_training_rows_of_both_arms(spark):
    rows = {r["arm"]: r for r in training.training_rows(_plan_row(spark, "\\nHere?"), "root", system="be brief", pixels=(1, 9)).collect()}
    main, plain = rows["main"], rows["noprivilege"]
    assert main["prompt"][1]["content"] == "<image><image>Here?" and main["prompt"][0]["role"] == "system"
    assert main["teacher_prompt"][1]["content"] == "<image><image><image>Where?"
    assert plain["teacher_prompt"] == plain["prompt"] and plain["extra_info"]["privilege_bucket"] == "none"
    assert [i["path"] for i in main["images"]] == ["root/c0", "root/c2"] and main["images"][0]["max_pixels"] == 9
    assert len(main["teacher_images"]) == 3 and len(plain["teacher_images"]) == 2


def test_training_rows_refuse_mismatches(spark):
    with pytest.raises(Exception, match="student placeholder"):
        training.training_rows(_plan_row(spark, "see <image>"), "root").collect()
    with pytest.raises(Exception, match="view counts"):
        training.training_rows(_plan_row(spark, "x"), "root", require_equal_views=True).collect()


def test_micro_batches_refuse_oversize_rows(spark):
    df = spark.createDataFrame([(i, 40) for i in range(6)] + [(6, 500)], "pos long, length long")
    with pytest.raises(Exception, match="longer than a micro-batch"):
        pk.micro_batches(df, 100).collect()
    with pytest.raises(Exception, match="more micro-batches than rows"):
        pk.micro_batches(df.filter("pos < 2"), 100, at_least=5).collect()


def test_fewshot_of_a_small_pool_repeats_nothing(spark):
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    pool = spark.createDataFrame([(1, "e1"), (2, "e2")], "pool_id long, example string")
    got = {r["doc_id"]: sorted(r["context"].split("|")) for r in vw.fewshot(docs, pool, 3, how="random", sep="|").collect()}
    assert got == {0: ["e1", "e2"], 1: ["e2"], 2: ["e1"], 3: ["e1", "e2"], 4: ["e1", "e2"]}


def test_replay_keeps_null_keys(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else i, f"r{i}") for i in range(100)], "pos long, name string")
    path = st.replay_files(df, "pos", 4)
    assert sorted(r["name"] for r in spark.read.parquet(path).collect()) == sorted(f"r{i}" for i in range(100))


def test_leak_scan_golds(spark):
    resp = spark.createDataFrame([(1, "the answer is forty two"), (2, "copied whole phrase here"), (3, "own fallback text")], "sample_id long, response string").withColumn(
        "own", F.when(F.col("sample_id") != 1, F.col("response")))
    gold = spark.createDataFrame(
        [(1, 0, "zzz never"), (1, 1, "  forty two "), (1, 2, "   "), (2, 0, "  ")], "sample_id long, pos long, answer string")
    got = {r["sample_id"]: r["exact_gt_copy"] for r in jn.scan_leak(resp, gold, fallback="own", gold_pos="pos").collect()}
    assert got == {1: True, 2: True, 3: True}


def test_box_matching_fails_when_unsettled(spark):
    boxes = [("i", "l", k, [k * 0.1, 0.0, 0.0, 2.0, 2.0, 2.0]) for k in range(6)]
    df = spark.createDataFrame(boxes, "image string, label string, pos long, bbox array<double>")
    with pytest.raises(RuntimeError, match="not settled"):
        jn.match_boxes(df, df, max_rounds=1)


def test_short_passages(spark):
    docs = spark.createDataFrame([(1, "a bc def"), (2, "xyz"), (3, "")], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "c"), (2, "bc d"), (3, "xyz"), (4, ""), (5, "q")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in au.contained_passages(docs, passages, "doc_id", "item_id").collect())
    assert got == [(1, 1), (1, 2), (2, 3)]


def test_ranks_of_any_key_distribution(spark):
    from scoreloom.operators.groups import order_statistics, ranked, value_buckets

    rows = [(h,) for h in ([hash((i, "x")) % (1 << 62) - (1 << 61) for i in range(500)] + [0, 1, -1, 5, 5, None])]
    for kind, scale in (("long", None), ("double", 1 << 62)):
        values = [(v if scale is None or v is None else v / scale,) for (v,) in rows]
        df = spark.createDataFrame(values, f"v {kind}").withColumn("one", F.lit(1))
        got = ranked(df, ["one"], [F.col("v")], value_buckets(F.col("v")), "rn").collect()
        want = {}
        for n, v in enumerate(sorted((x for (x,) in values), key=lambda x: (x is not None, x or 0)), 1):
            want.setdefault(v, set()).add(n)
        assert all(r["rn"] in want[r["v"]] for r in got) and len({r["rn"] for r in got}) == 506
        stats = order_statistics(df, [], "v", {"mid": F.floor(F.col("n") / 2)}).first()
        assert stats["mid"] == sorted(x for (x,) in values if x is not None)[505 // 2]


def test_light_weights_draw_as_many_rows(spark):
    """Weights with more decimals than sums used to keep: every draw meets one row, light as the rows are."""
    from scoreloom.operators import sampling

    rows = spark.createDataFrame([(i, 1.3e-11 * (1 + i % 7)) for i in range(500)], "pos long, weight double")
    drawn = [r["draw"] for r in sampling.resample_weighted(rows, "pos").collect()]
    assert sorted(drawn) == list(range(500))
