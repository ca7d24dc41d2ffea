"""Nested training and evaluation rows, and the media job table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.operators.joins import require

ARMS = ("main", "noprivilege")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _images(root: str, frames: Column, views: Column, pixels: tuple[int, int] | None) -> Column:
    low, high = pixels or (None, None)
    return F.transform(views, lambda i: F.struct(
        F.concat(F.lit(root.rstrip("/") + "/"), F.get(frames, i)["cache"]).alias("path"),
        F.lit(low).cast("int").alias("min_pixels"), F.lit(high).cast("int").alias("max_pixels"),
    ))


def training_rows(
    plan: DataFrame, cache_root: str, arms: Sequence[str] = ARMS, system: str = "", pixels: tuple[int, int] | None = None,
    require_equal_views: bool = False,
) -> DataFrame:
    """Nested rows of both arms (S4): ``noprivilege`` shows the teacher the student's views.

    Fails on a placeholder / image count mismatch, and on N != K when equality is required. Plan columns: id, source,
    dataset, subset, scene, question_type, n_views, view_indices, teacher_views, body, student_body, teacher_body, answer,
    frames, header_style, view_selection, privilege_bucket, answer_view_sensitive, split.
    """
    unknown = set(arms) - set(ARMS)
    if unknown:
        raise ValueError(f"unknown arms: {sorted(unknown)}")
    df = plan.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    plain = F.col("arm") == "noprivilege"
    all_views = F.sequence(F.lit(0), F.col("n_views") - 1)
    student = F.col("view_indices")
    teacher = F.when(plain, student).otherwise(F.coalesce(F.col("teacher_views"), all_views))
    style = F.col("header_style")
    teacher_text = F.coalesce(F.col("teacher_body"), F.col("body"))
    # The header carries one placeholder per view, so the counts differ exactly when a body brings its own.
    df = require(df, ~F.contains(F.col("student_body"), F.lit(tx.IMAGE_TOKEN)), "student placeholder / image mismatch")
    df = require(df, plain | ~F.contains(teacher_text, F.lit(tx.IMAGE_TOKEN)), "teacher placeholder / image mismatch")
    df = df.withColumn("__t", teacher)
    if require_equal_views:
        df = require(df, F.size("__t") == F.size(student), "view counts of teacher and student differ")
    head = [_message("system", F.lit(system))] if system else []
    s_prompt = tx.build_prompt(style, F.size(student), F.col("student_body"))
    t_prompt = F.when(plain, s_prompt).otherwise(tx.build_prompt(style, F.size("__t"), teacher_text))
    sid = F.col("id").cast("string")
    return df.select(
        "arm", "split", F.col("source").alias("data_source"),
        F.array(*head, _message("user", s_prompt)).alias("prompt"),
        F.array(*head, _message("user", t_prompt)).alias("teacher_prompt"),
        _images(cache_root, F.col("frames"), student, pixels).alias("images"),
        _images(cache_root, F.col("frames"), F.col("__t"), pixels).alias("teacher_images"),
        F.lit("spatial_reasoning").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("answer").alias("ground_truth")).alias("reward_model"),
        F.struct(
            sid.alias("index"), sid.alias("sample_id"), F.col("answer").alias("answer"), F.col("source").alias("source"),
            F.col("dataset").alias("dataset"), F.col("subset").alias("subset"), F.col("scene").alias("scene_id"),
            F.coalesce(F.col("question_type"), F.lit("")).alias("question_type"), F.size("__t").alias("n_views_teacher"),
            F.size(student).alias("k_views_student"), student.alias("view_indices_student"),
            F.col("view_selection").alias("view_selection"),
            F.when(plain, "none").otherwise(F.col("privilege_bucket")).alias("privilege_bucket"),
            F.col("answer_view_sensitive").cast("boolean").alias("answer_view_sensitive"),
        ).alias("extra_info"),
    )


def write_training(rows: DataFrame, out: str) -> None:
    """One folder per arm and split."""
    rows.write.mode("overwrite").partitionBy("arm", "split").parquet(out)


def build_eval_rows(
    docs: DataFrame, frames: DataFrame, bench: str, system: str = "You are a helpful assistant.", suffix: str = "",
    pixels: tuple[int, int] | None = None,
) -> DataFrame:
    """Questions joined to the frame list of their scene (S6); a scene without frames gives no row.

    docs: id, dataset, scene_name, question_type, question, ground_truth, options. frames: dataset, scene_name, paths.
    """
    low, high = pixels or (None, None)
    rows = docs.join(frames, ["dataset", "scene_name"])
    paths = F.col("paths")
    options = F.coalesce(F.col("options"), F.array().cast("array<string>"))
    content = F.concat(F.repeat(F.lit(tx.IMAGE_TOKEN), F.size(paths)), F.col("question"), F.lit(suffix))
    return rows.select(
        F.concat_ws("/", F.lit(bench), "question_type").alias("data_source"),
        F.array(_message("system", F.lit(system)), _message("user", content)).alias("prompt"),
        F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(low).cast("int").alias("min_pixels"), F.lit(high).cast("int").alias("max_pixels"))).alias("images"),
        F.lit("spatial_reasoning").alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("ground_truth").alias("ground_truth")).alias("reward_model"),
        F.struct(
            F.col("id").alias("id"), F.col("ground_truth").alias("answer"), F.lit(bench).alias("benchmark"),
            F.col("question_type"), F.col("dataset"), F.col("scene_name"), F.to_json(options).alias("options_json"),
            F.size(options).alias("num_options"), F.lit(suffix).alias("prompt_suffix"),
        ).alias("extra_info"),
    )


def plan_media_jobs(plan: DataFrame, existing: DataFrame | None = None, pos: str = "id") -> dict[str, DataFrame]:
    """Frames still to be written, each once (S9): ``image`` jobs by cache key, ``video`` jobs by file, ``marker`` jobs by row.

    Frames are structs of src, cache, marked, frame_index, geometry. One cache key claimed by two geometries is an error. Video jobs
    list one map from frame index to cache key per (file, geometry), built after duplicates are gone.
    """
    flat = plan.select(F.col(pos).alias("__pos"), F.posexplode("frames").alias("view", "f")).select("__pos", "view", "f.*")
    if existing is not None:
        flat = flat.join(existing.select("cache").distinct(), "cache", "left_anti")
    still = flat.filter(~F.col("marked") & F.col("frame_index").isNull())
    image = still.groupBy("cache").agg(
        F.max_by("src", "__pos").alias("src"), F.max_by("geometry", "__pos").alias("geometry"),
        (F.min("geometry") != F.max("geometry")).alias("__clash"),
    )
    image = require(image, ~F.col("__clash"), "one cache key is claimed by two geometries").drop("__clash")
    moving = flat.filter(~F.col("marked") & F.col("frame_index").isNotNull())
    unique = moving.groupBy("src", "geometry", "frame_index").agg(F.max_by("cache", "__pos").alias("cache"))
    video = unique.groupBy("src", "geometry").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame_index", "cache")))).alias("wanted"))
    marker = flat.filter("marked").groupBy(F.col("__pos").alias(pos)).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("view", "cache")))).alias("targets"))
    return {"image": image, "video": video, "marker": marker}
