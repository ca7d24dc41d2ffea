"""View choice per plan row (survey rows V1-V8). Albums are short arrays, so everything stays inside the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import geometry as geo
from scoreloom.functions import text as tx
from scoreloom.functions.hashing import hash_int, stable_hash
from scoreloom.operators.joins import pos_bucket, require
from scoreloom.operators.groups import ranked



def album(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def view_order(row_id: Column, views: Column, required: Column, seed: int = 0) -> Column:
    """One order per row: required views in ascending order, then the others by hash."""
    free = F.filter(views, lambda v: ~F.array_contains(required, v))
    keyed = F.array_sort(F.transform(free, lambda v: F.struct(stable_hash(row_id, v, seed=seed).alias("h"), v.alias("v"))))
    return F.concat(F.array_sort(F.array_distinct(required)), F.transform(keyed, lambda e: e["v"]))


def prefix_views(order: Column, k: Column) -> Column:
    return F.array_sort(F.slice(order, F.lit(1), k.cast("int")))


def pick_budget(row_id: Column, menu: Sequence[int], low: Column, high: Column, seed: int = 0) -> Column:
    """One legal budget (``low <= k < high``), chosen evenly by hash; null when none is legal."""
    legal = F.filter(F.array(*[F.lit(k) for k in menu]), lambda k: (k >= low) & (k < high))
    u = F.conv(F.substring(stable_hash(row_id, F.lit("budget"), seed=seed), 1, 8), 16, 10).cast("bigint")
    return F.when(F.size(legal) > 0, F.get(legal, F.pmod(u, F.size(legal)).cast("int")))


def choose_views(
    df: DataFrame, menu: Sequence[int] = (1, 2, 4), row_id: str = "id", n_views: str = "n_views", required: str = "required",
    seed: int = 0,
) -> DataFrame:
    """A random legal budget below the album size, required views always in (V1); null views when no budget is legal."""
    req = F.array_distinct(F.col(required))
    bad = F.exists(req, lambda v: (v < 0) | (v >= F.col(n_views)))
    out = require(df, ~bad, "required view outside the album")
    k = pick_budget(F.col(row_id), menu, F.greatest(F.size(req), F.lit(1)), F.col(n_views), seed)
    out = out.withColumn("k_views", k)
    order = view_order(F.col(row_id), album(F.col(n_views)), req, seed)
    return out.withColumn("view_indices", F.when(F.col("k_views").isNotNull(), prefix_views(order, F.col("k_views"))))


def nested_views(
    df: DataFrame, budgets: dict[str, Column], row_id: str = "id", n_views: str = "n_views", required: str = "required",
    seed: int = 0,
) -> DataFrame:
    """Nested subsets (V2): every budget is a prefix of the same order. Too small a budget for the required views is an error."""
    req = F.array_distinct(F.col(required))
    out = df.withColumn("__order", view_order(F.col(row_id), album(F.col(n_views)), req, seed))
    for name, budget in budgets.items():
        size = F.greatest(F.floor(budget).cast("int"), F.lit(1))
        out = require(out, size >= F.size(req), f"budget {name} cannot hold the required views")
        out = out.withColumn(name, prefix_views(F.col("__order"), size))
    return out.drop("__order")


def retarget(
    df: DataFrame, max_teacher: int, menu: Sequence[int], row_id: str = "id", n_views: str = "n_views",
    required: str = "required", body: str = "body", seed: int = 0, student: str = "menu",
) -> DataFrame:
    """Teacher album capped with the required views kept, student views drawn inside it, both texts renumbered (V3).

    ``student``: ``menu`` draws a budget, ``half`` takes half of the teacher's views, ``equal`` gives both the same album.
    ``reason`` is set on rows that cannot satisfy the budgets; their views and texts are null.
    """
    n, req = F.col(n_views), F.array_distinct(F.col(required))
    order = view_order(F.col(row_id), album(n), req, seed)
    fits = n <= max_teacher
    teacher = F.when(fits, album(n)).otherwise(prefix_views(order, F.lit(max_teacher)))
    out = df.withColumn("teacher_views", F.when(fits | (F.size(req) <= max_teacher), teacher))
    t = F.col("teacher_views")
    low = F.greatest(F.size(req), F.lit(1))
    if student == "menu":
        k = pick_budget(F.col(row_id), menu, low, F.size(t), seed + 1)
    elif student == "half":
        half = F.floor(F.size(t) / 2).cast("int")
        k = F.when(half >= low, half)
    elif student == "equal":
        k = F.size(t)
    else:
        raise ValueError(f"unknown student policy: {student}")
    out = out.withColumn("k_views", F.when(t.isNotNull(), k))
    draw = view_order(F.col(row_id), t, req, seed + 1)
    out = out.withColumn("student_views", F.when(F.col("k_views").isNotNull(), prefix_views(draw, F.col("k_views"))))
    out = out.withColumn("teacher_body", F.when(t.isNotNull(), tx.renumber_frames(F.col(body), t)))
    out = out.withColumn(
        "student_body", F.when(F.col("student_views").isNotNull(), tx.renumber_frames(F.col(body), F.col("student_views")))
    )
    reason = (
        F.when(t.isNull(), "required_views_exceed_teacher_cap").when(F.col("k_views").isNull(), "no_legal_k_for_this_album")
        .when(F.col("teacher_body").isNull() | F.col("student_body").isNull(), "dangling_reference")
    )
    return out.withColumn("reason", reason)


def retarget_stats(plan: DataFrame, keys: Sequence[str] = (), per_view_tokens: int = 192) -> DataFrame:
    """Budget report of a retargeted plan: counts, mean views and ratio, token load."""
    # Conditional aggregates instead of a filter, which Spark would push below the view choice and evaluate twice.
    kept = F.col("reason").isNull()
    n, k = F.when(kept, F.size("teacher_views")), F.when(kept, F.col("k_views"))
    return plan.groupBy(*keys).agg(
        F.count(n).alias("samples"), F.sum((n < F.col("n_views")).cast("long")).alias("truncated_albums"),
        F.avg(k).alias("mean_k"), F.avg(n).alias("mean_teacher_views"), F.avg(n / k).alias("mean_ratio"),
        (F.avg(k) * per_view_tokens).alias("student_tokens_mean"), (F.max(n) * per_view_tokens).alias("teacher_tokens_max"),
    ).filter(F.col("samples") > 0)


def farthest_extras(keys: Column, pool: Column, k: Column) -> Column:
    """Greedy max-min index distance from the keys (V4), in pick order; the first candidate wins ties."""
    empty = F.array().cast("array<int>")

    def step(acc: Column, _: Column) -> Column:
        taken = F.concat(keys, acc)
        open_views = F.filter(pool, lambda v: ~F.array_contains(acc, v))
        scored = F.transform(open_views, lambda v: F.struct(
            F.array_min(F.transform(taken, lambda o: F.abs(v - o))).alias("d"), (-v).alias("neg")
        ))
        best = F.array_max(scored)
        return F.when(F.size(open_views) > 0, F.concat(acc, F.array(-best["neg"]))).otherwise(acc)

    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(empty)
    return F.aggregate(steps, empty, step)


def sweep(
    df: DataFrame, budgets: Sequence[int], group: str = "id", n_views: str = "n_views", arm: str = "even"
) -> DataFrame:
    """One row per question and budget sharing ``sweep_group`` (V5), with evenly spread views."""
    out = df.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    out = out.withColumn("view_indices", geo.even_views(F.col(n_views).cast("int"), F.col("budget")))
    return out.withColumn("sweep_group", F.col(group)).withColumn("sweep_arm", F.lit(arm)).withColumn(
        "sweep_id", F.concat(F.col(group).cast("string"), F.lit("@"), F.col("budget").cast("string"))
    )


def sweep_arms(df: DataFrame, arms: dict[str, Column], group: str = "id") -> DataFrame:
    """Fan-out into named arms with their own view lists (full against key views, key plus extras)."""
    entries = [F.struct(F.lit(name).alias("sweep_arm"), views.alias("view_indices")) for name, views in arms.items()]
    return df.select("*", F.inline(F.array(*entries))).withColumn("sweep_group", F.col(group))


def duplicate_groups(df: DataFrame, group: str, arm: str) -> DataFrame:
    """Sweep groups that hold the same arm twice; empty for a sound sweep."""
    return df.groupBy(group, arm).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def repeat_rows(df: DataFrame, n: int | Column, pos: str, interleave: bool = True) -> DataFrame:
    """Each row ``n`` times (V6) with ``repeat`` from 0 and ``slot``, its place in the repeated batch.

    Interleaved keeps copies together; blocked repeats the whole batch. A column gives a per-row count.
    """
    times = n if isinstance(n, Column) else F.lit(n)
    out = ranked(df, [], [F.col(pos)], pos_bucket(pos), "__row")
    out = out.withColumn("repeat", F.explode(F.sequence(F.lit(0), times.cast("int") - 1)))
    if isinstance(n, Column):
        return out.drop("__row")
    row = F.col("__row") - 1
    if interleave:
        return out.withColumn("slot", row * n + F.col("repeat")).drop("__row")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return out.withColumn("slot", F.col("repeat") * total + row).drop("__row")


def build_requests(
    docs: DataFrame, choices: str = "choices", doc_id: str = "doc_id", repeats: int = 1, rank: int = 0, world: int = 1
) -> DataFrame:
    """One request per document and choice (V7); documents are sliced by rank."""
    mine = docs.filter(F.pmod(F.col(doc_id), F.lit(world)) == rank)
    return mine.select("*", F.posexplode(choices).alias("idx", "choice")).withColumn("repeats", F.lit(repeats))


def fewshot(
    docs: DataFrame, pool: DataFrame, n: int, doc_id: str = "doc_id", example: str = "example", pool_id: str = "pool_id",
    how: str = "first", indices: Sequence[int] = (), sep: str = "\n\n", seed: int = 0,
) -> DataFrame:
    """Few-shot context per document (V8), never containing the document itself.

    ``first`` and ``index`` read a fixed handful of examples; ``random`` gives every document its own draw through a hash
    position into the numbered pool, with one spare in case the document meets itself.
    """
    numbered = ranked(pool, [], [F.col(pool_id)], pos_bucket(pool_id), "__rank")
    if how in ("first", "index"):
        if how == "first":
            few = numbered.filter(F.col("__rank") <= n + 1)
        else:
            few = numbered.filter((F.col("__rank") - 1).isin(list(indices)))
        listed = few.agg(F.array_sort(F.collect_list(F.struct(F.col("__rank"), F.col(pool_id).alias("i"), F.col(example).alias("e")))).alias("p")).scalar()
        own = F.filter(F.col("__p"), lambda e: e["i"] != F.col(doc_id))
        picked = F.slice(own, 1, n)
        return docs.withColumn("__p", listed).withColumn("context", F.array_join(F.transform(picked, lambda e: e["e"]), sep)).drop("__p")
    if how != "random":
        raise ValueError(f"unknown sampler: {how}")
    total = numbered.agg(F.max("__rank").alias("m")).scalar()
    # Consecutive positions from a hashed start never repeat within a document, as long as there are no more of them than examples.
    last = F.least(F.lit(n).cast("bigint"), total.cast("bigint") - 1)
    wanted = docs.select(doc_id).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.pmod(hash_int(stable_hash(doc_id, seed=seed)), total)
    wanted = wanted.withColumn("__rank", (start + F.col("slot")) % total + 1)
    got = wanted.join(numbered, "__rank").filter(F.col(pool_id) != F.col(doc_id))
    ctx = got.groupBy(doc_id).agg(F.array_sort(F.collect_list(F.struct("slot", F.col(example).alias("e")))).alias("l"))
    ctx = ctx.select(doc_id, F.array_join(F.transform(F.slice("l", 1, n), lambda e: e["e"]), sep).alias("context"))
    return docs.join(ctx, doc_id, "left")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group; the rank filter limits every map task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


