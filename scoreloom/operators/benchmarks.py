"""Benchmark roll-ups over scored rows (survey rows G10-G20, G22, G23)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.groups import join_null_safe, order_statistics, scalar_row


def upper_median(n: Column) -> Column:
    """Index ``n // 2``: the upper of the two middle elements."""
    return F.floor(n / 2)


def tail_index(n: Column, q: float) -> Column:
    """Index ``min(int(n * q), n - 1)``, no interpolation."""
    return F.least(F.floor(n * F.lit(q)), n - 1)


def _row(level: str, name: Column, value: Column, n: Column) -> Column:
    return F.struct(
        F.lit(level).alias("level"), name.cast("string").alias("name"), value.cast("double").alias("value"),
        n.cast("bigint").alias("n"),
    )


def macro_score(
    df: DataFrame, merges: dict[str, Sequence[str]] | None = None, kind: str = "type", score: str = "score",
    answered: str | None = "answered",
) -> DataFrame:
    """Unweighted mean over question types (G10), where merged types share one vote.

    Rows: one per type, one per merged name, then overall, micro and answered share. Everything after the per-type
    aggregate works on one row per type.
    """
    vote = F.col(kind)
    for name, members in (merges or {}).items():
        vote = F.when(F.col(kind).isin(list(members)), F.lit(name)).otherwise(vote)
    seen = F.sum(F.col(answered).cast("double")) if answered else F.lit(None).cast("double")
    per_type = df.groupBy(kind).agg(
        F.sum(F.col(score)).alias("s"), F.count(F.lit(1)).alias("n"), seen.alias("a")
    ).withColumn("acc", F.col("s") / F.col("n")).withColumn("vote", vote)
    per_vote = per_type.groupBy("vote").agg(
        F.avg("acc").alias("acc"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("a").alias("a"),
        F.collect_list(_row("type", F.col(kind), F.col("acc"), F.col("n"))).alias("rows"),
    )
    total = per_vote.agg(
        F.flatten(F.collect_list("rows")).alias("types"),
        F.collect_list(_row("vote", F.col("vote"), F.col("acc"), F.col("n"))).alias("votes"),
        F.avg("acc").alias("macro"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("a").alias("a"),
        F.count(F.lit(1)).alias("k"),
    )
    heads = F.array(
        _row("overall", F.lit("overall"), F.col("macro"), F.col("k")),
        _row("micro", F.lit("micro"), F.col("s") / F.col("n"), F.col("n")),
        _row("answered", F.lit("answered"), F.col("a") / F.col("n"), F.col("n")),
    )
    return total.select(F.inline(F.concat("types", "votes", heads))).filter(F.col("value").isNotNull())


def weighted_score(
    df: DataFrame, halves: dict[str, Sequence[str]], source: str = "source", task: str = "task", score: str = "score"
) -> DataFrame:
    """Sources averaged inside each half, halves averaged into the combined score (G11); an empty half stays missing."""
    sets = df.groupingSets([[source], [task], []], source, task).agg(
        F.avg(score).alias("value"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    )
    label = F.when(F.col("g") == 1, "source").when(F.col("g") == 2, "task").otherwise("micro")
    rows = sets.select(
        label.alias("level"),
        F.coalesce(F.when(F.col("g") == 1, F.col(source)), F.when(F.col("g") == 2, F.col(task)), F.lit("micro")).alias("name"),
        "value", "n",
    )
    is_src = F.col("level") == "source"
    half = {k: F.avg(F.when(is_src & F.col("name").isin(list(v)), F.col("value"))) for k, v in halves.items()}
    count = {k: F.sum(F.when(is_src & F.col("name").isin(list(v)), F.col("n"))) for k, v in halves.items()}
    total = rows.agg(
        F.collect_list(F.struct("level", "name", "value", "n")).alias("rows"),
        *[half[k].alias(f"h_{k}") for k in halves], *[count[k].alias(f"n_{k}") for k in halves],
    )
    combined = sum((F.col(f"h_{k}") for k in halves), F.lit(0.0)) / len(halves)
    extra = F.array(
        *[_row("half", F.lit(k), F.col(f"h_{k}"), F.col(f"n_{k}")) for k in halves],
        _row("combined", F.lit("combined"), combined, sum((F.col(f"n_{k}") for k in halves), F.lit(0))),
    )
    return total.select(F.inline(F.concat("rows", extra))).filter(F.col("value").isNotNull())


def rollup_views(
    df: DataFrame, budget: str = "budget", family: str = "family", views: str = "views", score: str = "score",
    answered: str = "answered", tokens: str = "tokens",
) -> DataFrame:
    """Accuracy by family, view count and cell (G12), never across budgets; lengths per budget."""
    acc = df.groupingSets(
        [[budget], [budget, family], [budget, views], [budget, family, views]], budget, family, views
    ).agg(
        F.avg(score).alias("acc"), F.avg(F.col(answered).cast("double")).alias("answered"), F.count(F.lit(1)).alias("n"),
        F.avg(tokens).alias("tokens_mean"), F.grouping_id().alias("g"),
    )
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "family").when(F.col("g") == 2, "views").otherwise("cell")
    n = F.col("n")
    lengths = order_statistics(
        df, [budget], tokens, {"lo": F.floor((n - 1) / 2), "hi": upper_median(n), "p95": tail_index(n, 0.95)}
    ).select(budget, ((F.col("lo") + F.col("hi")) / 2).alias("tokens_median"), F.col("p95").alias("tokens_p95"))
    out = join_null_safe(acc.withColumn("level", level), lengths, [budget])
    overall = F.col("level") == "overall"
    return out.select(
        budget, "level", family, views, "acc", "answered", "n",
        F.when(overall, F.col("tokens_mean")).alias("tokens_mean"),
        F.when(overall, F.col("tokens_median")).alias("tokens_median"),
        F.when(overall, F.col("tokens_p95")).alias("tokens_p95"),
    )


def level_score(
    df: DataFrame, levels: dict[str, Sequence[str]], task: str = "task", score: str = "score"
) -> DataFrame:
    """Mean per task, mean of tasks per level, overall mean over tasks."""
    level = F.lit(None).cast("string")
    for name, members in levels.items():
        level = F.when(F.col(task).isin(list(members)), F.lit(name)).otherwise(level)
    per_task = df.groupBy(task).agg(F.avg(score).alias("value"), F.count(F.lit(1)).alias("n")).withColumn("lv", level)
    per_level = per_task.groupBy("lv").agg(
        F.avg("value").alias("v"), F.sum("value").alias("sv"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.collect_list(_row("task", F.col(task), F.col("value"), F.col("n"))).alias("rows"),
    )
    total = per_level.agg(
        F.flatten(F.collect_list("rows")).alias("tasks"),
        F.collect_list(F.when(F.col("lv").isNotNull(), _row("level", F.col("lv"), F.col("v"), F.col("n")))).alias("lvs"),
        F.sum("sv").alias("s"), F.sum("k").alias("k"), F.sum("n").alias("n"),
    )
    overall = F.array(_row("overall", F.lit("overall"), F.col("s") / F.col("k"), F.col("n")))
    return total.select(F.inline(F.concat("tasks", "lvs", overall)))


def marginal_accuracy(df: DataFrame, dims: Sequence[str], correct: str = "correct") -> DataFrame:
    """Accuracy by each dimension on its own and overall (G14), in percent."""
    sets = [[d] for d in dims] + [[]]
    out = df.groupingSets(sets, *dims).agg(
        (F.lit(100.0) * F.avg(F.col(correct).cast("double"))).alias("acc"), F.count(F.lit(1)).alias("answered"),
        F.grouping_id().alias("g"),
    )
    full = (1 << len(dims)) - 1
    dim, value = F.lit("overall"), F.lit("overall")
    for i, d in enumerate(dims):
        bit = full ^ (1 << (len(dims) - 1 - i))
        dim = F.when(F.col("g") == bit, F.lit(d)).otherwise(dim)
        value = F.when(F.col("g") == bit, F.col(d).cast("string")).otherwise(value)
    return out.select(dim.alias("dimension"), value.alias("name"), F.coalesce("acc", F.lit(0.0)).alias("acc"), "answered")


def all_variants_acc(
    df: DataFrame, index: str = "index", hit: str = "hit", category: str = "category", modulus: int = 1_000_000
) -> DataFrame:
    """A question counts only if all its variants are right (G15); variants share ``index % modulus``.

    The category of the main variant (index below ``modulus``) labels the question.
    """
    q = df.groupBy((F.col(index) % modulus).alias("q")).agg(
        F.bool_and(F.col(hit).cast("boolean")).alias("hit"),
        F.max(F.when(F.col(index) < modulus, F.col(category))).alias("category"),
        F.max((F.col(index) < modulus).cast("int")).alias("main"),
    ).filter(F.col("main") == 1)
    return q.rollup("category").agg(
        F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    ).select(F.when(F.col("g") == 1, "overall").otherwise(F.col("category")).alias("category"), "hit_rate", "n")


def detection_report(
    df: DataFrame, subsets: dict[str, Sequence[str]], label: str = "label", tp: str = "tp", fp: str = "fp", fn: str = "fn"
) -> DataFrame:
    """Precision, recall and F1 per class and their means over class subsets (G16); a class without rows counts as 0."""
    z = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    per = df.groupBy(label).agg(F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"))
    per = per.withColumn("precision", z(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "recall", z(F.col("tp"), F.col("tp") + F.col("fn"))
    )
    p, r = F.col("precision"), F.col("recall")
    per = per.withColumn("f1", z(2 * p * r, p + r))
    fields = [F.col("precision"), F.col("recall"), F.col("f1")]
    entry = lambda level, name, cols: F.struct(
        F.lit(level).alias("level"), name.alias("name"),
        *[c.alias(k) for c, k in zip(cols, ("precision", "recall", "f1"))],
    )
    sums = []
    for name, members in subsets.items():
        inside = F.col(label).isin(list(members))
        for metric in ("precision", "recall", "f1"):
            total = F.coalesce(F.sum(F.when(inside, F.col(metric))), F.lit(0.0))
            sums.append((total / len(members)).alias(f"{name}_{metric}"))
    total = per.agg(F.collect_list(entry("class", F.col(label).cast("string"), fields)).alias("rows"), *sums)
    means = F.array(*[
        entry("subset", F.lit(name), [F.col(f"{name}_{m}") for m in ("precision", "recall", "f1")]) for name in subsets
    ])
    return total.select(F.inline(F.concat("rows", means)))


def iou_hit_rates(df: DataFrame, iou: str = "iou", thresholds: Sequence[float] = (0.25, 0.5)) -> DataFrame:
    """Share of rows whose overlap reaches each threshold."""
    return df.agg(*[F.avg((F.col(iou) >= t).cast("double")).alias(f"iou_at_{str(t).replace('.', '_')}") for t in thresholds])


def rollup_scored(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scored-dump roll-up (G17): unreadable golds leave the denominator, unanswered rows stay in it.

    Needs gold_parsed, answered, score, truncated, output_tokens, family, axes_stated, axes_correct, axes_missing.
    """
    ok = F.col("gold_parsed") == 1
    ans = ok & (F.col("answered") == 1)
    direction = ans & (F.col("family") == "direction")
    cnt = lambda c: F.sum(c.cast("long"))
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), cnt(ok).alias("scorable"), cnt(ans).alias("answered_rows"),
        F.sum(F.when(ok, F.col("score")).otherwise(0.0)).alias("score_sum"),
        F.sum(F.col("truncated").cast("long")).alias("trunc"), cnt(direction).alias("direction_rows_answered"),
        cnt(direction & (F.col("axes_missing") == 0)).alias("complete"),
        F.sum(F.when(direction, F.col("axes_stated")).otherwise(0)).alias("stated"),
        F.sum(F.when(direction, F.col("axes_correct")).otherwise(0)).alias("axes_ok"),
    )
    med = order_statistics(df, keys, "output_tokens", {"median_output_tokens": upper_median(F.col("n"))}).drop("n")
    pct = lambda a, b: F.coalesce(F.try_divide(F.lit(100.0) * F.col(a), F.col(b)), F.lit(0.0))
    out = join_null_safe(agg, med, keys)
    has_dir = F.col("direction_rows_answered") > 0
    return out.select(
        *keys, "rows", "scorable", (F.col("rows") - F.col("scorable")).alias("excluded_gold_unparsed"),
        pct("score_sum", "scorable").alias("acc"), pct("answered_rows", "scorable").alias("answered_pct"),
        pct("score_sum", "answered_rows").alias("acc_of_answered"), pct("trunc", "rows").alias("truncated_pct"),
        "median_output_tokens",
        F.when(has_dir, pct("complete", "direction_rows_answered")).alias("direction_complete_pct"),
        F.when(has_dir, pct("axes_ok", "stated")).alias("direction_axis_acc"),
    )


def coverage(
    df: DataFrame, keys: Sequence[str], correct: str = "correct", answered: str = "answered", pred: str = "pred",
    gold: str = "gold",
) -> DataFrame:
    """``acc = coverage x accuracy on answered`` per cell (G18), with letter histograms ``letter:count`` in letter order."""
    a = F.col(answered).cast("boolean")
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(correct).cast("double")) * 100).alias("acc"),
        (F.avg(a.cast("double")) * 100).alias("coverage"),
        (F.avg(F.when(a, F.col(correct).cast("double"))) * 100).alias("acc_on_answered"),
    )
    sides = F.array(
        F.struct(F.lit("pred").alias("side"), F.col(pred).alias("letter")),
        F.struct(F.lit("gold").alias("side"), F.col(gold).alias("letter")),
    )
    counts = df.select(*keys, F.inline(sides)).groupBy(*keys, "side", "letter").agg(F.count(F.lit(1)).alias("c"))
    entry = F.struct("letter", "c")
    hist = counts.groupBy(*keys).agg(*[
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("side") == s, entry))),
                lambda e: F.concat(F.coalesce(e["letter"], F.lit("")), F.lit(":"), e["c"].cast("string")),
            ), " ",
        ).alias(f"{s}_letters")
        for s in ("pred", "gold")
    ])
    return join_null_safe(base, hist, keys)


def run_summary(df: DataFrame, kind: str = "type") -> DataFrame:
    """Per-type summary of a run and its overall row.

    The overall scores are means over types; token percentiles are index based. Needs rule_score, final_score,
    boxed_score, final_answered, truncated, boxed_present, output_tokens, failure_reason.
    """
    pct = lambda c: F.avg(F.col(c).cast("double")) * 100
    per = df.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"), pct("final_score").alias("score"), pct("rule_score").alias("rule_only_score"),
        pct("boxed_score").alias("boxed_score"), pct("final_answered").alias("answered_pct"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"), pct("boxed_present").alias("boxed_present_pct"),
    )
    n = F.col("n")
    med = order_statistics(df, [kind], "output_tokens", {"tokens_median": upper_median(n)}).drop("n")
    tails = order_statistics(df, [], "output_tokens", {
        "tokens_median": tail_index(n, 0.5), "tokens_p90": tail_index(n, 0.9), "tokens_p95": tail_index(n, 0.95),
        "tokens_p99": tail_index(n, 0.99), "tokens_max": tail_index(n, 1.0),
    }).drop("n")
    w = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    overall = per.agg(
        F.sum("n").alias("n"), F.avg("score").alias("score"), F.avg("rule_only_score").alias("rule_only_score"),
        F.avg("boxed_score").alias("boxed_score"), w("answered_pct").alias("answered_pct"),
        F.sum("truncated").alias("truncated"), w("boxed_present_pct").alias("boxed_present_pct"),
    ).withColumn(kind, F.lit("overall"))
    tail_cols = ["tokens_p90", "tokens_p95", "tokens_p99", "tokens_max"]
    types = join_null_safe(per, med, [kind])
    total = overall.withColumn("__t", scalar_row(tails)).select("*", "__t.*").drop("__t")
    for c in tail_cols:
        types = types.withColumn(c, F.lit(None).cast("double"))
    return types.unionByName(total.select(*types.columns))


def failure_counts(df: DataFrame, kind: str = "type", reason: str = "failure_reason") -> DataFrame:
    """Rows per type and failure reason, and over all types."""
    return df.groupingSets([[kind, reason], [reason]], kind, reason).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g")
    ).select(F.when(F.col("g") == 2, "overall").otherwise(F.col(kind)).alias(kind), reason, "n")


def curve(
    df: DataFrame, by: Sequence[str], score: str = "score", answered: str = "answered", views: str = "views"
) -> DataFrame:
    """Accuracy, answered share and mean view count per bucket."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), (F.avg(score) * 100).alias("acc"),
        (F.avg(F.col(answered).cast("double")) * 100).alias("answered_pct"), F.avg(views).alias("mean_views"),
    )


def curve_delta(df: DataFrame, by: str, low, high, kind: str | None = None, score: str = "score") -> DataFrame:
    """Accuracy difference of two buckets, overall or per type; null when a bucket is empty."""
    at = lambda v: F.avg(F.when(F.col(by) == F.lit(v), F.col(score))) * 100
    keys = [kind] if kind else []
    return df.groupBy(*keys).agg(at(low).alias("low_acc"), at(high).alias("high_acc")).withColumn(
        "delta", F.col("high_acc") - F.col("low_acc")
    )


def _weighted(df: DataFrame, halves: dict[str, Sequence[str]], ok: Column, source: str, keys: Sequence[str]) -> DataFrame:
    per = df.groupBy(*keys, source).agg(F.avg(ok.cast("double")).alias("acc"))
    half = sum(
        (
            sum((F.coalesce(F.max(F.when(F.col(source) == s, F.col("acc"))), F.lit(0.0)) for s in members), F.lit(0.0))
            / len(members)
            for members in halves.values()
        ),
        F.lit(0.0),
    )
    return per.groupBy(*keys).agg((half / len(halves) * 100).alias("score"))


def null_baselines(
    df: DataFrame, halves: dict[str, Sequence[str]], letters: str = "ABCDEF", source: str = "source", gold: str = "gold",
    response: str = "response", n_choices: str = "n_choices", prefix: str = "Based", prefix_letter: str = "B",
) -> DataFrame:
    """What an answer that ignores the question would score (G22): each constant letter, a prefix rule, random choice.

    Gold letters are counted per source first; the constant-letter rows come from that small table.
    """
    per = df.groupBy(source, gold).agg(F.count(F.lit(1)).alias("c"))
    guess = per.withColumn("letter", F.explode(F.array(*[F.lit(x) for x in letters])))
    acc = guess.groupBy("letter", source).agg(
        (F.sum(F.when(F.col(gold) == F.col("letter"), F.col("c")).otherwise(0)) / F.sum("c")).alias("acc")
    )
    half = sum(
        (
            sum((F.coalesce(F.max(F.when(F.col(source) == s, F.col("acc"))), F.lit(0.0)) for s in m), F.lit(0.0)) / len(m)
            for m in halves.values()
        ),
        F.lit(0.0),
    )
    constants = acc.groupBy("letter").agg((half / len(halves) * 100).alias("score")).select(
        F.concat(F.lit("constant "), F.col("letter")).alias("rule"), "score"
    )
    opens = F.trim(F.col(response)).startswith(prefix) & (F.col(gold) == prefix_letter)
    by_prefix = _weighted(df, halves, opens, source, []).select(F.lit(f"opens with {prefix}").alias("rule"), "score")
    chance = df.agg((F.avg(F.lit(1.0) / F.col(n_choices)) * 100).alias("score")).select(F.lit("random").alias("rule"), "score")
    return constants.unionByName(by_prefix).unionByName(chance)


def best_constant(baselines: DataFrame) -> DataFrame:
    """The constant letter with the highest score, first letter on ties."""
    return (
        baselines.filter(F.col("rule").startswith("constant"))
        .orderBy(F.col("score").desc(), F.col("rule")).limit(1)
    )


# Answer shapes of a multiple-choice response.
CLEAN_LETTER = r"^\s*\(?([A-F])\)?\s*[.:,)]?\s*$"
LEADING_LETTER = r"^\s*\(?([A-F])\)?\s*[.:,)\s]"


def shape(response: Column) -> Column:
    text = F.trim(F.regexp_replace(response, r"^\s+|\s+$", ""))
    return (
        F.when(text == "", "empty").when(text.rlike(CLEAN_LETTER), "bare_letter")
        .when(text.rlike(LEADING_LETTER), "letter_then_text").otherwise("prose")
    )


def response_shape(df: DataFrame, keys: Sequence[str], response: str = "response", pred: str = "pred") -> DataFrame:
    """Answer shapes, unreadable and accidental letters, words per row."""
    tagged = df.withColumn("__s", shape(F.col(response)))
    share = lambda c: F.avg(c.cast("double")) * 100
    none = F.coalesce(F.col(pred), F.lit("")) == ""
    words = F.size(F.filter(F.split(F.col(response), r"\s+"), lambda w: w != ""))
    return tagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[share(F.col("__s") == s).alias(s) for s in ("bare_letter", "letter_then_text", "prose", "empty")],
        share(none).alias("parse_fail"), share(~none & (F.col("__s") == "prose")).alias("spurious"),
        F.avg(words).alias("words"),
    )


def top_openings(df: DataFrame, keys: Sequence[str], response: str = "response", width: int = 40, k: int = 6) -> DataFrame:
    """The ``k`` most frequent first ``width`` characters per group, counted before ranking."""
    head = F.regexp_replace(F.substring(F.regexp_replace(F.col(response), r"^\s+|\s+$", ""), 1, width), "\n", r"\\n")
    counts = df.select(*keys, head.alias("head")).groupBy(*keys, "head").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.col("c").desc(), F.col("head"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
