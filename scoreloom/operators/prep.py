"""Corpus preparation: eligibility, question parsing, messages, lengths and view audits (survey rows P1-P17)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import geometry as geo
from scoreloom.functions import text as tx
from scoreloom.functions.arrays import let
from scoreloom.operators.groups import join_null_safe, linear_percentiles, scalar_row
from scoreloom.operators.joins import require, with_row_index

# Answers that depend on view numbering.
ANSWER_FRAME = r"Frame-\d+"
ANSWER_ORDINAL_VIEW = r"(?i)\b(first|second|third|fourth|1st|2nd|3rd|4th)\s+(image|frame|view|picture)\b"


def with_exclusion(df: DataFrame, rules: Sequence[tuple[str | Column, Column]], name: str = "reason") -> DataFrame:
    """First failing rule as the exclusion reason (P1); null means the row is kept."""
    out = None
    for reason, condition in rules:
        label = F.lit(reason) if isinstance(reason, str) else reason
        hit = F.coalesce(condition, F.lit(False))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return df.withColumn(name, out if out is not None else F.lit(None).cast("string"))


def plan_rules(
    menu: Sequence[int], excluded_types: Sequence[str] = (), n_views: str = "n_views", kind: str = "question_type",
    answer: str = "answer", body: str = "body", required: str = "required", leaked: str | None = None,
    missing: str | None = None,
) -> list[tuple[str | Column, Column]]:
    """The eligibility chain of a multi-view plan row, in its fixed order."""
    n, req = F.col(n_views), F.array_distinct(F.col(required))
    need = F.greatest(F.size(req), F.lit(1))
    legal = F.exists(F.array(*[F.lit(k) for k in menu]), lambda k: (k >= need) & (k < n))
    rules: list[tuple[str | Column, Column]] = []
    if missing:
        rules.append(("missing_media", F.col(missing)))
    rules += [
        ("single_view_no_gap", n < 2),
        (F.concat(F.lit("excluded_type:"), F.col(kind)), F.col(kind).isin(list(excluded_types)) if excluded_types else F.lit(False)),
        ("answer_references_frame_index", F.col(answer).rlike(ANSWER_FRAME)),
        ("answer_references_view_ordinal", F.col(answer).rlike(ANSWER_ORDINAL_VIEW)),
        ("frame_reference_out_of_range", F.exists(tx.frame_refs(F.col(body)), lambda v: v >= n)),
        ("zero_privilege_all_views_required", ~legal & (F.size(req) >= n)),
        ("required_views_exceed_k_budget", ~legal),
    ]
    if leaked:
        rules.append(("scene_leak", F.col(leaked)))
    return rules


def flag_scenes(df: DataFrame, held_out: DataFrame, scene: str = "scene", name: str = "leaked") -> DataFrame:
    marks = held_out.select(scene).distinct().withColumn(name, F.lit(True))
    return join_null_safe(df, marks, [scene]).withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def exclusion_report(df: DataFrame, source: str, dims: Sequence[str], reason: str = "reason") -> DataFrame:
    """Counts of exclusions by source and reason, and of kept rows by each dimension (P2), in one pass over grouping sets."""
    kept = F.col(reason).isNull()
    cols = [source, reason, *[d for d in dims if d != source]]
    labelled = df.select(F.col(source), F.col(reason), *[
        F.when(kept, F.col(d).cast("string")).alias(d) for d in dims if d != source])
    sets = [[source, reason], *[[d, reason] for d in dims if d != source]]
    out = labelled.groupingSets(sets, *cols).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    full = (1 << len(cols)) - 1
    bit = lambda name: 1 << (len(cols) - 1 - cols.index(name))
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in [source, *[x for x in dims if x != source]]:
        mask = full ^ bit(d) ^ bit(reason)
        dim = F.when(F.col("g") == mask, F.lit(d)).otherwise(dim)
        value = F.when(F.col("g") == mask, F.col(d)).otherwise(value)
    tagged = out.select(dim.alias("dimension"), value.alias("value"), F.col(reason), "n")
    return tagged.filter(F.col(reason).isNull() | (F.col("dimension") == source))


def view_reference_counts(df: DataFrame, frames: str, key: Callable[[Column], Column] = lambda f: f) -> DataFrame:
    """View references over all rows, and distinct files behind them."""
    flat = df.select(F.explode(frames).alias("f"))
    return flat.agg(F.count(F.lit(1)).alias("expanded"), F.countDistinct(key(F.col("f"))).alias("unique_files"))


# Question templates in order of priority; each captures the viewpoint list and the object where it has them.
QUESTION_MARKER = "[Question]"
TEMPLATES = (
    ("among4", r"^Based on these four images \(image 1, 2, 3, and 4\) showing (?<obj>.+?) from different viewpoints "
               r"\((?<labels>[^)]*)\), with each camera aligned with room walls and partially capturing the surroundings: ", 2, 1),
    ("around3", r"^Based on these three images \(image 1, 2, and 3\) showing the same scene from different viewpoints "
                r"\((?<labels>[^)]*)\): ", 1, 0),
    ("pair", r"^Based on these two views showing the same scene: ", 0, 0),
    ("rotation_turn", r"^These (?:two|three|four) images \([^)]*\) show the same scene from (?:two |three )?different "
                      r"viewpoints\. (?:.+?) Based on these (?:two|three|four) images: ", 0, 0),
    ("rotation_opposing", r"^Based on these two opposing views \((?<labels>[^)]*)\) of the same scene captured during rotation: ", 1, 0),
)
TASK_MANY = (
    "Your task is to analyze the spatial arrangement of objects in the scene by examining the provided images, "
    "which show the scene from different viewpoints."
)
TASK_ONE = (
    "Your task is to analyze the spatial arrangement of objects in the scene by examining the provided image, "
    "which shows the scene from one viewpoint."
)
COUNT_WORDS = ("one", "two", "three", "four")


def _label_list(text: Column) -> Column:
    flat = F.replace(F.replace(text, F.lit(", and "), F.lit(", ")), F.lit(" and "), F.lit(", "))
    return F.filter(F.transform(F.split(flat, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_question(df: DataFrame, body: str = "body", n_views: str = "n_views") -> DataFrame:
    """Split a question into preamble, template prefix and clause (P5).

    Adds template, head, prefix, clause, labels, obj, anchor (0-based) and ``parse_error`` (null when everything is sound).
    """
    text = F.col(body)
    at = F.instr(text, QUESTION_MARKER)
    after = F.substring(text, at + len(QUESTION_MARKER), F.length(text))
    question = F.regexp_replace(after, r"^\n+", "")
    out = df.withColumn("__q", F.when(at > 0, question))
    q = F.col("__q")
    out = out.withColumn("head", F.when(at > 0, F.substring(text, F.lit(1), F.length(text) - F.length(q))))
    template, prefix, labels, obj = (F.lit(None).cast("string") for _ in range(4))
    for name, pattern, label_group, obj_group in reversed(TEMPLATES):
        hit = q.rlike(pattern)
        template = F.when(hit, F.lit(name)).otherwise(template)
        prefix = F.when(hit, F.regexp_extract(q, pattern, 0)).otherwise(prefix)
        labels = F.when(hit, F.regexp_extract(q, pattern, label_group) if label_group else F.lit("")).otherwise(labels)
        obj = F.when(hit, F.regexp_extract(q, pattern, obj_group) if obj_group else F.lit("")).otherwise(obj)
    out = out.withColumn("template", template).withColumn("prefix", prefix).withColumn("obj", obj)
    out = out.withColumn("labels", F.when(F.col("template").isNotNull(), _label_list(labels)))
    out = out.withColumn("clause", F.substring(q, F.length("prefix") + 1, F.length(q)))
    refs = tx.image_refs(F.col("clause"))
    out = out.withColumn("__refs", refs)
    n, anchors = F.col(n_views), F.col("__refs")
    out = out.withColumn("anchor", F.when(F.size(anchors) == 1, F.get(anchors, F.lit(0))))
    error = (
        F.when(at == 0, "no question section").when(F.col("template").isNull(), "no template matches")
        .when((F.size("labels") > 0) & (F.size("labels") != n), "viewpoint list does not match view count")
        .when(F.size(anchors) > 1, "clause names several views")
        .when(F.col("anchor").isNotNull() & ((F.col("anchor") < 0) | (F.col("anchor") >= n)), "clause names a view out of range")
    )
    return out.withColumn("parse_error", error).drop("__q", "__refs")


def _join_words(items: Column) -> Column:
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1))
    return F.when(n == 1, F.get(items, F.lit(0))).when(
        n == 2, F.array_join(items, " and ")).otherwise(many)


def rewrite_question(df: DataFrame, views: str = "views", name: str = "student_body") -> DataFrame:
    """Rewrite a parsed question for the kept views (P5); ``rewrite_error`` is set when the wording cannot be kept true."""
    v = F.col(views)
    count = F.size(v)
    word = F.get(F.array(*[F.lit(w) for w in COUNT_WORDS]), count - 1)
    kept = F.transform(v, lambda i: F.get(F.col("labels"), i))
    listed = _join_words(kept)
    numbers = F.concat(F.lit("image "), _join_words(F.transform(F.sequence(F.lit(1), count), lambda i: i.cast("string"))))
    t, one = F.col("template"), count == 1
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    among = F.when(one, say("Based on this image (image 1) showing ", F.col("obj"), " from one viewpoint (", listed,
                            "), with the camera aligned with room walls and partially capturing the surroundings: ")).otherwise(
        say("Based on these ", word, " images (", numbers, ") showing ", F.col("obj"), " from different viewpoints (", listed,
            "), with each camera aligned with room walls and partially capturing the surroundings: "))
    around = F.when(one, say("Based on this image (image 1) showing the same scene from one viewpoint (", listed, "): ")).otherwise(
        say("Based on these ", word, " images (", numbers, ") showing the same scene from different viewpoints (", listed, "): "))
    turn = F.when(one, "This image (image 1) shows the scene from one viewpoint. Based on this image: ")
    opposing = F.when(one, say("Based on this view (", listed, ") of the same scene captured during rotation: ")).otherwise(
        say("Based on these ", word, " opposing views (", listed, ") of the same scene captured during rotation: "))
    prefix = F.when(t == "among4", among).when(t == "around3", around).when(t == "rotation_turn", turn).when(t == "rotation_opposing", opposing)
    out = df.withColumn("__p", prefix).withColumn("__c", tx.renumber_images(F.col("clause"), v))
    head = F.when(one, F.replace(F.col("head"), F.lit(TASK_MANY), F.lit(TASK_ONE))).otherwise(F.col("head"))
    error = (
        F.col("parse_error")
        if "parse_error" in df.columns else F.lit(None).cast("string")
    )
    keeps = t == "pair"
    error = F.coalesce(error, F.when(~keeps & F.col("__c").isNull(), "question names a view that is not kept").when(
        ~keeps & one & ~F.contains(F.col("head"), F.lit(TASK_MANY)), "unknown preamble").when(
        ~keeps & F.col("__p").isNull(), "premise cannot be rewritten"))
    out = out.withColumn("rewrite_error", error)
    whole = F.when(keeps, say(F.col("head"), F.col("prefix"), F.col("clause"))).otherwise(say(head, F.col("__p"), F.col("__c")))
    return out.withColumn(name, F.when(F.col("rewrite_error").isNull(), whole)).drop("__p", "__c")


# Option marks and the instruction that may follow the last option.
OPTION_MARK = r"(?:^|\s)([A-E])\.\s"
PROMPT_OPTION_MARK = r"(?<![A-Za-z0-9])([A-D])[.)]\s+"
TRAILING_INSTRUCTION = r"(?s)\s*(?:Your answer can only include|Answer with the option).*$"


def parse_options(text: Column) -> Column:
    """struct(question, options): options A, B, C ... in unbroken order; other marks stay part of the text."""
    letters = F.regexp_extract_all(text, F.lit(OPTION_MARK), F.lit(1))
    marks = F.regexp_extract_all(text, F.lit(OPTION_MARK), F.lit(0))
    pieces = F.split(text, OPTION_MARK, -1)
    zipped = F.arrays_zip(letters.alias("letter"), marks.alias("mark"), F.slice(pieces, F.lit(2), F.size(letters)).alias("piece"))
    start = F.struct(
        F.get(pieces, F.lit(0)).alias("question"), F.array().cast("array<struct<letter:string,body:string>>").alias("options")
    )

    def step(acc: Column, e: Column) -> Column:
        opts = acc["options"]
        due = F.ascii(e["letter"]) == F.lit(65) + F.size(opts)
        fresh = F.concat(opts, F.array(F.struct(e["letter"].alias("letter"), e["piece"].alias("body"))))
        last = F.try_element_at(opts, F.lit(-1))
        longer = F.concat(F.slice(opts, F.lit(1), F.greatest(F.size(opts) - 1, F.lit(0))), F.array(F.struct(
            last["letter"].alias("letter"), F.concat(last["body"], e["mark"], e["piece"]).alias("body"))))
        grown = F.concat(acc["question"], e["mark"], e["piece"])
        return F.struct(
            F.when(due | (F.size(opts) > 0), acc["question"]).otherwise(grown).alias("question"),
            F.when(due, fresh).when(F.size(opts) > 0, longer).otherwise(opts).alias("options"),
        )

    return F.aggregate(zipped, start, step, lambda acc: F.struct(
        tx.trim_all(acc["question"]).alias("question"),
        F.transform(acc["options"], lambda o: F.struct(o["letter"].alias("letter"), tx.trim_all(o["body"]).alias("body"))).alias("options"),
    ))


def prompt_options(text: Column) -> Column:
    """Options offered by a prompt as ``A. body`` strings: the longest run from A, at least two, instruction removed."""
    letters = F.regexp_extract_all(text, F.lit(PROMPT_OPTION_MARK), F.lit(1))
    marks = F.regexp_extract_all(text, F.lit(PROMPT_OPTION_MARK), F.lit(0))
    pieces = F.split(text, PROMPT_OPTION_MARK, -1)
    start = F.struct(*[F.lit(0).alias(c) for c in ("at", "first", "len", "best_first", "best_len")])

    def step(acc: Column, letter: Column) -> Column:
        follows = F.ascii(letter) == F.lit(65) + acc["len"]
        size = F.when(follows, acc["len"] + 1).when(letter == "A", F.lit(1)).otherwise(F.lit(0))
        first = F.when(follows & (acc["len"] > 0), acc["first"]).otherwise(acc["at"])
        better = size > acc["best_len"]
        return F.struct(
            (acc["at"] + 1).alias("at"), first.alias("first"), size.alias("len"),
            F.when(better, first).otherwise(acc["best_first"]).alias("best_first"), F.greatest(size, acc["best_len"]).alias("best_len"),
        )

    run = F.aggregate(letters, start, step)

    def build(r: Column) -> Column:
        first, size = r["best_first"], r["best_len"]
        index = F.when(size >= 2, F.sequence(first, first + size - 1)).otherwise(F.array().cast("array<int>"))
        # The last option runs to the end of the prompt, with any later marks inside it.
        rest = F.concat(F.get(pieces, first + size), F.array_join(F.zip_with(
            F.slice(marks, first + size + 1, F.greatest(F.size(marks), F.lit(1))),
            F.slice(pieces, first + size + 2, F.greatest(F.size(pieces), F.lit(1))),
            lambda m, p: F.concat(F.coalesce(m, F.lit("")), F.coalesce(p, F.lit("")))), ""))
        return F.transform(index, lambda i: F.concat(
            F.get(letters, i), F.lit(". "),
            tx.trim_all(F.regexp_replace(tx.trim_all(F.when(i == first + size - 1, rest).otherwise(F.get(pieces, i + 1))), TRAILING_INSTRUCTION, ""))))

    return let(run, build)


def answer_hint(
    df: DataFrame, template: str, messages: str = "prompt", gold: str = "ground_truth", fallback: str = "answer",
    student_images: str | None = None, teacher_images: str | None = None,
) -> DataFrame:
    """Teacher messages with a hint after the last turn (P9); rows without an answer keep theirs and are flagged.

    ``template`` contains ``{answer}``. When image counts are given they must be equal. A content that is a list of typed parts gets the hint as
    one more text part, a plain string is extended.
    """
    out = df.withColumn("hint_answer", tx.resolve_answer(F.coalesce(F.col(gold), F.col(fallback))))
    if student_images and teacher_images:
        out = require(out, F.col(student_images) == F.col(teacher_images), "hint mode needs equal image counts")
    m = F.col(messages)
    before, after = template.split("{answer}")
    suffix = F.concat(F.lit(before), F.col("hint_answer"), F.lit(after))
    last = F.size(m) - 1
    content_type = df.schema[messages].dataType.elementType["content"].dataType
    if isinstance(content_type, T.ArrayType):
        fields = content_type.elementType
        values = {"type": F.lit("text"), "text": suffix}
        part = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        longer = lambda e: F.concat(e["content"], F.array(part))
    else:
        longer = lambda e: F.concat(e["content"], suffix)
    hinted = F.transform(m, lambda e, i: F.struct(
        e["role"].alias("role"), F.when(i == last, longer(e)).otherwise(e["content"]).alias("content")))
    out = out.withColumn("teacher_messages", F.when(F.col("hint_answer").isNotNull(), hinted).otherwise(m))
    return out.withColumn("needs_fallback", F.col("hint_answer").isNull())


def teacher_view(df: DataFrame, teacher_images: str, images: str = "images", messages: str = "prompt", teacher_messages: str | None = None) -> DataFrame:
    """The other privilege mode of P9: no hint, but the teacher's own images (and messages) in place of the student's.

    Rows without teacher images keep the student's and are flagged.
    """
    own = F.col(teacher_images)
    has = own.isNotNull() & (F.size(own) > 0)
    out = df.withColumn("needs_fallback", ~F.coalesce(has, F.lit(False)))
    swapped = F.coalesce(F.col(teacher_messages), F.col(messages)) if teacher_messages else F.col(messages)
    return out.withColumn("teacher_messages", F.when(~F.col("needs_fallback"), swapped).otherwise(F.col(messages))).withColumn(
        images, F.when(~F.col("needs_fallback"), own).otherwise(F.col(images)))


def pad_to_divisor(df: DataFrame, divisor: int, pos: str = "pos") -> DataFrame:
    """Rows repeated from the front until their number divides evenly (P15); ``padded`` marks the copies, ``slot`` is the place of a row.

    Fewer rows than copies needed are repeated several times over; an empty table stays empty. :func:`unpad` undoes it.
    """
    numbered = with_row_index(df, pos, "__row")
    total = scalar_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    missing = (F.lit(divisor) - total % divisor) % divisor
    # Row r is copied once for every r + k * total below the number of missing rows.
    times = F.greatest(F.ceil((missing - F.col("__row")) / total), F.lit(0)).cast("int")
    copies = F.sequence(F.lit(0), times)
    out = numbered.withColumn("__n", total).withColumn("__copy", F.explode(copies))
    slot = F.when(F.col("__copy") == 0, F.col("__row")).otherwise(F.col("__n") + (F.col("__copy") - 1) * F.col("__n") + F.col("__row"))
    return out.withColumn("padded", F.col("__copy") > 0).withColumn("slot", slot.cast("bigint")).drop("__row", "__n", "__copy")


def unpad(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("padded")).drop("padded", "slot")


def union_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two batches side by side (P11); shared columns must hold equal values on every row."""
    shared = [c for c in right.columns if c in left.columns and c != key]
    renamed = right
    for c in shared:
        renamed = renamed.withColumnRenamed(c, f"__r_{c}")
    out = left.join(renamed, key)
    for c in shared:
        out = require(out, F.col(c).eqNullSafe(F.col(f"__r_{c}")), f"column {c} differs between the two batches")
    return out.drop(*[f"__r_{c}" for c in shared])


def typed_parts(content: Column) -> Column:
    """Message text split at media placeholders into typed parts."""
    pattern = "<image>|<video>"
    marks = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    pieces = F.split(content, pattern, -1)
    inter = F.flatten(F.zip_with(pieces, marks, lambda p, m: F.array(
        F.struct(F.lit("text").alias("type"), p.alias("text")),
        F.struct(F.regexp_replace(m, "[<>]", "").alias("type"), F.lit(None).cast("string").alias("text")))))
    return F.filter(inter, lambda e: F.when(e["type"] == "text", F.coalesce(e["text"], F.lit("")) != "").otherwise(e["type"].isNotNull()))


def build_messages(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its messages in turn order, contents as typed parts."""
    entry = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), typed_parts(F.col(text)).alias("content"))
    out = df.groupBy(key).agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["turn"] - b["turn"]).cast("int")).alias("m"))
    return out.select(key, F.transform("m", lambda e: F.struct(e["role"].alias("role"), e["content"].alias("content"))).alias("messages"))


def turn_pairs(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(prompt, response) rows: each assistant turn with the user turn right before it."""
    u = df.filter(F.col(role) == "user").select(key, (F.col(turn) + 1).alias(turn), F.col(text).alias("prompt"))
    a = df.filter(F.col(role) == "assistant").select(key, turn, F.col(text).alias("response"))
    return a.join(u, [key, turn])


def token_count(text: Column) -> Column:
    """Default length measure: white-space separated tokens."""
    return F.size(tx.words(text))


def filter_overlong(df: DataFrame, cap: int, length: Column) -> DataFrame:
    """Rows whose length is within ``cap`` (P13); rows that cannot be measured count as too long."""
    return df.filter(F.coalesce(length, F.lit(cap + 1)) <= cap)


def length_audit(df: DataFrame, length: Column, cap: int, response: int, model_cap: int, keys: Sequence[str] = ()) -> DataFrame:
    """Lengths at a glance (P13): min, median, p99, max, rows over the prompt cap and over the model cap."""
    rows = df.select(*keys, F.coalesce(length, F.lit(cap + 1)).alias("len"))
    n = F.col("len")
    head = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(n).alias("min"), F.max(n).alias("max"),
        F.sum((n > cap).cast("long")).alias("over_prompt"), F.sum((n + response > model_cap).cast("long")).alias("over_model"),
    )
    tails = linear_percentiles(rows, list(keys), "len", {"p50": 0.5, "p99": 0.99}).drop("n")
    if keys:
        out = join_null_safe(head, tails, list(keys))
    else:
        out = head.withColumn("__t", scalar_row(tails)).select("*", "__t.*").drop("__t")
    return out.withColumn("p50", F.floor("p50")).withColumn("p99", F.floor("p99"))


TOKENS_PER_IMAGE = 252


def sample_length(words: Column, images: Column, tag: Column | None = None) -> Column:
    """Training length: words plus a fixed load per image (P14); negative for 2d rows when a tag is given."""
    total = words + images * TOKENS_PER_IMAGE
    return total if tag is None else F.when(F.coalesce(tag, F.lit("2d")) == "2d", -total).otherwise(total)


def preference_pairs(df: DataFrame, prompt: str, response: str, score: str, pos: str) -> DataFrame:
    """Best and worst response per prompt (P16); prompts whose responses all score the same give no pair."""
    out = df.groupBy(prompt).agg(
        F.max_by(response, F.struct(F.col(score), -F.col(pos))).alias("chosen"),
        F.min_by(response, F.struct(F.col(score), F.col(pos))).alias("rejected"),
        F.max(score).alias("__hi"), F.min(score).alias("__lo"),
    )
    return out.filter(F.col("__hi") > F.col("__lo")).drop("__hi", "__lo")


def view_audit(
    plan: DataFrame, views: DataFrame, cap: int, row: str = "id", source: str = "source", frames: str = "frames", cache: str = "cache"
) -> DataFrame:
    """Per row: shown views, views without a file, misaligned views, visual tokens, over the limit.

    ``views`` has one row per file with width and height.
    """
    flat = plan.select(row, source, F.explode(frames).alias(cache))
    sized = flat.join(views.select(cache, "width", "height"), cache, "left")
    w, h = F.col("width"), F.col("height")
    tokens = geo.visual_tokens(w, h)
    return sized.groupBy(row, source).agg(
        F.count(F.lit(1)).alias("views"), F.sum(w.isNull().cast("long")).alias("missing"),
        F.sum((w.isNotNull() & ~geo.is_aligned(w, h)).cast("long")).alias("misaligned"),
        F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"),
    ).withColumn("over", F.col("tokens") > cap)


def audit_summary(audit: DataFrame, source: str = "source") -> DataFrame:
    return audit.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("missing").alias("missing"), F.sum("misaligned").alias("misaligned"),
        F.max("tokens").alias("peak"), F.sum(F.col("over").cast("long")).alias("rows_over"),
    )


def refuse_on_problems(audit: DataFrame) -> DataFrame:
    """Pass rows through, failing the job on the first missing, misaligned or oversized row."""
    ok = (F.col("missing") == 0) & (F.col("misaligned") == 0) & ~F.col("over")
    return require(audit, ok, "refusing to write: views are missing, misaligned or over the token limit")


def truncation_audit(df: DataFrame, keys: Sequence[str], total: Column, label: Column, cap: int) -> DataFrame:
    """Mean label tokens lost to the length cap per group; labels sit at the end of the sequence."""
    kept = F.least(F.greatest(F.lit(cap) - (total - label), F.lit(0)), label)
    rows = df.select(*keys, total.alias("t"), label.alias("l"), kept.alias("k"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("t").alias("total_len"), F.avg("l").alias("label_tokens"),
        F.avg(F.least(F.col("t"), F.lit(cap))).alias("kept_len"), F.avg("k").alias("kept_label"),
        (F.lit(100.0) * (1 - F.try_divide(F.avg("k"), F.avg("l")))).alias("lost_pct"),
    )
