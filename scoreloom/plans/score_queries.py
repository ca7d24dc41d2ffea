"""Response scoring queries: R1-R16."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from scoreloom.functions import scoring as sc
from scoreloom.functions.vqa import vqa_form
from scoreloom.operators import spec as sp
from scoreloom.plans.catalog import register, table
from scoreloom.plans.fixtures import EVAL_SQL, ROLLOUT_SQL, evals, rollouts

_TH = "[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.8999999999999999, 0.95]::DOUBLE[]"


def _mra(p: str, g: str) -> str:
    return f"CASE WHEN {g} = 0 THEN CASE WHEN {p} = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_filter({_TH}, lambda th: abs({p} - {g}) / abs({g}) <= 1 - th)) / 10.0::DOUBLE END"


# Every part row becomes one response per style; letters and numbers come from the part's own columns.
_P = """
pr AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_size AS size, substr('ABCD', CAST(p_partkey % 4 + 1 AS INTEGER), 1) AS letter,
  ['A. small', 'B. medium', 'C. large', 'D. other'] AS opts, ['small', 'medium', 'large', 'other'][p_partkey % 4 + 1] AS body, p_retailprice AS price FROM part)
"""


def _parts(spark, sf):
    k = F.col("p_partkey") % 4
    return table(spark, sf, "part", spread=True).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("size"),
        F.substring(F.lit("ABCD"), (k + 1).cast("int"), F.lit(1)).alias("letter"),
        F.array(*[F.lit(x) for x in ("A. small", "B. medium", "C. large", "D. other")]).alias("opts"),
        F.get(F.array(*[F.lit(x) for x in ("small", "medium", "large", "other")]), k.cast("int")).alias("body"),
        F.col("p_retailprice").alias("price"),
    )


def _styles(df, styles: dict):
    """One row per (part, style) with the response text of the style."""
    entries = [F.struct(F.lit(n).alias("style"), t.alias("response")) for n, t in styles.items()]
    return df.select("*", F.inline(F.array(*entries)))


def _c(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sql_styles(styles: dict[str, str]) -> str:
    """VALUES table of the expected answer of each style, written in SQL over the same columns."""
    return " UNION ALL ".join(f"SELECT id, '{name}' AS style, {expr} AS parsed FROM pr" for name, expr in styles.items())


@register("r1_boxed", "id:l style:s boxed:s normalised:s", f"""
WITH {_P}, e AS (
  SELECT id, 'plain' AS style, CAST(size AS VARCHAR) AS b, CAST(size AS VARCHAR) AS n FROM pr
  UNION ALL SELECT id, 'text', '\\text{{' || name || '}}', name FROM pr
  UNION ALL SELECT id, 'nested', '\\frac{{' || size || '}}{{2}}', CASE WHEN size % 2 = 0 THEN CAST(size // 2 AS VARCHAR) ELSE (size // 2) || '.5' END FROM pr
  UNION ALL SELECT id, 'last', '(' || letter || ')', '(' || letter || ')' FROM pr
  UNION ALL SELECT id, 'unclosed', NULL, NULL FROM pr UNION ALL SELECT id, 'none', NULL, NULL FROM pr)
SELECT id, style, b AS boxed, n AS normalised FROM e""")
def _r1(spark, sf):
    p = _parts(spark, sf)
    size, name, letter = F.col("size"), F.col("name"), F.col("letter")
    out = _styles(p, {
        "plain": _c("so \\boxed{", size, "} done"), "text": _c("x \\boxed{\\text{", name, "}}"), "nested": _c("\\boxed{\\frac{", size, "}{2}}"),
        "last": _c("\\boxed{1} then \\boxed{(", letter, ")}."), "unclosed": _c("\\boxed{", size), "none": _c("it is ", size),
    })
    b = sc.boxed(F.col("response"))
    return out.select("id", "style", b.alias("boxed"), sc.normalise_boxed(b).alias("normalised"))


_R2 = {
    "lone": "letter", "paren": "letter", "said": "letter", "own_body": "letter", "wrong_body": "NULL", "body_only": "letter",
    "image_tail": "letter", "choose": "letter", "prose": "NULL", "think": "letter", "out_of_range": "NULL", "empty": "NULL",
}


@register("r2_option_lastline", "id:l style:s parsed:s", f"WITH {_P} SELECT * FROM ({_sql_styles(_R2)})")
def _r2(spark, sf):
    p = _parts(spark, sf)
    letter, body = F.col("letter"), F.col("body")
    out = _styles(p, {
        "lone": _c("Reasoning about A and B.\n", letter), "paren": _c("x\n(", F.lower(letter), ")"), "said": _c("B first.\nThe answer is ", letter, "."),
        "own_body": _c("Hm\n", letter, ". ", body), "wrong_body": _c("Hm\n", letter, ". nothing like it"), "body_only": _c("So\nIt is ", body),
        "image_tail": _c("I choose ", letter, "\nImage 178: Kitchen."), "choose": _c("I choose ", letter), "prose": _c("It could be any of them, ", "hard to tell."),
        "think": _c("<think>answer is D</think>\nanswer: ", letter), "out_of_range": _c("The answer is ", "F"), "empty": _c(" ", "\n"),
    })
    return out.select("id", "style", sc.option_lastline(F.col("response"), F.col("opts")).alias("parsed"))


_R3 = {
    "last": "size", "said": "size", "comma": "1000 + size", "negative": "-size", "power": "size", "listing": "NULL", "frame": "NULL",
    "junk_tail": "NULL", "terse_junk": "size", "version": "NULL", "decimal": "size + 0.5",
}


@register("r3_number_lastline", "id:l style:s parsed:d", f"WITH {_P} SELECT * FROM ({_sql_styles(_R3)})")
def _r3(spark, sf):
    size = F.col("size")
    two = F.lpad(size.cast("string"), 3, "0")
    out = _styles(_parts(spark, sf), {
        "last": _c("First 9.\nWe see 4 then ", size), "said": _c("the answer is about ", size, " of 99 units"), "comma": _c("x\n1,", two),
        "negative": _c("moved by -", size), "power": _c("area ", "x m^2, near ", size, " here"), "listing": _c("seen at 1, 2, 3, 4, ", size),
        "frame": _c("frame 3, ", size), "junk_tail": _c("about ", size, " cm\nImage 3: kitchen"), "terse_junk": _c(size, "\n1. Kitchen"),
        "version": _c("see part", size), "decimal": _c("near ", size, ".5 m"),
    })
    return out.select("id", "style", sc.number_lastline(F.col("response")).alias("parsed"))


_R4 = {
    "first_token": "letter || ':'", "word_boundary": "letter", "first_af": "'B'", "priority": "letter", "listed": "letter", "unwrapped": "letter", "leading": "letter",
    "strict_option": "letter", "boxed_lastline": "letter",
}


@register("r4_option_parsers", "id:l parser:s parsed:s", f"WITH {_P} SELECT id, style AS parser, parsed FROM ({_sql_styles(_R4)})")
def _r4(spark, sf):
    p = _parts(spark, sf)
    letter = F.col("letter")
    texts = {
        "first_token": _c(letter, ":. is it"), "word_boundary": _c("The best answer is Based on (", letter, ")"), "first_af": _c("Based on ", letter),
        "priority": _c("Maybe A. or\nAnswer: ", letter, ". the one"), "listed": _c("Option ", F.lower(letter), " seems fine"),
        "unwrapped": _c("so `", letter, "` it is"), "leading": _c(" (", F.lower(letter), ") because"), "strict_option": _c("Based on it, ", letter, "!"),
        "boxed_lastline": _c("Maybe D\n\\boxed{", letter, "} and more text\nImage 3: x"),
    }
    parts = [p.select("id", F.lit(n).alias("parser"), sc.option_parse(t, n).alias("parsed")) for n, t in texts.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("r5_relative_accuracy", "pos:l exact:d absolute:d", f"""
WITH {ROLLOUT_SQL}, x AS (SELECT pos, score + (k % 13) - 6 AS p, CASE WHEN k % 9 = 0 THEN 0.0::DOUBLE ELSE score END AS g FROM rollouts)
SELECT pos, {_mra('p', 'g')} AS exact, CASE WHEN g = 0 THEN len(list_filter({_TH}, lambda th: abs(p - g) <= 1 - th)) / 10.0::DOUBLE ELSE {_mra('p', 'g')} END AS absolute FROM x""")
def _r5(spark, sf):
    p, g = F.col("score") + F.col("k") % 13 - 6, F.when(F.col("k") % 9 == 0, 0.0).otherwise(F.col("score"))
    return rollouts(spark, sf).select("pos", sc.relative_accuracy(p, g).alias("exact"), sc.relative_accuracy(p, g, "absolute").alias("absolute"))


def _abs_mra(p: str, g: str) -> str:
    return f"len(list_filter({_TH}, lambda th: CASE WHEN {g} = 0 THEN abs({p} - {g}) ELSE abs({p} - {g}) / abs({g}) END <= 1 - th)) / 10.0::DOUBLE"


@register("r6_action_vector", "pos:l score:d broken:d", f"""
WITH {ROLLOUT_SQL}, x AS (SELECT pos, (k % 5)::DOUBLE AS a, (k % 7)::DOUBLE AS b, (length % 5)::DOUBLE AS ga, (length % 7)::DOUBLE AS gb FROM rollouts)
SELECT pos, ({_abs_mra('ga', 'a')} + {_abs_mra('(0 - gb)', '(0 - b)')} + {_abs_mra('1', '2')} + 1.0 + 1.0) / 5 AS score, 0 AS broken FROM x""")
def _r6(spark, sf):
    k, ln = F.col("k"), F.col("length")
    pred = _c("move_right:", k % 5, ",move_down:", k % 7, ",move_forward:2")
    gold = _c("move_right:", ln % 5, ",move_down:", ln % 7, ",move_forward:1")
    return rollouts(spark, sf).select(
        "pos", sc.action_vector_mra(pred, gold).alias("score"), sc.action_vector_mra(_c("move_right:", k, ",oops"), gold).alias("broken"))


@register("r6_coordinate_distance", "pos:l dist:d", f"""
WITH {ROLLOUT_SQL} SELECT pos, sqrt(pow((k - length) / 1000.0::DOUBLE, 2) + pow((k % 5) - (length % 5), 2) + pow((k % 3) - (k % 4), 2)) AS dist FROM rollouts""".replace(
    "pow((k % 5) - (length % 5), 2)", "pow(((k % 5) - (length % 5)) / 1000.0::DOUBLE, 2)"))
def _r6c(spark, sf):
    k, ln = F.col("k"), F.col("length")
    return rollouts(spark, sf).select("pos", sc.coordinate_distance(
        _c("(", k, ",", k % 5, "),", k % 3), _c("(", ln, ",", ln % 5, "),", k % 4)).alias("dist"))


@register("r7_template_score", "id:l style:s family:s gold_parsed:l answered:l score:d", f"""
WITH {_P}, e AS (
  SELECT id, 'numeric' AS style, 'numeric' AS family, 1 AS gold_parsed, 1 AS answered, {_mra('size', '10')} AS score FROM pr
  UNION ALL SELECT id, 'numeric_word', 'numeric', 1, 1, {_mra('3', '4')} FROM pr
  UNION ALL SELECT id, 'direction', 'direction', 1, 1, CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END FROM pr
  UNION ALL SELECT id, 'direction_partial', 'direction', 1, 1, 0 FROM pr
  UNION ALL SELECT id, 'direction_clash', 'direction', 0, 0, 0 FROM pr
  UNION ALL SELECT id, 'yesno', 'yesno', 1, 1, CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END FROM pr
  UNION ALL SELECT id, 'compare', 'compare_pair', 1, 1, CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END FROM pr
  UNION ALL SELECT id, 'compare_name', 'compare_set', 1, 1, 1 FROM pr
  UNION ALL SELECT id, 'bev', 'bev', 1, 1, CASE WHEN size % 2 = 0 THEN 1.0 ELSE 0.5 END FROM pr
  UNION ALL SELECT id, 'unread', 'numeric', 1, 0, 0 FROM pr)
SELECT * FROM e""")
def _r7(spark, sf):
    size = F.col("size")
    even = size % 2 == 0
    left = F.when(even, "left").otherwise("right")
    rows = {
        "numeric": ("numeric", F.lit("The depth is 10 meters."), _c("It lies at 3 there.\nThus the depth is ", size, " meters"), F.lit("")),
        "numeric_word": ("numeric", F.lit("4"), F.lit("I count three"), F.lit("")),
        "direction": ("direction", F.lit("It is to the left and above. It is in front of the observer."), _c("Long talk on the right.\nTherefore it is ", left, " and above."), F.lit("")),
        "direction_partial": ("direction", F.lit("left and above"), F.lit("It is left"), F.lit("")),
        "direction_clash": ("direction", F.lit("left, or was it right"), F.lit("left"), F.lit("")),
        "yesno": ("direction", F.lit("Yes"), _c("well ", F.when(size % 3 == 0, "yes").otherwise("no")), F.lit("")),
        "compare": ("compare_pair", F.lit("The sofa (green point) is closer."), _c("The ", F.when(even, "blue").otherwise("green"), " point is farther."),
                    F.lit("Which is closer: sofa (green point) or lamp (blue point)?")),
        "compare_name": ("compare_set", F.lit("Object2 is the farthest."), F.lit("Therefore, the sofa chair is the farthest"),
                         F.lit("Which is farthest: lamp (point 1), sofa chair (point 2) or desk (point 3)?")),
        "bev": ("bev", F.lit("Object1: (1.0, 2.0) Object2: (3.0, 4.0)"), _c("Object1: (1.2, 2.1), Object2: (", F.when(even, "3.1").otherwise("9.0"), ", 4.0)"), F.lit("")),
        "unread": ("numeric", F.lit("10"), F.lit("cannot say"), F.lit("")),
    }
    p = _parts(spark, sf).select("id", "size")
    entries = [F.struct(F.lit(n).alias("style"), F.lit(f).alias("family"), g.alias("gold"), r.alias("response"), q.alias("question"),
                        (F.lit(n) == "numeric").alias("metric"), F.lit(False).alias("depth")) for n, (f, g, r, q) in rows.items()]
    return sc.template_score(p.select("id", F.inline(F.array(*entries))))


@register("r8_score_rows", "id:l data_source:s score:d answered:l boxed_present:l", f"""
WITH {_P}, e AS (
  SELECT id, 'choice/a' AS ds, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS score, 1 AS answered, 1 AS bx FROM pr
  UNION ALL SELECT id, 'listed/b', 1, 1, 0 FROM pr
  UNION ALL SELECT id, 'mixed/na', {_mra('size', '12')}, 1, 0 FROM pr
  UNION ALL SELECT id, 'mixed/mca', 0, 0, 0 FROM pr
  UNION ALL SELECT id, 'pool', {_mra('size', '20')}, 1, 0 FROM pr
  UNION ALL SELECT id, 'pool_letter', 1, 1, 0 FROM pr
  UNION ALL SELECT id, 'choice/empty', 0, 0, 0 FROM pr)
SELECT id, ds AS data_source, score, answered, bx AS boxed_present FROM e""")
def _r8(spark, sf):
    letter, size = F.col("letter"), F.col("size")
    other = F.translate(letter, "ABCD", "BCDA")
    rows = {
        "choice/a": ("mca", _c("so \\boxed{", F.when(F.col("id") % 3 == 0, letter).otherwise(other), "}"), letter),
        "listed/b": ("mca", _c("Answer: ", letter), letter), "mixed/na": ("na", _c("total is ", size), F.lit("12")),
        "mixed/mca": ("mca", F.lit("cannot tell"), letter), "pool": ("", _c(size, " units"), F.lit("20")),
        "pool_letter": ("", _c("option ", F.lower(letter)), letter), "choice/empty": ("mca", F.lit("  "), letter),
    }
    entries = [F.struct(F.lit(n).alias("data_source"), F.lit(k).alias("kind"), r.alias("response"), g.alias("gold")) for n, (k, r, g) in rows.items()]
    df = _parts(spark, sf).select("id", "opts", F.inline(F.array(*entries)))
    return sc.score_rows(df, {"choice/": "option", "listed/": "priority", "mixed/": "mixed"}, options="opts", kind="kind")


_NORM = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower({}), '[[:punct:]]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+'), lambda w: w <> ''), ' ')"


@register("r9_qa_match", "id:l em:b sub:b tagged:s anls:d", f"""
WITH {_P}, q AS (SELECT id, 'The ' || upper(name) || ', indeed!' AS pred, [name || ' indeed', type] AS gs, 'x <answer> ' || name || ' </answer> y' AS t, name FROM pr)
SELECT id, {_NORM.format('pred')} = {_NORM.format("gs[1]")} OR {_NORM.format('pred')} = {_NORM.format("gs[2]")} AS em, contains({_NORM.format('pred')}, {_NORM.format("gs[1]")}) OR contains({_NORM.format('pred')}, {_NORM.format("gs[2]")}) AS sub,
 name AS tagged, CASE WHEN 1 - levenshtein(name || ' x', name)::DOUBLE / (length(name) + 2) < 0.5 THEN 0 ELSE 1 - levenshtein(name || ' x', name)::DOUBLE / (length(name) + 2) END AS anls FROM q""")
def _r9(spark, sf):
    p = _parts(spark, sf)
    name = F.col("name")
    pred = _c("The ", F.upper(name), ", indeed!")
    golds = F.array(_c(name, " indeed"), F.col("type"))
    return p.select(
        "id", sc.exact_any(pred, golds).alias("em"), sc.contains_any(pred, golds).alias("sub"),
        sc.tagged_answer(_c("<answer>no</answer> x <answer> ", name, " </answer> y")).alias("tagged"),
        sc.anls(_c(name, " x"), F.array(name)).alias("anls"),
    )


@register("r10_number_answer", "id:l strict:s flexible:s reward:d", f"""
WITH {_P} SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(size * 1000 AS VARCHAR) END AS strict, CASE WHEN id % 5 = 0 THEN CAST(size AS VARCHAR) ELSE size || ',000' END AS flexible,
 CASE WHEN id % 5 = 0 THEN 0 WHEN size = 30 THEN 1 ELSE 0.1 END AS reward FROM pr""")
def _r10(spark, sf):
    size = F.col("size")
    text = F.when(F.col("id") % 5 == 0, _c("so it is ", size, " . ")).otherwise(_c(F.repeat(F.lit("#### 7 pad "), 40), "#### ", size, ",000"))
    return _parts(spark, sf).select(
        "id", sc.hash_answer(text).alias("strict"), sc.hash_answer(text, "flexible").alias("flexible"),
        sc.hash_reward(text, F.lit("30000"), format_score=0.1).alias("reward"))


@register("r11_answer_rewards", "id:l line:d strict_box:d math:d fmt:d mixed:d", f"""
WITH {_P} SELECT id, CASE WHEN size = 12 OR size % 4 = 0 THEN CASE WHEN size % 4 = 0 THEN 1 ELSE -1 END ELSE -1 END AS line, CASE WHEN size % 2 = 0 THEN 1 ELSE -1 END AS strict_box,
 1 AS math, 0.9 + CASE WHEN size % 2 = 0 THEN 0.1 ELSE 0 END AS fmt, CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END AS mixed FROM pr""")
def _r11(spark, sf):
    size = F.col("size")
    even = size % 2 == 0
    line = F.when(size % 4 == 0, _c("Answer: 3\nAnswer: $x = ", size, "$ cm")).otherwise(_c("no line ", size))
    box = F.when(even, _c("\\boxed{", size, "}")).otherwise(_c("\\boxed{", size, ".0}"))
    frac = _c(F.when(even, "<think>t</think> ").otherwise(""), "\\boxed{", size, "/7}")
    gold = _c("\\frac{", size, "}7")
    return _parts(spark, sf).select(
        "id", sc.answer_line_reward(line, size.cast("string")).alias("line"), sc.strict_box_reward(box, size.cast("string")).alias("strict_box"),
        sc.boxed_math_reward(_c("\\boxed{\\dfrac", (size % 10), "7}"), _c("\\frac{", (size % 10), "}{7}")).alias("math"),
        sc.format_mix_reward(F.replace(frac, F.lit("/7"), F.lit(" / 7")), F.replace(_c(size, "/7"), F.lit(" "), F.lit(""))).alias("fmt"),
        F.when(F.lit(True), sc.letter_number_text_reward(_c("<answer>", F.when(even, size).otherwise(size + 1), " m</answer>"), size.cast("string"), F.lit(False))).alias("mixed"),
    )


@register("r12_filter_chains", "id:l strict:s mapped:s vote:s choice:s first:s", f"""
WITH {_P}, k AS (SELECT id, [size, size + id % 4, id % 5, size] AS ks FROM pr), m AS (SELECT id, ks, list_transform(ks, lambda x: x % 4) AS ms FROM k),
c AS (SELECT id, v, count(*) AS c, min(i) AS p FROM (SELECT id, unnest(ms) AS v, unnest(range(1, 5)) AS i FROM m) GROUP BY ALL),
v AS (SELECT id, 'n' || v AS vote FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, p) = 1)
SELECT m.id, array_to_string(ks, ',') AS strict, array_to_string(list_transform(ms, lambda x: CASE x WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END), ',') AS mapped, vote,
 array_to_string(list_transform(ms, lambda x: CASE x WHEN 0 THEN '(A)' WHEN 1 THEN '(B)' ELSE '[invalid]' END), ',') AS choice, ks[1] || ',' || ks[2] AS first FROM m JOIN v ON m.id = v.id""")
def _r12(spark, sf):
    size, i = F.col("size"), F.col("id")
    ks = F.array(size.cast("bigint"), size + i % 4, i % 5, size.cast("bigint"))
    df = _parts(spark, sf).select("id", F.transform(ks, lambda k: _c(" N", k % 4, " x #### ", k)).alias("resps"))
    df = df.withColumn("choices", F.array(F.lit("n0"), F.lit("N1")))
    chains = {
        "strict": [("regex", {})],
        "mapped": [("remove_whitespace", {}), ("regex", {"pattern": r"^(N\d)"}), ("map", {"mapping": {"N0": "zero", "N1": "one"}, "default": "many"})],
        "vote": [("regex", {"pattern": r"(N\d)"}), ("lowercase", {}), ("majority_vote", {})],
        "choice": [("choice_text", {"choices": F.col("choices"), "pattern": r"@@(\d)", "ignore_case": True})],
        "first": [("take_first_k", {"k": 2}), ("regex", {})],
    }
    out = sc.apply_filters(df, chains)
    return out.select("id", *[F.array_join(c, ",").alias(c) for c in chains])


@register("r13_failure_tag", "tag:s trust:s n:l", f"""
WITH {EVAL_SQL}, x AS (SELECT CASE WHEN score >= 1 AND extra = 1 THEN 'judge_recovered' WHEN score >= 1 THEN 'correct' WHEN truncated = 1 THEN 'truncation_error' WHEN answered = 0 THEN 'parse_error' WHEN score > 0 THEN 'partial_error' ELSE 'factual_error' END AS tag,
 CASE extra WHEN 0 THEN 'boxed' WHEN 1 THEN 'terse' WHEN 2 THEN 'mca_tail' ELSE '' END AS trust FROM evals) SELECT tag, trust, count(*) AS n FROM x GROUP BY ALL""")
def _r13(spark, sf):
    x, pred = F.col("extra"), F.col("pred")
    resp = F.when(x == 0, _c("\\boxed{", pred, "}")).when(x == 1, _c("thus\n", F.translate(pred, "E", "D"))).when(x == 2, _c("x\n(A)")).otherwise("no idea at all")
    opts = F.array(*[F.lit(f"{c}. option {c.lower()}") for c in "ABCD"])
    e = evals(spark, sf, spread=True)
    return e.select(
        sc.failure_tag(F.col("score"), F.col("truncated") == 1, F.col("answered") == 1, x == 1).alias("tag"),
        sc.trust_label(resp, opts, F.lit(True)).alias("trust"),
    ).groupBy("tag", "trust").agg(F.count(F.lit(1)).alias("n"))


@register("r14_verdict", "pos:l verdict:s off:b", f"""
WITH {ROLLOUT_SQL} SELECT pos, CASE k % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' WHEN 3 THEN 'UNPARSED' WHEN 4 THEN 'UNPARSED' ELSE 'No' END AS verdict, k % 6 <> 1 AS off FROM rollouts""")
def _r14(spark, sf):
    texts = ["**Yes**, the response is right", " no ", "I would say it is correct: yes", "either yes or no", "", "after much thought, no."]
    reply = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("k") % 6).cast("int"))
    return rollouts(spark, sf).select("pos", sc.verdict(reply).alias("verdict"), sc.off_protocol(reply).alias("off"))


@register("r15_eval_rewards", "data_source:s test_score:d rows:l", f"""
WITH {_P}, r AS (SELECT type, (CASE WHEN size % 4 = id % 3 THEN 1 ELSE 0 END + CASE WHEN id % 5 = id % 3 THEN 1 ELSE 0 END + CASE WHEN 1 = id % 3 THEN 1 ELSE 0 END) / 3.0::DOUBLE AS m FROM pr)
SELECT type AS data_source, avg(m) AS test_score, count(*) AS rows FROM r GROUP BY type""")
def _r15(spark, sf):
    responses = F.array(_c("so #### ", F.col("size") % 4), _c("#### ", F.col("id") % 5), F.lit("#### 1"))
    p = _parts(spark, sf).select(F.col("type").alias("data_source"), responses.alias("responses"), (F.col("id") % 3).cast("string").alias("gold"))
    return sc.eval_rewards(p, sc.hash_reward)


@register("r16_row_hash", "doc_id:l doc_hash:s", """
SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS doc_hash FROM documents""")
def _r16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sc.row_hash("doc_id", "lang", "source").alias("doc_hash"))




@register("r9_vqa_form", "id:l answer:s", f"""
WITH {_P} SELECT id, CASE id % 4 WHEN 0 THEN name || ' 3' WHEN 1 THEN 'left right ' || name WHEN 2 THEN 'don''t ' || name ELSE size || '.5 ' || type_l END AS answer FROM (SELECT *, lower(type) AS type_l FROM pr)""")
def _r9v(spark, sf):
    name = F.col("name")
    k = F.col("id") % 4
    text = (F.when(k == 0, _c("The ", F.upper(name), ", three.")).when(k == 1, _c("left/right; a ", name, "!"))
            .when(k == 2, _c("dont ", name, "?")).otherwise(_c("an ", F.col("size"), ".5 (", F.col("type"), ")")))
    return _parts(spark, sf).select("id", vqa_form(text).alias("answer"))


@register("spec_task_evaluation", "task:s metric:s value:d stderr:d8 size:l", f"""
WITH {_P}, t AS (SELECT 'sizes' AS task, CASE WHEN size % 4 = id % 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, (size % 4)::DOUBLE AS digit FROM pr WHERE size > 5),
m AS (SELECT task, 'exact' AS metric, em AS v FROM t UNION ALL SELECT task, 'digit', digit FROM t),
r AS (SELECT task, metric, avg(v) AS value, stddev_samp(v) / sqrt(count(*)) AS stderr, count(*) AS size FROM m GROUP BY ALL)
SELECT * FROM r UNION ALL SELECT 'all', metric, value, stderr, size FROM r""")
def _spec(spark, sf):
    docs = _parts(spark, sf).withColumnRenamed("id", "doc_id").withColumn("gold", (F.col("doc_id") % 4).cast("string"))
    resp = docs.select("doc_id", F.array(_c("so #### ", F.col("size") % 4), F.lit("#### 9")).alias("resps"))
    task = sp.TaskSpec(
        "sizes", ["exact", "digit"],
        lambda df: df.withColumn("exact", sc.exact_match(F.get("strict", F.lit(0)), F.col("gold"))).withColumn(
            "digit", F.get("strict", F.lit(0)).cast("double")),
        process_docs=lambda df: df.filter("size > 5"), filters={"strict": [("regex", {}), ("take_first", {})]},
    )
    results = sp.evaluate(task, docs, resp)
    groups = sp.evaluate_groups(sp.GroupSpec({"all": {"sizes": None}}), results)
    flat = groups.select(F.col("group").alias("task"), "metric", "value", "stderr", F.col("samples").alias("size"))
    return results.select("task", "metric", "value", "stderr", "size").unionByName(flat)
