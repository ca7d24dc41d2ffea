"""Response parsing and row scores as column expressions (survey rows R1-R16).

Parsers return null when nothing can be read, so an unreadable answer never looks like a wrong one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.arrays import let
from scoreloom.functions.text import strip_thinking, trim_all, words

# Answer formats. Each pattern has to agree with the published scores letter for letter.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
ANSWER_LETTER = (
    r"(?i)(?:(?:final\s+)?(?:answer|option|choice|selection)\s*(?:is|:|=|would\s+be)?\s*|would\s+be\s+"
    r"|(?:I\s+)?(?:choose|pick|select)\s+|(?:I\s+)?go\s+with\s+|(?<![A-Za-z])(?:so|thus|therefore|hence)\s+)"
    r"[\*\s]*\(?\s*([A-Z])\s*\)?(?![A-Za-z])"
)
WHOLE_PAREN = r"^\(\s*([A-Za-z])\s*\)$"
NUMBER = r"(?U)(?<![\w.])(?<!\w-)(?<!\^)(?<!\^\{)[-+]?\d[\d,]*(?:\.\d+)?(?!\d)(?!\.\d)"
ANSWER_NUMBER = (
    r"(?i)(?:final\s+)?(?:answer|value|result|estimate|count|total|distance|size|area)\s*(?:is|:|=|of)?\s*"
    r"(?:about|approximately|around|roughly|~)?\s*[\*\s]*([-+]?\d[\d,]*(?:\.\d+)?)"
)
JUNK_LINE = r"(?i)^\s*[\*\-\u2022]?\s*Image\s+\d+\s*[:.]|^\s*[\*\-\u2022]?\s*\d+\.\s"
TERSE_NUMBER = r"^[-+]?\d[\d,]*(?:\.\d+)?$"
TERSE_LETTER = r"(?i)^[A-F]$"
LETTER_AND_BODY = r"(?i)^\s*([A-F])\s*[.):]\s*(.*?)\s*$"
FRAME_LIST = r"(?i)\bframes?\s+\d"
ENUMERATION_MIN = 5
MRA_THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.8999999999999999, 0.95)
TEX_WRAPPER = r"\\(?:text|textbf|mathrm|mathbf|operatorname)\s*\{([^{}]*)\}"
TEX_DEGREE = r"\^\s*\{?\s*\\circ\s*\}?"
TEX_FRACTION = r"\\d?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}"
TEX_SPACING = r"\\[,;:!]|\\\s|~|\$|\\left|\\right"
PLAIN_RATIO = r"^\s*([-+]?\d+(?:\.\d+)?)\s*/\s*([-+]?\d+(?:\.\d+)?)\s*$"
ANSWER_PREFIXES = (
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option is",
    "The correct option is",
    "Best answer:",
    "Best option:",
)
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def last_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def to_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_BREAK), trim_all), lambda x: x != "")


def boxed(text: Column) -> Column:
    """Content of the last ``\\boxed{...}`` if its braces balance (R1); null for none or an unclosed one."""
    tail = F.substring_index(text, "\\boxed{", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        closes = (depth == 0) & (acc["end"] < 0)
        return F.struct(
            depth.alias("depth"), (acc["at"] + 1).alias("at"), F.when(closes, acc["at"]).otherwise(acc["end"]).alias("end")
        )

    end = F.aggregate(F.split(tail, ""), start, step, lambda acc: acc["end"])
    content = let(end, lambda e: F.when(e >= 0, F.substring(tail, F.lit(1), e)))
    return F.when(F.instr(text, "\\boxed{") > 0, content)


def _number_text(value: Column) -> Column:
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def normalise_boxed(content: Column) -> Column:
    """Box content without LaTeX decoration: wrappers opened, fractions written with a slash, a plain ratio divided."""
    t = content
    for _ in range(3):
        t = F.regexp_replace(t, TEX_WRAPPER, "$1")
    t = F.regexp_replace(t, TEX_DEGREE, " ")
    t = F.regexp_replace(t, TEX_FRACTION, "$1/$2")
    t = F.regexp_replace(t, TEX_SPACING, " ")
    t = trim_all(F.replace(t, F.lit("\\%"), F.lit("%")))

    def divide(x: Column) -> Column:
        top, bottom = F.regexp_extract(x, PLAIN_RATIO, 1).try_cast("double"), F.regexp_extract(x, PLAIN_RATIO, 2).try_cast("double")
        q = F.try_divide(top, bottom)
        return F.when(x.rlike(PLAIN_RATIO) & q.isNotNull(), _number_text(q)).otherwise(x)

    return let(t, divide)


def box_or_text(text: Column, enabled: bool = True) -> Column:
    """The normalised box when a closed one exists, else the whole response."""
    return F.coalesce(normalise_boxed(boxed(text)), text) if enabled else text


def answer_line(text: Column) -> Column:
    """Last line that is neither an image label nor an outline heading; null when there is none."""
    lines = lines_of(trim_all(strip_thinking(F.coalesce(text, F.lit("")))))
    return F.try_element_at(F.filter(lines, lambda x: ~x.rlike(JUNK_LINE)), F.lit(-1))


def ends_in_junk(text: Column) -> Column:
    lines = lines_of(trim_all(strip_thinking(F.coalesce(text, F.lit("")))))
    return F.coalesce(F.try_element_at(lines, F.lit(-1)).rlike(JUNK_LINE), F.lit(False))


def allowed_letters(options: Column | None) -> Column:
    if options is None:
        return F.lit(LETTERS[:6])
    n = F.coalesce(F.size(options), F.lit(0))
    return F.substring(F.lit(LETTERS), F.lit(1), F.when(n < 1, F.lit(6)).otherwise(F.least(n, F.lit(26))))


def option_bodies(options: Column) -> Column:
    """(letter, text) of each option; entries without a letter mark take theirs from the position."""
    mark = r"(?s)^\s*([A-Za-z])\s*[.):]\s*(.*)$"
    return F.transform(options, lambda raw, i: F.struct(
        F.when(raw.rlike(mark), F.upper(F.regexp_extract(raw, mark, 1)))
        .otherwise(F.substring(F.lit(LETTERS), i + 1, F.lit(1))).alias("letter"),
        F.when(raw.rlike(mark), trim_all(F.regexp_extract(raw, mark, 2))).otherwise(trim_all(raw)).alias("body"),
    ))


def match_body(line: Column, options: Column) -> Column:
    """Letter of the one option whose text equals the line, or is the only one contained in it."""
    low = F.lower(line)

    def pick(bodies: Column) -> Column:
        exact = F.filter(bodies, lambda b: (b["body"] != "") & (F.lower(b["body"]) == low))
        inside = F.filter(bodies, lambda b: (b["body"] != "") & F.contains(low, F.lower(b["body"])))
        return F.when(F.size(exact) == 1, F.get(exact, F.lit(0))["letter"]).when(
            F.size(inside) == 1, F.get(inside, F.lit(0))["letter"]
        )

    return let(option_bodies(options), pick)


def verdict_line(line: Column, options: Column | None) -> Column:
    """Option letter if the line is nothing but a verdict (R2): a letter, (letter), letter with its own body, or a body."""
    ok = allowed_letters(options)
    inside = lambda letter: F.when(F.contains(ok, letter), letter)
    whole = F.upper(F.regexp_extract(line, WHOLE_PAREN, 1))
    letter = F.upper(F.regexp_extract(line, LETTER_AND_BODY, 1))
    body = trim_all(F.regexp_extract(line, LETTER_AND_BODY, 2))
    if options is None:
        with_body, free = F.lit(None).cast("string"), F.lit(None).cast("string")
    else:
        own = let(option_bodies(options), lambda bs: F.try_element_at(
            F.transform(F.filter(bs, lambda b: b["letter"] == letter), lambda b: b["body"]), F.lit(-1)))
        with_body = let(own, lambda expected: F.when(
            (body == "") & expected.isNotNull(), letter
        ).when((expected != "") & (F.lower(body) == F.lower(expected)), letter))
        with_body = F.when(F.contains(ok, letter), with_body)
        free = match_body(line, options)
    return (
        F.when(line.rlike(TERSE_LETTER), inside(F.upper(line)))
        .when(line.rlike(WHOLE_PAREN), inside(whole))
        .when(line.rlike(LETTER_AND_BODY), with_body)
        .otherwise(free)
    )


def option_lastline(response: Column, options: Column | None = None) -> Column:
    """Selected option read from the last meaningful line (R2); null when none can be read."""
    ok = allowed_letters(options)

    def read(line: Column) -> Column:
        said = F.filter(
            F.transform(F.regexp_extract_all(line, F.lit(ANSWER_LETTER), F.lit(1)), F.upper), lambda x: F.contains(ok, x)
        )
        return F.coalesce(F.try_element_at(said, F.lit(-1)), verdict_line(line, options))

    return let(answer_line(response), read)


def number_lastline(response: Column) -> Column:
    """Answer number (R3): the last announced number of the line, else its last number unless the line is a listing."""
    junk = ends_in_junk(response)

    def read(line: Column) -> Column:
        said = to_number(last_group(line, ANSWER_NUMBER))
        numbers = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0))
        count = F.size(numbers)
        terse = line.rlike(TERSE_NUMBER)
        listing = ~terse & ((count >= ENUMERATION_MIN) | (line.rlike(FRAME_LIST) & (count >= 2)))
        plain = F.when(~(junk & ~terse) & ~listing, to_number(F.try_element_at(numbers, F.lit(-1))))
        return F.coalesce(said, plain)

    return let(answer_line(response), read)


def is_terse(response: Column) -> Column:
    """The whole response, or its last line, is a lone number or letter."""
    clean = trim_all(strip_thinking(F.coalesce(response, F.lit(""))))
    last = F.try_element_at(lines_of(clean), F.lit(-1))
    lone = lambda x: x.rlike(TERSE_NUMBER) | x.rlike(TERSE_LETTER)
    return F.coalesce(lone(clean) | lone(last), F.lit(False))


def _share_met(error: Column) -> Column:
    hits = sum(((error <= F.lit(1 - t)).cast("int") for t in MRA_THRESHOLDS), F.lit(0))
    return hits / F.lit(float(len(MRA_THRESHOLDS)))


def relative_accuracy(pred: Column, gold: Column, at_zero: str = "exact") -> Column:
    """Share of the ten thresholds met by the relative error.

    A gold of 0 counts as met only by 0 (``exact``), by its absolute error (``absolute``), or never (``undefined``: null).
    """
    error = F.abs(pred - gold) / F.abs(F.nullif(gold, F.lit(0.0)))
    if at_zero == "absolute":
        error = F.when(gold == 0, F.abs(pred - gold)).otherwise(error)
    score = _share_met(error)
    return F.when(gold == 0, (pred == 0).cast("double")).otherwise(score) if at_zero == "exact" else score


# The five signed axes of an action vector.
ACTION_AXES = (
    ("move_right", "move_left"),
    ("move_up", "move_down"),
    ("move_forward", "move_backward"),
    ("rotate_right", "rotate_left"),
    ("rotate_up", "rotate_down"),
)


def _action_axes(text: Column) -> Column:
    """The five signed axes of an action list, null when an entry cannot be read; a repeated key takes its last value."""
    entries = F.transform(F.split(text, ","), lambda item: F.struct(
        trim_all(F.substring_index(item, ":", 1)).alias("k"),
        F.when(F.size(F.split(item, ":")) == 2, F.trim(F.substring_index(item, ":", -1)).try_cast("double")).alias("v"),
    ))

    def axes(found: Column) -> Column:
        at = lambda key: F.coalesce(
            F.try_element_at(F.filter(found, lambda e: e["k"] == key), F.lit(-1))["v"], F.lit(0.0))
        return F.when(
            ~F.exists(found, lambda e: e["v"].isNull()), F.array(*[at(a) - at(b) for a, b in ACTION_AXES])
        )

    return let(entries, axes)


def action_vector_mra(pred: Column, gold: Column) -> Column:
    """Mean accuracy over five signed axes of ``key:value`` lists (R6), relative to the predicted value; 0 if unreadable."""
    errors = F.zip_with(_action_axes(pred), _action_axes(gold), lambda p, g: F.when(p == 0, F.abs(g - p)).otherwise(
        F.abs(g - p) / F.abs(F.nullif(p, F.lit(0.0)))))
    total = F.aggregate(F.transform(errors, _share_met), F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(total / len(ACTION_AXES), F.lit(0.0))


def coordinate_distance(pred: Column, gold: Column) -> Column:
    """Distance of ``(x,y),z`` answers with x and y on a 0-1000 scale (R6); missing parts count as 0, null if unreadable."""
    pair = r"\(([0-9.]+),([0-9.]+)\)"

    def part(text: Column, i: int) -> Column:
        xy = F.when(text.rlike(pair), F.regexp_extract(text, pair, i + 1 if i < 2 else 1).try_cast("double"))
        loose = F.regexp_extract(F.regexp_replace(text, pair, " "), r"([0-9.]+)", 1).try_cast("double")
        if i < 2:
            return F.coalesce(xy, F.lit(0.0)) / 1000
        return F.coalesce(loose, F.lit(0.0))

    readable = lambda t: t.rlike(r"[0-9.]+")
    total = sum((F.pow(part(pred, i) - part(gold, i), F.lit(2.0)) for i in range(3)), F.lit(0.0))
    return F.when(readable(pred) & readable(gold), F.sqrt(total))


def _without_prefixes(text: Column) -> Column:
    out = trim_all(text)
    for prefix in ANSWER_PREFIXES:
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return out


def _first_token(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.substring_index(text, " ", 1), r"\.+$", ""))


def _word_boundary(text: Column) -> Column:
    clean = _without_prefixes(text)
    return F.coalesce(first_group(clean, r"\(([A-F])\)"), first_group(clean, r"(?<![A-Za-z])([A-F])(?![A-Za-z])"))


def _first_letter(text: Column, span: str = "A-F") -> Column:
    return first_group(_without_prefixes(text), f"([{span}])")


# Patterns tried in order, the last match of the first one that hits.
SECTION_PATTERNS = (
    r"[Mm]y answer is ([A-E])",
    r"[Tt]he answer is ([A-E])",
    r"(?:Answer: )?([A-E])\.",
    r"\b([A-E])\b",
)
PRIORITY_PATTERNS = (
    r"(?:Answer: )?([A-E])\. [A-Za-z0-9 \-\(\)'\",]+(?=(?:\n|$|\.|\"))",
    r"(?:Answer: )?([A-E])\. [A-Za-z0-9 \-\(\)'\"]+",
    r"(?:^|\n)(?:Answer: )?([A-E])(?:\.|$|\s)",
    r"[\*\"]([A-E])[\*\"]",
    r"\bAnswer:?\s*([A-E])\b",
    r"[Mm]y answer is ([A-E])",
    r"answer is ([A-E])",
)
LIST_PATTERNS = (
    r"(?i)\(([A-E])\)",
    r"(?i)Answer\s*[:=]\s*['\"]?([A-E])['\"]?",
    r"(?i)Ans\s*=\s*['\"]?([A-E])['\"]?",
    r"(?i)Option\s+([A-E])",
    r"(?i)\b([A-E])\s*(?:is|was)\s*correct\b",
    r"(?im)\b([A-E])[\.\)]\s*$",
    r"\b([A-E])\b",
)


def _priority(text: Column) -> Column:
    section = first_group(text, r"(?s)<Answer>(.*?)(?:<|$)")
    in_section = F.coalesce(*[last_group(section, p) for p in SECTION_PATTERNS])
    anywhere = F.coalesce(*[last_group(text, p) for p in PRIORITY_PATTERNS])
    lines = F.split(text, "\n")
    lone = F.transform(F.filter(lines, lambda x: x.rlike(r"\b[A-E]\b")), lambda x: F.regexp_extract(x, r"\b([A-E])\b", 1))
    return F.coalesce(last_group(text, r"([A-E])\."), in_section, anywhere, F.try_element_at(lone, F.lit(-1)))


def _listed(text: Column) -> Column:
    tail = F.right(F.upper(trim_all(text)), F.lit(1))
    return F.coalesce(*[F.upper(first_group(text, p)) for p in LIST_PATTERNS], F.when((tail != "") & F.contains(F.lit("ABCDE"), tail), tail))


def _unwrapped(text: Column) -> Column:
    out = text
    for p in (r"``([^`]*)``", r"`([^`]*)`", r"\{([^}]*)\}"):
        out = F.coalesce(first_group(out, p), out)
    return first_group(out, r"(\b[A-D]\b(?!\s[a-zA-Z]))")


def _judge_option(text: Column, strict: bool) -> Column:
    last = first_group(text, r"(?<![A-Za-z])([A-F])(?![A-Za-z])") if strict else first_group(text, r"([A-Z])")
    return F.coalesce(first_group(text, r"\(([A-Z])\)"), first_group(text, r"([A-Z])[\.\)\s]"), last)


OPTION_PARSERS: dict[str, Callable[[Column], Column]] = {
    "first_token": _first_token,
    "word_boundary": _word_boundary,
    "first_af": lambda t: _first_letter(t, "A-F"),
    "first_ad": lambda t: _first_letter(t, "A-D"),
    "priority": _priority,
    "listed": _listed,
    "unwrapped": _unwrapped,
    "leading": lambda t: F.upper(first_group(trim_all(t), r"(?i)^[\(\s]*([A-Z])[\)\.\s]*")),
    "strict_option": lambda t: _judge_option(t, True),
    "any_option": lambda t: _judge_option(t, False),
    "lastline": option_lastline,
    "boxed_lastline": lambda t: option_lastline(box_or_text(t)),
}


def option_parse(response: Column, parser: str) -> Column:
    """Option letter by a named parser (R4), null when none is found."""
    if parser not in OPTION_PARSERS:
        raise ValueError(f"unknown parser: {parser}")
    return F.nullif(OPTION_PARSERS[parser](response), F.lit(""))


PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalise_answer(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    t = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.array_join(words(F.regexp_replace(t, r"\b(a|an|the)\b", " ")), " ")


def tagged_answer(text: Column) -> Column:
    """Content of the last ``<answer>`` element."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return trim_all(F.try_element_at(found, F.lit(-1)))


def exact_any(pred: Column, golds: Column) -> Column:
    return let(normalise_answer(pred), lambda p: F.exists(golds, lambda g: normalise_answer(g) == p))


def contains_any(pred: Column, golds: Column) -> Column:
    return let(normalise_answer(pred), lambda p: F.exists(golds, lambda g: F.contains(p, normalise_answer(g))))


def anls(pred: Column, golds: Column, threshold: float = 0.5) -> Column:
    """One minus the smallest edit distance over the longer raw length, 0 below the threshold."""
    tidy = lambda x: F.array_join(words(F.lower(x)), " ")

    def distance(g: Column) -> Column:
        size = F.greatest(F.length(g), F.length(pred))
        return F.when(size == 0, F.lit(0.0)).otherwise(F.levenshtein(tidy(g), tidy(pred)) / F.nullif(size, F.lit(0)))

    best = F.lit(1.0) - F.array_min(F.transform(golds, distance))
    return let(best, lambda b: F.when(b < threshold, F.lit(0.0)).otherwise(b))


def exact_match(pred: Column, gold: Column, ignore: Sequence[str] = (), ignore_case: bool = False,
                ignore_punctuation: bool = False, ignore_numbers: bool = False) -> Column:
    def clean(x: Column) -> Column:
        for pattern in ignore:
            x = F.regexp_replace(x, pattern, "")
        if ignore_case:
            x = F.lower(x)
        if ignore_punctuation:
            x = F.regexp_replace(x, PUNCTUATION, "")
        return F.regexp_replace(x, "[0-9]", "") if ignore_numbers else x

    return (clean(pred) == clean(gold)).cast("double")


def hash_answer(response: Column, method: str = "strict", clip: int = 300) -> Column:
    """Final number of a worked solution (R10): ``#### n`` (strict) or the last number, within the last ``clip`` characters."""
    tail = F.when(F.length(response) > clip, F.right(response, F.lit(clip))).otherwise(response)
    if method == "strict":
        return F.regexp_replace(last_group(tail, r"#### (\-?[0-9\.\,]+)"), r"[,$]", "")
    if method != "flexible":
        raise ValueError(f"unknown method: {method}")
    found = F.regexp_extract_all(tail, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    good = F.filter(found, lambda x: x != ".")
    return F.coalesce(F.try_element_at(good, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def hash_reward(response: Column, gold: Column, method: str = "strict", format_score: float = 0.0) -> Column:
    a = hash_answer(response, method)
    return F.when(a.isNull(), F.lit(0.0)).when(a == gold, F.lit(1.0)).otherwise(F.lit(float(format_score)))


# Literal rewrites of a final answer, applied in this order, and expressions that are dropped.
ANSWER_REWRITES = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
DROPPED_EXPRESSIONS = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", "\"", "\\dots",
)


def normalise_final_answer(text: Column) -> Column:
    """Final answer of a quantitative question without units, spacing and text macros."""
    t = F.substring_index(text, "=", -1)
    for before, after in ANSWER_REWRITES:
        t = F.replace(t, F.lit(before), F.lit(after))
    for expression in DROPPED_EXPRESSIONS:
        t = F.replace(t, F.lit(expression), F.lit(""))
    t = F.regexp_replace(t, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for macro in ("text", "textbf", "overline"):
        t = F.regexp_replace(t, rf"(\\{macro}\{{)(.*?)(\}})", "$2")
    t = F.regexp_replace(t, r"(\\boxed\{)(.*)(\})", "$2")
    t = F.regexp_replace(t, r"(frac)([^{])(.)", r"frac{$2}{$3}")
    t = F.regexp_replace(t, r"(sqrt)([^{])", r"sqrt{$2}")
    t = F.replace(t, F.lit("$"), F.lit(""))
    t = F.when(F.replace(t, F.lit(","), F.lit("")).rlike(r"^\d+$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    return trim_all(t)


def answer_line_reward(response: Column, gold: Column) -> Column:
    """1 or -1 by the last ``Answer:`` line within the last 300 characters, both sides normalised."""
    tail = F.when(F.length(response) > 300, F.right(response, F.lit(300))).otherwise(response)
    said = F.coalesce(last_group(tail, r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]"))
    return F.when(normalise_final_answer(said) == normalise_final_answer(gold), F.lit(1.0)).otherwise(F.lit(-1.0))


def strict_box_reward(response: Column, gold: Column) -> Column:
    """1 or -1 by the box within the last 100 characters, compared literally."""
    tail = F.when(F.length(response) > 100, F.right(response, F.lit(100))).otherwise(response)
    return F.when(F.coalesce(boxed(tail) == gold, F.lit(False)), F.lit(1.0)).otherwise(F.lit(-1.0))


def canonical_math(text: Column) -> Column:
    """Spelling of a LaTeX answer used for equality: braces added to roots and fractions, decoration removed."""
    t = F.replace(text, F.lit("\n"), F.lit(""))
    for before, after in (
        ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
        ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
    ):
        t = F.replace(t, F.lit(before), F.lit(after))
    t = F.substring_index(t, "\\text{ ", 1)
    for before, after in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        t = F.replace(t, F.lit(before), F.lit(after))
    t = F.regexp_replace(t, r"^\.", "0.")
    t = F.regexp_replace(t, r"^[^=]{0,2}=([^=]*)$", "$1")
    t = F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}")
    t = F.replace(t, F.lit(" "), F.lit(""))
    t = F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    t = F.regexp_replace(t, r"\\frac([^{])(\{)", r"\\frac{$1}$2")
    t = F.when(t == "0.5", "\\frac{1}{2}").otherwise(t)
    return F.regexp_replace(t, r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$", r"\\frac{$1}{$2}")


def boxed_math_reward(response: Column, gold: Column) -> Column:
    return F.coalesce((canonical_math(boxed(response)) == canonical_math(gold)).cast("double"), F.lit(0.0))


def format_mix_reward(response: Column, gold: Column, format_score: float = 0.1) -> Column:
    """Accuracy and format (think block, then a box) mixed with fixed weights."""
    shaped = response.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")
    return (1.0 - format_score) * boxed_math_reward(response, gold) + format_score * shaped


def narrowed_answer(text: Column) -> Column:
    """Answer-bearing part of a response: the answer element, else what follows ``Answer:``, else everything."""
    start, end = F.instr(text, "<answer>"), F.instr(text, "</answer>")
    inner = F.substring(text, start + 8, end - start - 8)
    at = F.instr(text, "Answer:")
    return trim_all(
        F.when((start > 0) & (end > start), inner).when(at > 0, F.substring(text, at + 7, F.length(text))).otherwise(text)
    )


def letter_number_text_reward(response: Column, gold: Column, is_choice: Column) -> Column:
    """Multiple choice by letter; otherwise equal numbers, or equal normalised text when a number is missing."""
    answer = narrowed_answer(response)
    gold_letter = first_group(trim_all(gold), r"^[ (\[]*([A-F])(?:(?=$)|[\.\)\]]|(?:[\:\-]\s+))")
    number = lambda x: F.replace(
        first_group(F.replace(x, F.lit("\u2212"), F.lit("-")), r"(-?\d+(?:,\d{3})*(?:\.\d+)?)"), F.lit(","), F.lit("")
    ).try_cast("decimal(38,12)")
    plain = lambda x: F.array_join(words(F.regexp_replace(F.lower(x), PUNCTUATION, "")), " ")

    def score(a: Column) -> Column:
        by_letter = F.coalesce(_judge_option(a, False) == gold_letter, F.lit(False))
        both = number(a).isNotNull() & number(gold).isNotNull()
        by_value = F.when(both, number(a) == number(gold)).otherwise(plain(a) == plain(gold))
        return F.when(is_choice, by_letter).otherwise(by_value).cast("double")

    return let(answer, score)


FILTERS: dict[str, Callable[..., Column]] = {}


def register_filter(name: str):
    """Make ``fn(responses, **options) -> Column`` usable in filter chains."""

    def wrap(fn):
        FILTERS[name] = fn
        return fn

    return wrap


@register_filter("regex")
def _f_regex(resps: Column, pattern: str = r"#### (\-?[0-9\.\,]+)", pick: int = 0, fallback: str = "[invalid]", group: int = 1) -> Column:
    index = F.lit(pick + 1 if pick >= 0 else pick)
    return F.transform(resps, lambda r: F.coalesce(
        trim_all(F.try_element_at(F.regexp_extract_all(r, F.lit(pattern), F.lit(group)), index)), F.lit(fallback)))


@register_filter("remove_whitespace")
def _f_space(resps: Column) -> Column:
    return F.transform(resps, lambda r: F.when(r.startswith(" "), F.substring(r, F.lit(2), F.length(r))).otherwise(r))


@register_filter("lowercase")
def _f_lower(resps: Column) -> Column:
    return F.transform(resps, lambda r: F.lower(r))


@register_filter("uppercase")
def _f_upper(resps: Column) -> Column:
    return F.transform(resps, lambda r: F.upper(r))


@register_filter("map")
def _f_map(resps: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform(resps, lambda r: F.coalesce(F.try_element_at(table, r), F.lit(default)))


@register_filter("choice_text")
def _f_choice(
    resps: Column, choices: Column, pattern: str = r"#### (\-?[0-9\.\,]+)", fallback: str = "[invalid]",
    ignore_case: bool = False, ignore_punctuation: bool = False,
) -> Column:
    """Pattern first, then the choice text that occurs first in the response, then ``: X``; answers become ``(X)``."""

    def soften(x: Column) -> Column:
        x = F.lower(x) if ignore_case else x
        return F.regexp_replace(x, r"\p{P}", "") if ignore_punctuation else x

    def read(r: Column) -> Column:
        named = F.transform(choices, lambda c, i: F.struct(
            F.instr(soften(r), soften(trim_all(c))).alias("at"), i.alias("i")))
        hit = F.array_min(F.filter(named, lambda e: e["at"] > 0))
        symbol = lambda i: F.concat(F.lit("("), F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(")"))
        colon = F.filter(
            F.regexp_extract_all(r, F.lit(r":[\s]*([A-Z])"), F.lit(1)),
            lambda x: F.contains(F.substring(F.lit(LETTERS), F.lit(1), F.size(choices)), x),
        )
        first = F.try_element_at(F.regexp_extract_all(r, F.lit(pattern), F.lit(1)), F.lit(1))
        lettered = F.try_element_at(colon, F.lit(1))
        return F.coalesce(
            F.nullif(trim_all(first), F.lit("")), F.when(hit.isNotNull(), symbol(hit["i"])),
            F.when(lettered.isNotNull(), F.concat(F.lit("("), lettered, F.lit(")"))), F.lit(fallback),
        )

    return F.transform(resps, read)


@register_filter("take_first")
def _f_first(resps: Column) -> Column:
    return F.slice(resps, 1, 1)


@register_filter("take_first_k")
def _f_k(resps: Column, k: int) -> Column:
    return F.when(F.size(resps) >= k, F.slice(resps, 1, k)).otherwise(
        F.raise_error(F.lit(f"need at least {k} responses")).cast("array<string>"))


@register_filter("majority_vote")
def _f_majority(resps: Column) -> Column:
    """The most frequent response; the one seen first wins a tie."""
    counted = F.transform(F.array_distinct(resps), lambda v: F.struct(
        F.size(F.filter(resps, lambda r: r == v)).alias("c"), (-F.array_position(resps, v)).alias("p"), v.alias("v")))
    return F.array(F.array_max(counted)["v"])


def apply_filters(df: DataFrame, chains: dict[str, Sequence[tuple[str, dict]]], resps: str = "resps") -> DataFrame:
    """One column per named chain of response filters."""
    out = df
    for name, steps in chains.items():
        col = F.col(resps)
        for step, options in steps:
            if step not in FILTERS:
                raise ValueError(f"unknown filter: {step}")
            col = FILTERS[step](col, **options)
        out = out.withColumn(name, col)
    return out


def failure_tag(score: Column, truncated: Column, answered: Column, recovered: Column) -> Column:
    """Why a row did not earn full credit (R13); truncation is blamed before anything read from the fragment."""
    return (
        F.when((score >= 1.0 - 1e-9) & recovered, "judge_recovered").when(score >= 1.0 - 1e-9, "correct")
        .when(truncated, "truncation_error").when(~answered, "parse_error")
        .when(score > 0, "partial_error").otherwise("factual_error")
    )


def trust_label(response: Column, options: Column | None, is_choice: Column) -> Column:
    """First reason to trust the rule result: a closed box, a terse answer, an unambiguous option line; else empty."""
    tail = let(answer_line(response), lambda line: verdict_line(line, options).isNotNull())
    return (
        F.when(boxed(response).isNotNull(), "boxed").when(is_choice & is_terse(response), "terse")
        .when(~is_choice & is_terse(response), "terse").when(is_choice & tail, "mca_tail").otherwise("")
    )


def verdict(reply: Column) -> Column:
    """Yes, No or UNPARSED from a judge's free text."""
    head = F.lower(F.regexp_replace(trim_all(reply), r"^[*# ]+", ""))
    tail = F.right(head, F.lit(16))
    yes, no = tail.contains("yes"), tail.contains("no")
    return (
        F.when(reply.isNull() | (trim_all(reply) == ""), "UNPARSED").when(head.startswith("yes"), "Yes")
        .when(head.startswith("no"), "No").when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("UNPARSED")
    )


def off_protocol(reply: Column) -> Column:
    return ~F.lower(trim_all(F.coalesce(reply, F.lit("")))).isin("yes", "no")


def row_hash(*parts: Column | str) -> Column:
    """SHA-256 of the row's JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


# Answer families of templated questions and their vocabulary.
AXES = {"horizontal": ("left", "right"), "vertical": ("above", "below"), "depth": ("closer", "farther")}
GOLD_UNIT = r"(?i)(-?\d+(?:\.\d+)?)\s*(?:square\s+)?meters?\b"
POST_MOVE = r"(?i)\b(?:after|upon|once|following)\b"
OBSERVER_CLAUSE = r"(?i)[^.]*\b(?:in\s+front\s+of|behind)\s+the\s+(?:new\s+)?observer\b[^.]*\.?"
CONCLUSION = r"(?i)\b(?:the\s+answer\s+is|therefore|thus|in\s+conclusion|to\s+summarize|so,|final\s+answer|hence)\b"
BEV_ENTRY = r"Object\s*(\d+)\s*:?\s*\(\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\)"
BEV_TOLERANCE = 0.5
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)


def answer_segment(text: Column) -> Column:
    """From the last conclusion marker on, else the last non-empty line."""
    pieces = F.split(text, CONCLUSION)
    marks = F.regexp_extract_all(text, F.lit(CONCLUSION), F.lit(0))
    tail = F.concat(F.try_element_at(marks, F.lit(-1)), F.try_element_at(pieces, F.lit(-1)))
    last = F.try_element_at(F.filter(F.split(text, LINE_BREAK), lambda x: trim_all(x) != ""), F.lit(-1))
    return F.when(F.size(marks) > 0, tail).otherwise(F.coalesce(last, text))


def _axes(text: Column, depth: Column) -> Column:
    """(axis, word) pairs stated in the text; null when an axis is stated with both its words."""
    entries, clash = [], F.lit(False)
    for axis, (low, high) in AXES.items():
        a, b = text.rlike(rf"(?i)\b{low}\b"), text.rlike(rf"(?i)\b{high}\b")
        live = depth if axis == "depth" else F.lit(True)
        clash = clash | (live & a & b)
        entries.append(F.when(live & (a != b), F.struct(F.lit(axis).alias("axis"), F.when(a, low).otherwise(high).alias("word"))))
    return F.when(~clash, F.filter(F.array(*entries), lambda e: e.isNotNull()))


def direction_axes(text: Column, depth: Column) -> Column:
    """Axes of a direction answer; a clash is resolved from the last move marker on, or stays null."""
    bare = F.regexp_replace(text, OBSERVER_CLAUSE, " ")
    after = F.when(bare.rlike(POST_MOVE), F.try_element_at(F.split(bare, POST_MOVE), F.lit(-1)))
    return F.coalesce(_axes(bare, depth), _axes(after, depth))


def number_word(text: Column) -> Column:
    """Value of the last number word ("no" and "none" are 0)."""
    table = F.create_map(*[F.lit(x) for w, v in [*((w, i) for i, w in enumerate(NUMBER_WORDS)), ("no", 0), ("none", 0)] for x in (w, float(v))])
    pattern = r"(?i)\b(" + "|".join((*NUMBER_WORDS, "no", "none")) + r")\b"
    return F.try_element_at(table, F.lower(last_group(text, pattern)))


_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_FAR_NEAR = re.compile(r"\b(closest|farthest|closer|farther)\b", re.IGNORECASE)


def _nearest(sentence: str, names: re.Pattern, verdict_at: int) -> str:
    hits = [(abs(m.start() - verdict_at), m.start(), m.group(1)) for m in names.finditer(sentence)]
    return min(hits)[2] if hits else ""


def _stated(text: str, names: re.Pattern) -> tuple[str, str]:
    """(name, far/near) of the last sentence that gives a verdict; a lone name without verdict counts as named directly."""
    low = (text or "").lower()
    for sentence in reversed(_SENTENCE.split(low)):
        marks = list(_FAR_NEAR.finditer(sentence))
        if marks:
            name = _nearest(sentence, names, marks[-1].start())
            if name:
                return name, "far" if marks[-1].group(1).startswith("far") else "near"
    found = {m.group(1) for m in names.finditer(low)}
    return (found.pop(), "") if len(found) == 1 else ("", "")


def compare_answers(gold: Column, response: Column, question: Column, pair: Column) -> Column:
    """Comparison answers resolved against the question (R7): struct(gold, pred), empty when unreadable.

    A statement with the opposite polarity of the question names the other candidate when there are exactly two. The
    look-up of candidate names in free text is the one part done in Python, batch by batch.
    """

    @F.pandas_udf("struct<gold:string,pred:string>")
    def resolve(g: pd.Series, r: pd.Series, q: pd.Series, two: pd.Series) -> pd.DataFrame:
        colours = re.compile(r"\b(green|blue)\s+point\b")
        objects = re.compile(r"(?:object|point)\s*(\d+)")
        in_pair = re.compile(r"([A-Za-z][A-Za-z \-']{0,40}?)\s*\(\s*(green|blue)\s+point\s*\)", re.IGNORECASE)
        in_set = re.compile(
            r"([A-Za-z][A-Za-z \-']{0,40}?)\s*\(\s*(?:in\s+Frame-\d+\s*,\s*)?(?:point|object)\s*(\d+)\s*\)", re.IGNORECASE)

        def named(text: str, table: dict[str, str]) -> str:
            spots = [(m.start(), v) for n, v in table.items() for m in re.finditer(rf"\b{re.escape(n)}\b", text, re.IGNORECASE)]
            return max(spots)[1] if spots else ""

        golds, preds = [], []
        for gold_text, reply, ask, is_pair in zip(g, r, q, two):
            names = colours if is_pair else objects
            table: dict[str, set] = {}
            for n, v in (in_pair if is_pair else in_set).findall(ask or ""):
                table.setdefault(n.strip().lower(), set()).add(v.lower())
            single = {n: next(iter(v)) for n, v in table.items() if len(v) == 1 and n}
            sides = {"green", "blue"} if is_pair else set(single.values())
            polarity = _FAR_NEAR.search(ask or "")
            asked = "" if polarity is None else ("far" if polarity.group(1).lower().startswith("far") else "near")

            def settle(value: str, said: str) -> str:
                if not value or not said or not asked or said == asked:
                    return value
                others = sorted(sides - {value})
                return others[0] if len(others) == 1 else f"~{value}"

            golds.append(settle(*_stated(gold_text, names)))
            value, said = _stated(reply, names)
            if not value and reply:
                value = named(reply, single)
                marks = _FAR_NEAR.findall(reply)
                said = "" if not marks else ("far" if marks[-1].lower().startswith("far") else "near")
            preds.append(settle(value, said))
        return pd.DataFrame({"gold": golds, "pred": preds})

    return resolve(gold, response, question, pair)


def template_score(
    df: DataFrame, family: str = "family", gold: str = "gold", response: str = "response", question: str = "question",
    metric: str = "metric", depth: str = "depth",
) -> DataFrame:
    """Templated answers by family (R7): numeric, direction, compare_pair, compare_set, yesno, bev.

    Adds ``gold_parsed``, ``answered``, ``score``, ``axes_stated``, ``axes_correct``, ``axes_missing``. A gold of plain yes / no makes
    the row a yes/no row. ``metric`` marks types whose number carries a unit, ``depth`` types with a depth axis.
    """
    bare_gold = F.lower(trim_all(F.col(gold)))
    out = df.withColumn("__fam", F.when(bare_gold.isin("yes", "no"), "yesno").otherwise(F.col(family)))
    out = out.withColumn("__text", trim_all(F.coalesce(F.col(response), F.lit(""))))
    out = out.withColumn("__seg", answer_segment(F.col("__text")))
    text, seg, g, fam = F.col("__text"), F.col("__seg"), F.col(gold), F.col("__fam")

    gold_num = F.coalesce(last_group(g, GOLD_UNIT).try_cast("double"), to_number(last_group(g, NUMBER, 0)))
    unit = F.coalesce(last_group(seg, GOLD_UNIT), last_group(text, GOLD_UNIT)).try_cast("double")
    pred_num = F.coalesce(F.when(F.col(metric), unit), number_lastline(text), number_word(seg))
    last_yes = lambda t: F.lower(last_group(t, r"(?i)\b(yes|no)\b"))
    points = lambda t: F.map_from_entries(F.array_distinct(F.zip_with(
        F.regexp_extract_all(t, F.lit(BEV_ENTRY), F.lit(1)),
        F.zip_with(F.regexp_extract_all(t, F.lit(BEV_ENTRY), F.lit(2)), F.regexp_extract_all(t, F.lit(BEV_ENTRY), F.lit(3)),
                   lambda x, y: F.struct(x.try_cast("double").alias("x"), y.try_cast("double").alias("y"))),
        lambda k, v: F.struct(k, v))))
    out = out.withColumn("__gn", F.when(fam == "numeric", gold_num)).withColumn("__pn", F.when(fam == "numeric", pred_num))
    out = out.withColumn("__ga", F.when(fam == "direction", direction_axes(g, F.col(depth))))
    out = out.withColumn("__pa", F.when(fam == "direction", direction_axes(seg, F.col(depth))))
    out = out.withColumn("__gb", F.when(fam == "bev", points(g))).withColumn("__pb", F.when(fam == "bev", points(text)))
    compared = fam.isin("compare_pair", "compare_set")
    out = out.withColumn("__cmp", compare_answers(
        F.when(compared, g), F.when(compared, text), F.col(question), fam == "compare_pair"))
    ga, pa = F.col("__ga"), F.col("__pa")
    shared = F.filter(ga, lambda e: F.exists(pa, lambda p: p["axis"] == e["axis"]))
    right = F.filter(ga, lambda e: F.exists(pa, lambda p: (p["axis"] == e["axis"]) & (p["word"] == e["word"])))
    none = F.lit(None).cast("int")
    out = out.withColumn("axes_stated", F.when(fam == "direction", F.coalesce(F.size(shared), F.lit(0))).otherwise(none))
    out = out.withColumn("axes_correct", F.when(fam == "direction", F.coalesce(F.size(right), F.lit(0))).otherwise(none))
    out = out.withColumn("axes_missing", F.when(fam == "direction", F.size(ga) - F.col("axes_stated")).otherwise(none))
    gb, pb = F.col("__gb"), F.col("__pb")
    both = F.filter(F.map_keys(gb), lambda k: F.map_contains_key(pb, k))
    close = F.filter(both, lambda k: F.hypot(gb[k]["x"] - pb[k]["x"], gb[k]["y"] - pb[k]["y"]) <= BEV_TOLERANCE)
    readable = (
        F.when(fam == "yesno", F.lit(True)).when(fam == "numeric", F.col("__gn").isNotNull())
        .when(fam == "direction", F.coalesce(F.size(ga), F.lit(0)) > 0).when(compared, F.col("__cmp.gold") != "")
        .when(fam == "bev", F.size(gb) > 0).otherwise(F.lit(False))
    )
    seen = (
        F.when(text == "", F.lit(False)).when(fam == "yesno", last_yes(text).isNotNull())
        .when(fam == "numeric", F.col("__pn").isNotNull()).when(fam == "direction", F.col("axes_stated") > 0)
        .when(compared, F.col("__cmp.pred") != "").when(fam == "bev", F.size(both) > 0).otherwise(F.lit(False))
    )
    score = (
        F.when(fam == "yesno", (F.coalesce(last_yes(seg), last_yes(text)) == bare_gold).cast("double"))
        .when(fam == "numeric", relative_accuracy(F.col("__pn"), F.col("__gn")))
        .when(fam == "direction", ((F.col("axes_missing") == 0) & (F.col("axes_correct") == F.size(ga))).cast("double"))
        .when(compared, (F.col("__cmp.gold") == F.col("__cmp.pred")).cast("double"))
        .when(fam == "bev", F.try_divide(F.size(close), F.size(gb)))
    )
    readable, seen = F.coalesce(readable, F.lit(False)), F.coalesce(seen, F.lit(False))
    out = out.withColumn("gold_parsed", readable.cast("int"))
    out = out.withColumn("answered", (readable & seen).cast("int"))
    out = out.withColumn("score", F.when(F.col("answered") == 1, score).otherwise(F.lit(0.0)))
    return out.withColumn("family", fam).drop("__fam", "__text", "__seg", "__gn", "__pn", "__ga", "__pa", "__gb", "__pb", "__cmp")


def pool_score(pred: Column, gold: Column) -> Column:
    """Loose score of a training row: option letter, or a short numeric gold by relative accuracy, else 0."""
    plain = lambda t: first_group(t, r"(-?\d+\.?\d*)").try_cast("double")
    letter = first_group(F.upper(pred), r"\b([A-D])\b")
    head = plain(_first_token(trim_all(pred)))
    value = F.coalesce(F.when(head != 0, head), plain(pred))
    return (
        F.when(gold.rlike("^[A-Da-d]$"), F.coalesce((letter == F.upper(gold)).cast("double"), F.lit(0.0)))
        .when(plain(gold).isNotNull() & (F.size(words(gold)) <= 3), F.coalesce(relative_accuracy(value, plain(gold)), F.lit(0.0)))
        .otherwise(F.lit(0.0))
    )


def score_rows(
    df: DataFrame, routes: dict[str, str], source: str = "data_source", response: str = "response", gold: str = "gold",
    options: str | None = None, kind: str | None = None, box_first: bool = True,
) -> DataFrame:
    """Score every row by the parser its data source routes to (R8): always ``score``, ``acc``, ``answered``, ``boxed_present``.

    Routes map a source prefix to ``option`` (box, then last line), ``priority`` (pattern list) or ``mixed`` (letters or numbers by
    the ``kind`` column; an unknown kind is an error). Other sources are scored as training rows. An empty response or gold gives 0.
    """
    text, g = trim_all(F.coalesce(F.col(response), F.lit(""))), trim_all(F.coalesce(F.col(gold), F.lit("")))
    out = df.withColumn("__r", text).withColumn("__g", g)
    out = out.withColumn("__box", boxed(F.col("__r")))
    out = out.withColumn("__s", F.coalesce(normalise_boxed(F.col("__box")), F.col("__r")) if box_first else F.col("__r"))
    opts = F.col(options) if options else None
    route = F.lit("pool")
    for prefix, name in routes.items():
        if name not in ("option", "priority", "mixed"):
            raise ValueError(f"unknown route: {name}")
        route = F.when(F.col(source).startswith(prefix), F.lit(name)).otherwise(route)
    out = out.withColumn("__route", route)
    rt = F.col("__route")
    what = F.col(kind) if kind else F.lit("mca")
    is_letter, is_number = (rt == "option") | ((rt == "mixed") & (what == "mca")), (rt == "mixed") & (what == "na")
    letter = F.when(is_letter, option_lastline(F.col("__s"), opts)).when(rt == "priority", option_parse(F.col("__r"), "priority"))
    out = out.withColumn("__letter", letter).withColumn("__num", F.when(is_number, number_lastline(F.col("__s"))))
    bad = (rt == "mixed") & ~what.isin("mca", "na")
    wanted = F.when(rt == "priority", F.col("__g")).otherwise(F.upper(F.col("__g")))
    blank = (F.col("__r") == "") | (F.col("__g") == "")
    score = (
        F.when(blank, F.lit(0.0)).when(bad, F.raise_error(F.concat(F.lit("unknown question kind: "), what)).cast("double"))
        .when(is_number, relative_accuracy(F.col("__num"), F.col("__g").try_cast("double")))
        .when(is_letter | (rt == "priority"), (F.col("__letter") == wanted).cast("double"))
        .otherwise(pool_score(F.col("__r"), F.col("__g")))
    )
    seen = F.when(blank, F.lit(False)).when(is_number, F.col("__num").isNotNull()).when(
        is_letter | (rt == "priority"), F.col("__letter").isNotNull()).otherwise(F.lit(True))
    return (
        out.withColumn("score", F.coalesce(score, F.lit(0.0))).withColumn("acc", F.col("score"))
        .withColumn("answered", seen.cast("int")).withColumn("boxed_present", F.col("__box").isNotNull().cast("int"))
        .withColumn("resp_chars", F.length("__r")).drop("__r", "__g", "__s", "__box", "__route", "__letter", "__num")
    )


def score_with(df: DataFrame, score: Callable[[Column, Column], Column], response: str = "response", gold: str = "gold") -> DataFrame:
    """User reward function plugged in: ``score`` takes and returns columns, for instance a pandas UDF."""
    return df.withColumn("score", score(F.col(response), F.col(gold)))


def eval_rewards(
    df: DataFrame, score: Callable[[Column, Column], Column], source: str = "data_source", responses: str = "responses",
    gold: str = "gold",
) -> DataFrame:
    """Mean over the responses of a row, then over the rows of a source."""
    mean = F.aggregate(
        F.transform(F.col(responses), lambda r: score(r, F.col(gold)).cast("double")), F.lit(0.0), lambda a, x: a + x
    ) / F.size(F.col(responses))
    return df.select(source, mean.alias("m")).groupBy(source).agg(F.avg("m").alias("test_score"), F.count(F.lit(1)).alias("rows"))
