"""Text preparation as column expressions: references, headers, hints, options (survey rows P3, P4, P6, P9, P10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.arrays import let

# Media placeholders and view reference formats.
IMAGE_TOKEN = "<image>"
VIDEO_TOKEN = "<video>"
FRAME_REF = r"Frame-(\d+)"
IMAGE_REF = r"\b([Ii]mage) (\d+)\b"
ANCHOR_PHRASES = ("first image", "first view", "main viewpoint")


def trim_all(text: Column) -> Column:
    """Strip every kind of white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_grams(text: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words."""
    return let(words(text), lambda ws: F.when(
        F.size(ws) >= n, F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.xxhash64(F.slice(ws, i, n)))
    ).otherwise(F.array().cast("array<bigint>")))


_BLOCK = 64


def char_grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters. The text is cut into overlapping blocks first, as reaching position i costs i steps."""
    size = F.length(text)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - n) / _BLOCK).cast("int")), lambda b: F.substring(
        text, b * _BLOCK + 1, F.lit(_BLOCK + n - 1)))
    runs = F.transform(blocks, lambda block: F.transform(
        F.sequence(F.lit(1), F.length(block) - n + 1), lambda i: F.substring(block, i, F.lit(n))))
    return F.when(size >= n, F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def frame_refs(text: Column) -> Column:
    """Distinct 0-based ``Frame-N`` references in ascending order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FRAME_REF), F.lit(1)), lambda x: x.cast("int"))))


def image_refs(text: Column) -> Column:
    """Distinct ``image N`` references, turned into 0-based view numbers."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(IMAGE_REF), F.lit(2)), lambda x: x.cast("int") - 1)))


def needs_anchor(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for phrase in ANCHOR_PHRASES:
        out = out | low.contains(phrase)
    return out


def _rewrite(text: Column, pattern: str, heads: Column, numbers: Column) -> Column:
    # Text between the references, each piece followed by its rewritten reference; null numbers make the result null.
    pieces = F.split(text, pattern, -1)
    refs = F.zip_with(heads, numbers, lambda h, n: F.concat(h, n.cast("string")))
    broken = F.exists(refs, lambda r: r.isNull())
    glued = F.zip_with(pieces, refs, lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    return F.when(~broken, F.array_join(glued, ""))


def renumber_frames(text: Column, kept: Column) -> Column:
    """``Frame-N`` rewritten to the position of N among the kept views; null when a reference is not kept."""
    found = F.regexp_extract_all(text, F.lit(FRAME_REF), F.lit(1))
    numbers = F.transform(found, lambda x: F.nullif(F.array_position(kept, x.cast("int")), F.lit(0)) - 1)
    return _rewrite(text, FRAME_REF, F.transform(found, lambda _: F.lit("Frame-")), numbers)


def renumber_images(text: Column, kept: Column) -> Column:
    """1-based ``image N`` rewritten to the position among the kept 0-based views; null when a reference is not kept."""
    words_ = F.regexp_extract_all(text, F.lit(IMAGE_REF), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(IMAGE_REF), F.lit(2))
    numbers = F.transform(found, lambda x: F.nullif(F.array_position(kept, x.cast("int") - 1), F.lit(0)))
    return _rewrite(text, IMAGE_REF, F.transform(words_, lambda w: F.concat(w, F.lit(" "))), numbers)


def split_header(text: Column) -> tuple[Column, Column]:
    """Image block up to the last placeholder, and the question after it; both null without a placeholder."""
    body = F.substring_index(text, IMAGE_TOKEN, -1)
    has = text.contains(IMAGE_TOKEN)
    header = F.substring(text, F.lit(1), F.length(text) - F.length(body))
    return F.when(has, header), F.when(has, body)


def header_style(header: Column) -> Column:
    return F.when(F.ltrim(header).startswith("Frame-0:"), "frame_labels").otherwise("bare")


def render_header(style: Column, count: Column) -> Column:
    """Image block for ``count`` views: labelled lines, bare lines, or tokens in a row."""
    slots = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    labelled = F.array_join(F.transform(slots, lambda i: F.concat(F.lit("Frame-"), i.cast("string"), F.lit(f": {IMAGE_TOKEN}"))), "\n")
    bare = F.array_join(F.transform(slots, lambda _: F.lit(IMAGE_TOKEN)), "\n")
    return (
        F.when(style == "frame_labels", labelled).when(style == "bare", bare)
        .when(style == "concat", F.repeat(F.lit(IMAGE_TOKEN), count.cast("int")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown header style: "), style)))
    )


def build_prompt(style: Column, count: Column, body: Column) -> Column:
    """Header plus body with the line break after each placeholder removed."""
    return F.replace(F.concat(render_header(style, count), body), F.lit(f"{IMAGE_TOKEN}\n"), F.lit(IMAGE_TOKEN))


def count_token(text: Column, token: str = IMAGE_TOKEN) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


def strip_thinking(text: Column) -> Column:
    """Remove ``<think>`` blocks, with the white space after them."""
    return F.regexp_replace(text, r"(?is)<think>.*?</think>\s*", "")


def resolve_answer(*candidates: Column) -> Column:
    """First non-blank gold answer, trimmed."""
    return F.coalesce(*[F.nullif(trim_all(c.cast("string")), F.lit("")) for c in candidates])


def consecutive_letters(entries: Column) -> Column:
    """Longest prefix of (letter, body) pairs whose letters run A, B, C, ... without a gap.

    A pair out of sequence is skipped, as it belongs to a body text.
    """
    start = F.array().cast("array<struct<letter:string,body:string>>")
    return F.aggregate(
        entries, start,
        lambda acc, e: F.when(
            F.ascii(e["letter"]) == F.lit(65) + F.size(acc),
            F.concat(acc, F.array(F.struct(e["letter"].alias("letter"), e["body"].alias("body")))),
        ).otherwise(acc),
    )
