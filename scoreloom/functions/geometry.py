"""View size and frame arithmetic (survey rows P7, P8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resize target, rounding and alignment factors, token patch sizes, frame sampling bounds.
TARGET_WIDTH = 518
ROUND_FACTOR = 14
ALIGN = 32
PATCH = 16
MERGE = 2
MIN_PIXELS = 4 * ALIGN * ALIGN
MAX_PIXELS = 16384 * ALIGN * ALIGN
FRAME_INTERVAL = 2
MIN_FRAMES = 4
MAX_FRAMES = 8


def half_even(x: Column) -> Column:
    """Round to an integer, halves to the even side."""
    return F.bround(x, 0)


def aspect_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Width scaled to the target, height rounded and cropped, both cut down to the alignment factor."""
    h = half_even(height * (F.lit(float(TARGET_WIDTH)) / width) / ROUND_FACTOR) * ROUND_FACTOR
    h = F.least(h, F.lit(float(TARGET_WIDTH)))
    w = TARGET_WIDTH - TARGET_WIDTH % ALIGN
    return F.lit(w).cast("int"), (h - h % ALIGN).cast("int")


def budget_size(width: Column, height: Column, min_pixels: int, max_pixels: int) -> tuple[Column, Column]:
    """Both sides on the alignment factor inside a pixel budget, without cropping."""
    f = float(ALIGN)
    hb = F.greatest(F.lit(f), half_even(height / f) * f)
    wb = F.greatest(F.lit(f), half_even(width / f) * f)
    area = height.cast("double") * width
    down, up = F.sqrt(area / max_pixels), F.sqrt(F.lit(float(min_pixels)) / area)

    def fit(side: Column, rounded: Column) -> Column:
        small = F.greatest(F.lit(f), F.floor(side / down / f) * f)
        large = F.ceil(side * up / f) * f
        return F.when(hb * wb > max_pixels, small).when(hb * wb < min_pixels, large).otherwise(rounded).cast("int")

    return fit(width, wb), fit(height, hb)


def visual_tokens(width: Column, height: Column) -> Column:
    return F.floor(F.floor(width / PATCH) * F.floor(height / PATCH) / (MERGE * MERGE)).cast("int")


def is_aligned(width: Column, height: Column) -> Column:
    pixels = width.cast("bigint") * height
    return (width % ALIGN == 0) & (height % ALIGN == 0) & pixels.between(MIN_PIXELS, MAX_PIXELS)


def even_indices(total: Column, budget: Column) -> Column:
    """``budget`` indices spread evenly over ``0 .. total - 1``, truncated to integers, without repeats."""
    step = F.when(budget > 1, (total - 1).cast("double") / (budget - 1)).otherwise(F.lit(0.0))
    raw = F.transform(F.sequence(F.lit(0), (budget - 1).cast("int")), lambda i: F.when(
        (i == budget - 1) & (budget > 1), (total - 1).cast("double")).otherwise(i * step).cast("int"))
    return F.array_distinct(raw)


def frame_indices(total: Column, fps: Column) -> Column:
    """Frames of a video: half its length in seconds, clamped to the bounds, spread evenly."""
    target = half_even(total / fps / FRAME_INTERVAL).cast("int")
    return even_indices(total, F.least(F.greatest(target, F.lit(MIN_FRAMES)), F.lit(MAX_FRAMES)))


def even_views(total: Column, budget: Column) -> Column:
    """All views when the budget covers them, else an even spread."""
    return F.when(budget >= total, F.sequence(F.lit(0), (total - 1).cast("int"))).otherwise(even_indices(total, budget))
