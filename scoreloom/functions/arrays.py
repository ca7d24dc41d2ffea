"""Column functions over per-token arrays (``array<double>``) and their 0/1 masks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAFETY_BOUND = 20.0
EPS = 1e-8
_SCAN_ROWS = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; inside a lambda an outer expression runs per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    if high is not None:
        x = F.least(x, F.lit(float(high)))
    return x


def ones_like(arr: Column) -> Column:
    return F.transform(arr, lambda _: F.lit(1.0))


def array_total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum under the mask; values outside the mask (NaN included) do not count."""
    kept = F.zip_with(values, mask, lambda v, m: F.when(m != 0, v * m).otherwise(F.lit(0.0)))
    return array_total(kept)


def mask_count(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)


def masked_mean(values: Column, mask: Column) -> Column:
    return masked_sum(values, mask) / (mask_count(mask) + F.lit(EPS))


def masked_max(values: Column, mask: Column) -> Column:
    """Largest value under the mask; 0 when everything is masked."""
    kept = F.zip_with(values, mask, lambda v, m: F.when(m != 0, v))
    return F.coalesce(F.array_max(F.filter(kept, lambda v: v.isNotNull())), F.lit(0.0))


def masked_min(values: Column, mask: Column) -> Column:
    kept = F.zip_with(values, mask, lambda v, m: F.when(m != 0, v))
    return F.coalesce(F.array_min(F.filter(kept, lambda v: v.isNotNull())), F.lit(0.0))


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def log_sum_exp(arr: Column) -> Column:
    return let(
        F.array_max(arr),
        lambda peak: peak + F.log(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - peak))),
    )


def cumulative(values: Column) -> Column:
    """Running sum along each array."""

    @F.pandas_udf("array<double>")
    def scan(v: pd.Series) -> pd.Series:
        return v.map(np.cumsum)

    return scan(values)


def reverse_cumulative(values: Column) -> Column:
    """Sum from each position to the end of its array."""

    @F.pandas_udf("array<double>")
    def scan(v: pd.Series) -> pd.Series:
        return v.map(lambda a: np.cumsum(a[::-1])[::-1])

    return scan(values)


def _reverse_scan(columns: list[pd.Series], step: Callable) -> pd.Series:
    """Run a backward recurrence over time, vectorised across a few hundred rows at once.

    Short arrays are padded with zeros at the end, which leaves a masked recurrence untouched.
    """
    out: list[np.ndarray] = []
    lengths = columns[0].map(len).to_numpy()
    for start in range(0, len(lengths), _SCAN_ROWS):
        lens = lengths[start : start + _SCAN_ROWS]
        padded = []
        for col in columns:
            grid = np.zeros((len(lens), int(lens.max(initial=0))))
            for i, row in enumerate(col.iloc[start : start + _SCAN_ROWS]):
                grid[i, : lens[i]] = row
            padded.append(grid)
        result = step(*padded)
        out.extend(result[i, : lens[i]] for i in range(len(lens)))
    return pd.Series(out, dtype=object)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """``R_t = r_t + gamma * R_(t+1)``, where a masked position passes nothing on."""

    @F.pandas_udf("array<double>")
    def scan(r: pd.Series, m: pd.Series) -> pd.Series:
        def step(rew, msk):
            res = np.zeros_like(rew)
            carry = np.zeros(rew.shape[0])
            for t in range(rew.shape[1] - 1, -1, -1):
                res[:, t] = rew[:, t] + gamma * carry
                carry = res[:, t] * msk[:, t]
            return res

        return _reverse_scan([r, m], step)

    return scan(rewards, mask)


def lambda_advantages(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates before whitening; masked tokens hand the state through."""

    @F.pandas_udf("array<double>")
    def scan(r: pd.Series, v: pd.Series, m: pd.Series) -> pd.Series:
        def step(rew, val, msk):
            res = np.zeros_like(rew)
            ahead = np.zeros(rew.shape[0])
            carry = np.zeros(rew.shape[0])
            for t in range(rew.shape[1] - 1, -1, -1):
                live = msk[:, t] != 0
                fresh = rew[:, t] + gamma * ahead - val[:, t] + gamma * lam * carry
                carry = np.where(live, fresh, carry)
                ahead = np.where(live, val[:, t], ahead)
                res[:, t] = carry
            return res

        return _reverse_scan([r, v, m], step)

    return scan(rewards, values, mask)


def fit_length(
    arr: Column, size: int, pad_value: Column, truncate: str = "right", pad: str = "right"
) -> Column:
    """Cut or pad an array to ``size``: ``truncate`` and ``pad`` name the side that loses or gains elements.

    ``truncate='error'`` fails on longer arrays.
    """
    n = F.size(arr)
    if truncate == "right":
        cut = F.slice(arr, 1, size)
    elif truncate == "left":
        cut = F.when(n > size, F.slice(arr, -size, size)).otherwise(arr)
    elif truncate == "middle":
        head = size // 2
        tail = size - head
        cut = F.when(n > size, F.concat(F.slice(arr, 1, head), F.slice(arr, -tail, tail))).otherwise(arr)
    elif truncate == "error":
        cut = F.when(
            n > size, F.raise_error(F.concat(F.lit("sequence longer than "), F.lit(str(size))))
        ).otherwise(arr)
    else:
        raise ValueError(f"unknown truncation: {truncate}")
    fill = F.array_repeat(pad_value, F.greatest(F.lit(size) - n, F.lit(0)))
    return F.concat(fill, cut) if pad == "left" else F.concat(cut, fill)
