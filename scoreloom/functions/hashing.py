"""Stable hashes: the random order and the random numbers of all draws are functions of the data alone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(*parts: Column | str, seed: int | str = 0) -> Column:
    """MD5 of seed and parts as 32 hex digits: the random order of a draw."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_bucket(h: Column) -> Column:
    """The leading four hex digits: 65,536 even ranges in hash order."""
    return F.substring(h, 1, 4)


def hash_int(h: Column) -> Column:
    """The leading 12 hex digits as a whole number below 2**48."""
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint")


def hash_unit(h: Column) -> Column:
    """The leading 12 hex digits as a number in [0, 1)."""
    return hash_int(h).cast("double") / F.lit(float(1 << 48))


def poisson_count(unit: Column, largest: int = 18) -> Column:
    """Poisson(1) count of a uniform number, by the inverse of its distribution.

    Counts above 18 have a chance below 2**-48, the step between two draws of :func:`hash_unit`, so no draw can mean one.
    """
    count, mass, total = F.lit(0), math.exp(-1), math.exp(-1)
    for k in range(1, largest + 1):
        count = count + (unit >= total).cast("int")
        mass /= k
        total += mass
    return count
