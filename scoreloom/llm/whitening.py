"""Whitening of embeddings by a covariance over distinct vectors.

Entries become whole numbers, ``floor(scale * c)``, so equal vectors are equal exactly and sums are exact. Identical vectors are grouped once;
each distinct vector weighs one in the fit, or as many as it has rows. The covariance is a weighted, centred matrix product per task, and the
parts are added on Spark, row of the matrix by row. Each distinct vector is whitened once and joined back to its rows.

Vectors of different lengths cannot share a covariance; each length is fitted by itself. What reaches the driver is one matrix per length, whose
size is set by the length of the vectors and not by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import free_name, written
from scoreloom.operators.groups import lookup_by_group

#: Factor before rounding down, and components that are given.
SCALE, COMPONENTS = 256, 4
#: A component is given if its variance is above this share of the largest: below it, rounding alone decides its direction.
LEAST_SHARE = 1e-12
#: Vectors of a matrix product.
BLOCK = 4096

_SUMS = "dim int, line int, n long, sums array<long>"
_LINES = "dim int, line int, n double, sums array<double>"


@dataclass(frozen=True)
class Whitening:
    """The fit of one vector length: weight ``n``, exact sums, unit eigenvectors in columns by falling eigenvalue, eigenvalues, trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole_vectors(df: DataFrame, vector: str, name: str, scale: int = SCALE) -> DataFrame:
    """``df`` without rows whose vector is null or has null or non-finite entries, with the whole-number vector under ``name``."""
    entry = F.col(vector)
    fine = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return df.filter(entry.isNotNull() & fine).withColumn(name, x)


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, places, matrix)`` of the vectors in column 0 by their length, in blocks."""
    column = batch.column(0)
    lengths = np.diff(np.asarray(column.offsets))
    flat, first = np.asarray(column.values), np.asarray(column.offsets)
    for dim in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == dim)
        for at in range(0, len(places), BLOCK):
            some = places[at : at + BLOCK]
            yield dim, some, flat[first[some][:, None] + np.arange(dim)]


def _output(rows: list[tuple], kind: pa.DataType, weight: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = [pa.int32(), pa.int32(), weight, pa.list_(kind)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["dim", "line", "n", "sums"])


def _added(parts: DataFrame, schema: str, exact: bool) -> DataFrame:
    """``parts`` added up by ``(dim, line)``: a task reads them one by one and holds only the lines it is to give."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            dims, lines, weights = (batch.column(i).to_pylist() for i in range(3))
            for dim, line, weight, part in zip(dims, lines, weights, batch.column(3), strict=True):
                own = held.setdefault((dim, line), [0, np.zeros(dim, object if exact else float)])
                own[0] += weight
                own[1] = own[1] + np.asarray(part.values)
        if exact and any(abs(int(v)) > np.iinfo(np.int64).max for _, total in held.values() for v in total):
            raise OverflowError("sums of whole vectors exceed 64 bits; lower the scale")
        rows = [(dim, line, weight, total.tolist()) for (dim, line), (weight, total) in held.items()]
        yield _output(rows, pa.int64() if exact else pa.float64(), pa.int64() if exact else pa.float64())

    return parts.repartition("dim", "line").mapInArrow(add, schema)


def fit(classes: DataFrame, x: str = "x", weight: str | None = None) -> dict[int, Whitening]:
    """Fits by vector length. ``classes`` has distinct vectors; ``weight`` names their counts, one each without it."""
    rows = classes.select(F.col(x).alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            weights = np.asarray(batch.column(1))
            for dim, places, matrix in _grouped(batch):
                own = total.setdefault(dim, [0, np.zeros(dim, object)])
                own[0] += int(weights[places].sum())
                w = weights[places]
                if w.max() * np.abs(matrix.astype(float)).max(initial=0) * len(places) < 2.0**62:
                    own[1] = own[1] + (w @ matrix).astype(object)
                else:
                    own[1] = own[1] + w.astype(object) @ matrix.astype(object)
        yield _output([(dim, -1, n, s.tolist()) for dim, (n, s) in total.items()], pa.int64(), pa.int64())

    first = {r["dim"]: (r["n"], np.array(r["sums"], np.int64)) for r in _added(rows.mapInArrow(sums, _SUMS), _SUMS, True).collect()}
    means = {dim: s / n for dim, (n, s) in first.items()}

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            weights = np.asarray(batch.column(1))
            for dim, places, matrix in _grouped(batch):
                centred = matrix - means[dim]
                part = (centred * weights[places][:, None]).T @ centred
                total[dim] = total[dim] + part if dim in total else part
        for dim, matrix in total.items():
            yield _output([(dim, line, 0.0, own.tolist()) for line, own in enumerate(matrix)], pa.float64(), pa.float64())

    lines: dict[int, np.ndarray] = {dim: np.zeros((dim, dim)) for dim in first}
    for r in _added(rows.mapInArrow(products, _LINES), _LINES, False).toLocalIterator():
        lines[r["dim"]][r["line"]] = r["sums"]
    out = {}
    for dim, (n, s) in first.items():
        covariance = (lines[dim] + lines[dim].T) / (2 * n)
        values, vectors = np.linalg.eigh(covariance) if dim else (np.empty(0), np.empty((0, 0)))
        out[dim] = Whitening(n, s, vectors[:, ::-1], values[::-1], float(np.trace(covariance)))
    return out


_WHITE = "x array<long>, rows long, dim int, n long, deviation long, white array<double>, explained array<double>"


def _whitened(model: dict[int, Whitening], components: int, least: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, places, matrix in _grouped(batch):
                fitted = model[dim]
                k = int((fitted.values[:components] > least * max(fitted.values[0], 0)).sum()) if dim else 0
                far = fitted.n * np.abs(matrix.astype(float)).max(initial=0) + np.abs(fitted.sums.astype(float)).max(initial=0)
                if dim * far * far >= 2.0**63:
                    raise OverflowError("the squared deviation exceeds 64 bits; lower the scale")
                apart = fitted.n * matrix - fitted.sums
                white = (apart / fitted.n) @ fitted.vectors[:, :k] / np.sqrt(fitted.values[:k])
                explained = (fitted.values[:k] / fitted.trace).tolist() if k else []
                size = len(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(places)), batch.column(1).take(pa.array(places)), pa.array([dim] * size, pa.int32()),
                        pa.array([fitted.n] * size, pa.int64()), pa.array((apart * apart).sum(axis=1), pa.int64()),
                        pa.array(list(white), pa.list_(pa.float64())), pa.array([explained] * size, pa.list_(pa.float64())),
                    ],
                    names=["x", "rows", "dim", "n", "deviation", "white", "explained"],
                )

    return apply


def identity_errors(white: DataFrame, weight: str | None, components: int) -> DataFrame:
    """``(dim, identity_error)``: how far the covariance of the whitened vectors, over the fit list, is from the identity."""
    w = (F.col(weight) if weight else F.lit(1)).cast("double")
    at = [F.get("white", F.lit(i)) for i in range(components)]
    means = white.groupBy("dim").agg(F.sum(w).alias("total"), *[(F.sum(w * c) / F.sum(w)).alias(f"m{i}") for i, c in enumerate(at)])
    both = white.join(F.broadcast(means), "dim")  # One row for each vector length.
    entries = []
    for i in range(components):
        for j in range(i, components):
            entry = F.sum(w * (at[i] - F.col(f"m{i}")) * (at[j] - F.col(f"m{j}"))) / F.first("total")
            entries.append(F.coalesce(F.abs(entry - F.lit(1.0 if i == j else 0.0)), F.lit(0.0)))
    worst = F.greatest(*entries) if len(entries) > 1 else entries[0]
    return both.groupBy("dim").agg(worst.alias("identity_error"))


def whiten(
    df: DataFrame, vector: str = "embedding", weights: str = "one", components: int = COMPONENTS, scale: int = SCALE, least: float = LEAST_SHARE,
) -> DataFrame:
    """One row per remaining row and component: the columns of ``df`` and ``component, n, deviation, whitened, explained, identity_error``.

    ``weights``: ``one`` for each distinct vector once, ``count`` for as often as it occurs. A row goes if its vector is null or has null, NaN or
    infinite entries. Vectors of each length are fitted by themselves; an empty vector has no components. Components are numbered from 1 by
    falling variance, equal ones in the solver's order. One without variance is not given: a single distinct vector, or all of equal vectors, has
    no component. Repeated rows stay, each with the same values. An empty table gives no rows. Columns of ``df`` with the name of a result get
    ``_`` appended. ``deviation`` beyond 64 bits is an error.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights must be one or count")
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    taken = [*names, "x", "rows", "dim", "white", "__splits", "__salt"]
    clean = df.select(*[F.col(f"`{c}`").alias(free_name([*taken, *(o for o in df.columns if o != c)], c)) for c in df.columns])
    source = clean.columns[df.columns.index(vector)]
    whole = whole_vectors(clean, source, "x", scale)
    classes = written(whole.groupBy("x").agg(F.count(F.lit(1)).alias("rows")), "vectors")
    weight = "rows" if weights == "count" else None
    model = fit(classes, "x", weight)
    white = written(classes.select("x", "rows").mapInArrow(_whitened(model, components, least), _WHITE), "white")
    checked = white.join(F.broadcast(identity_errors(white, weight, components)), "dim")
    back = lookup_by_group(whole, checked, ["x"], "rows", "inner")
    return back.select(
        *clean.columns, "n", "deviation", F.posexplode(F.arrays_zip("white", "explained")).alias("component", "pair"), "identity_error",
    ).select(
        *clean.columns, (F.col("component") + 1).alias("component"), "n", "deviation", F.col("pair.white").alias("whitened"),
        F.col("pair.explained").alias("explained"), "identity_error",
    )
