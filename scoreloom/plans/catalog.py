"""Query catalog: each query is a Spark plan over the given tables, with SQL for the same result where SQL fits.

The column spec fixes names and types on both sides: ``l`` long, ``s`` string, ``b`` boolean, ``d`` double
rounded to 6 digits, ``dN`` double rounded to N digits. Both engines add the same small shift before rounding, so that
values lying exactly between two roundings (means of few two-digit numbers) do not depend on the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    spec: tuple[tuple[str, str], ...]
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}

_TIE_SHIFT = 0.03


def _spark_cast(name: str, kind: str) -> Column:
    col = F.col(name)
    if kind == "l":
        return col.cast("bigint").alias(name)
    if kind == "s":
        return col.cast("string").alias(name)
    if kind == "b":
        return col.cast("boolean").alias(name)
    digits = int(kind[1:] or 6)
    return (F.round(col.cast("double") + F.lit(_TIE_SHIFT / 10**digits), digits) + F.lit(0.0)).alias(name)


def _sql_cast(name: str, kind: str) -> str:
    if kind == "l":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    digits = int(kind[1:] or 6)
    shift = f"{_TIE_SHIFT / 10**digits:.12f}::DOUBLE"
    return f"round(CAST({name} AS DOUBLE) + {shift}, {digits}) + 0.0::DOUBLE AS {name}"


def register(name: str, spec: str, sql: str | None = None):
    """Add a query. ``sql`` is the body of the check; it is wrapped with the casts of ``spec``."""
    columns = tuple(tuple(part.split(":")) for part in spec.split())

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query registered twice: {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_cast(n, k) for n, k in columns])

        text = None
        if sql is not None:
            text = f"SELECT {', '.join(_sql_cast(n, k) for n, k in columns)} FROM (\n{sql.strip()}\n) AS checked"
        CATALOG[name] = Query(name, columns, build, text)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A given table. ``spread`` is for work that is heavy per row: a table stored in fewer splits than the cluster has cores is
    dealt out over all of them; a large table has enough splits and is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df
