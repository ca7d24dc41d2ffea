"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.session import scratch_path

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame | Iterable[str], stem: str) -> str:
    """A column name that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """64-bit hash of a text, computed in the JVM; null and the empty text differ."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def with_keys(df: DataFrame, stem: str, keys: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    """``df`` with plain join columns for ``keys`` where null equals null: a join on them and a later window by them share one shuffle."""
    names = []
    for i, key in enumerate(keys):
        zero = F.lit("") if dict(df.select(key.alias("k")).dtypes)["k"] == "string" else F.lit(0)
        for name, value in ((f"{stem}{i}", F.coalesce(key, zero)), (f"{stem}{i}_null", key.isNull())):
            df = df.withColumn(name, value)
            names.append(name)
    return df, names
