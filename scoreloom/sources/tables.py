"""Table sources: several files as one table, dataset mixes, checked shard merges (survey rows S1, S7, S8)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.operators.joins import require
from scoreloom.operators.sampling import draw_exact
from scoreloom.sources.json_split import JsonDocuments


def read_tables(
    spark: SparkSession, paths: Sequence[str], fmt: str | None = None, schema: T.StructType | str | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Parquet, JSON array or JSONL files concatenated by column name (S1); any other format is an error.

    Rows carry ``source_no``, the place of their path in the list, and for parquet ``row_no``, counted from 0 through all files of the path in the
    order of their names. ``max_rows`` keeps the first lines of every JSONL file.
    """

    def one(no: int, path: str) -> DataFrame:
        kind = fmt or path.rstrip("/").rsplit(".", 1)[-1]
        reader = spark.read if schema is None else spark.read.schema(schema)
        if kind == "parquet":
            df = _numbered(reader.parquet(path))
        elif kind == "json":
            documents = JsonDocuments(spark, path)
            # An array is cut into its records, in many tasks. A document that is one object is one row.
            df = reader.json(documents.record_lines()) if documents.tops == {"["} else reader.option("multiLine", True).json(path)
        elif kind == "jsonl":
            if max_rows is not None:
                lines = spark.read.text(path).limit(max_rows)
                if schema is None:
                    raise ValueError("max_rows needs a schema, so that the file is not read twice")
                df = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
            else:
                df = reader.json(path)
        else:
            raise ValueError(f"unsupported file format: {kind}")
        return df.withColumn("source_no", F.lit(no))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(i, p) for i, p in enumerate(paths)])


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``row_no``: the row's index in its file, shifted by the rows of the files before it (a list with one entry per file)."""
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    earlier = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)
    files = df.groupBy(path.alias("__path")).agg(F.count(F.lit(1)).alias("__rows"))
    shifts = files.select("__path", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__shift"))
    rows = df.select("*", path.alias("__of"), index.alias("row_no"))
    out = rows.join(F.broadcast(shifts), F.col("__of") == F.col("__path"))
    return out.select(*df.columns, (F.col("row_no") + F.col("__shift")).alias("row_no"))


@dataclass(frozen=True)
class MixSource:
    """A named dataset: how to read it, its identity column, and the labels its rows get."""

    read: Callable[[SparkSession], DataFrame]
    id_col: str
    data_path: str
    tag: str


def parse_mix(spec: str) -> list[tuple[str, float]]:
    """``name%rate`` comma list: the rate is a whole percentage, 100 when left out."""
    out = []
    for entry in (e.strip() for e in spec.split(",")):
        hit = re.search(r"%(\d+)$", entry)
        out.append((re.sub(r"%(\d+)$", "", entry), int(hit.group(1)) / 100.0 if hit else 1.0))
    return out


def load_mix(spark: SparkSession, spec: str, registry: dict[str, MixSource], seed: int = 0) -> DataFrame:
    """Datasets of a mix, each drawn to exactly ``floor(n * rate)`` rows and labelled (S7); unknown names are an error."""
    parts = []
    for name, rate in parse_mix(spec):
        if name not in registry:
            raise ValueError(f"unknown dataset: {name}")
        src = registry[name]
        df = src.read(spark)
        if rate < 1.0:
            df = draw_exact(df, rate, src.id_col, seed=seed)
        parts.append(df.withColumn("dataset", F.lit(name)).withColumn("data_path", F.lit(src.data_path)).withColumn("tag", F.lit(src.tag)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_shards(
    spark: SparkSession, path: str, shards: int, id_col: str = "id", fmt: str = "json", schema: T.StructType | str | None = None
) -> DataFrame:
    """Shards as one table in id order (S8): exactly ``shards`` files and no id twice, else the job fails."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    found = len(df.inputFiles())
    if found != shards:
        raise ValueError(f"expected {shards} shards, found {found}")
    rest = [c for c in df.columns if c != id_col]
    once = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__r"))
    once = require(once, F.col("__n") == 1, "duplicate ids after merge")
    return once.select(id_col, "__r.*").select(*df.columns).orderBy(id_col)
