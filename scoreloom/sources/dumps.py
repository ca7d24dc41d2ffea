"""Response dumps: tolerant reader, one schema for two dialects, sinks per step and per failure tag."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.sources.json_split import JsonDocuments

# Keys under which dumps hold their payload, their response text and their identity.
PAYLOAD_KEYS = ("samples", "generations", "data")
RESPONSE_KEYS = ("response", "output", "generation", "pred", "text", "completion")
ID_KEYS = ("sample_id", "index", "uid")

RECORD_DDL = (
    ", ".join(f"{k} string" for k in RESPONSE_KEYS) + ", sample_id string, index string, uid string, ground_truth string, "
    "extra_info struct<sample_id:string,index:string>, _corrupt_record string"
)


def _filled(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def dump_fields(record: Column) -> list[Column]:
    """response, sample_id and ground_truth of a parsed record: the first filled alias wins."""
    response = F.coalesce(*[_filled(record[k]) for k in RESPONSE_KEYS])
    ids = [_filled(record["extra_info"][k]) for k in ("sample_id", "index")] + [_filled(record[k]) for k in ID_KEYS]
    return [response.alias("response"), F.coalesce(*ids).alias("sample_id"), record["ground_truth"].alias("ground_truth")]


def parse_dump_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSONL lines to records (S2); blank lines, broken lines and records without text are left out."""
    filled = lines.filter(F.trim(F.col(line)) != "")
    rec = F.from_json(F.col(line), RECORD_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    keep = [c for c in lines.columns if c != line]
    out = filled.withColumn("__r", rec).filter(F.col("__r._corrupt_record").isNull())
    return out.select(*keep, *dump_fields(F.col("__r"))).filter(F.col("response").isNotNull())


def corrupt_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """How many lines were blank or could not be parsed."""
    rec = F.from_json(F.col(line), RECORD_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    blank = F.trim(F.col(line)) == ""
    return lines.withColumn("__r", rec).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(blank.cast("long")).alias("blank"),
        F.sum((~blank & F.col("__r._corrupt_record").isNotNull()).cast("long")).alias("corrupt"),
    )


_RECORD = RECORD_DDL.replace(", _corrupt_record string", "")
_ITEM = "struct<" + ", ".join(p.replace(" ", ":", 1) for p in _RECORD.split(", ")) + ">"
_DOCUMENT = _RECORD + ", " + ", ".join(f"{k} array<{_ITEM}>" for k in PAYLOAD_KEYS)


def _items(documents: DataFrame) -> DataFrame:
    """The records of parsed documents: those under the first payload key that is there, else the document itself."""
    own = F.struct(*[F.col(p.split(" ", 1)[0]) for p in _RECORD.split(", ")])
    items = F.coalesce(*[F.col(k) for k in PAYLOAD_KEYS], F.array(own))
    return documents.select(F.explode(items).alias("r")).select(*dump_fields(F.col("r")))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump file or folder (S2): JSONL, or JSON documents with the records at top level or under a payload key.

    A document of any size is read in byte ranges. Only documents without an array at top level or under a payload key, one record each, are
    read whole; their paths pass through the driver.
    """
    if not path.rstrip("/").endswith(".json"):
        return parse_dump_lines(spark.read.text(path))
    documents = JsonDocuments(spark, path)
    records = documents.records()
    chosen = documents.chosen_keys(PAYLOAD_KEYS)
    listed = records.filter("key is null").select(F.from_json("value", _DOCUMENT).alias("d")).select("d.*")
    under = records.join(F.broadcast(chosen), ["file", "key"]).select(F.from_json("value", _RECORD).alias("r")).select(*dump_fields(F.col("r")))
    found = _items(listed).unionByName(under)
    single = documents.ranges.filter("top = '{'").select("file").distinct().join(chosen, "file", "left_anti")
    paths = [unquote(r["file"]) for r in single.collect()]
    if paths:
        found = found.unionByName(_items(spark.read.schema(_DOCUMENT).option("multiLine", True).json(paths)))
    return found.filter(F.col("response").isNotNull())


SAMPLE_DDL = (
    "doc struct<id:bigint,question_type:string,ground_truth:string,options:array<string>,dataset:string,scene_name:string>, "
    "filtered_resps array<string>, id bigint, question_type string, ground_truth string, options array<string>, dataset string, "
    "scene_name string, response string, finish_reason string, output_tokens bigint, truncated boolean"
)


def normalise_samples(df: DataFrame) -> DataFrame:
    """Harness rows (``doc`` and ``filtered_resps``) and flat inference rows in one sample schema (S3)."""
    nested = F.col("doc").isNotNull()
    pick = lambda c: F.when(nested, F.col(f"doc.{c}")).otherwise(F.col(c)).alias(c)
    return df.select(
        *[pick(c) for c in ("id", "question_type", "ground_truth", "options", "dataset", "scene_name")],
        F.when(nested, F.get("filtered_resps", F.lit(0))).otherwise(F.col("response")).alias("response"),
        F.when(~nested, F.col("finish_reason")).alias("finish_reason"),
        F.when(~nested, F.col("output_tokens")).alias("output_tokens"),
        F.coalesce(F.col("truncated"), F.lit(False)).alias("truncated"),
        F.when(nested, "harness").otherwise("inference").alias("dialect"),
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return normalise_samples(spark.read.schema(SAMPLE_DDL).json(path))


def dump_rollouts(df: DataFrame, out: str, step: str = "step") -> None:
    """Rollouts as JSON lines, one folder per step (S5). A step that is written again replaces its folder; other steps stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(step).json(out)


def dump_samples(df: DataFrame, out: str, tag: str = "failure_reason") -> None:
    """All samples, and the same samples split by failure tag."""
    df.write.mode("overwrite").json(f"{out}/samples")
    df.write.mode("overwrite").partitionBy(tag).json(f"{out}/by_{tag}")
