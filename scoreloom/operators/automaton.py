"""Verbatim search of many passages in many texts (survey row J8): one automaton per shard of the passages, one reading of a text per shard.

A text never leaves its row; only hits do. Passages are dealt into shards of a bounded number of characters, and one shard is on the driver and
broadcast at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.intervals import join_split
from scoreloom.session import scratch_path

#: Characters of the passages of one shard; the automaton takes some fifty bytes for each.
SHARD_CHARS = 1 << 21

#: The automaton of the shard this worker is on. A worker serves many tasks of a pass.
_BUILT: dict[str, object] = {}


def _automaton(token: str, texts: Sequence[str]):
    if token not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        found = ahocorasick.Automaton()
        for number, text in enumerate(texts):
            found.add_word(text, number)
        found.make_automaton()
        _BUILT[token] = found
    return _BUILT[token]


def hits(automaton, text: str | None) -> set[int]:
    """Numbers of the passages that ``text`` holds."""
    return {number for _, number in automaton.iter(text)} if text else set()


def contained_passages(
    docs: DataFrame, passages: DataFrame, doc_id: str, passage_id: str, doc_text: str = "text", passage_text: str = "text",
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """All distinct (document id, passage id) whose document contains the passage verbatim (J8 across corpora).

    Null and empty texts match nothing, null ids stay. A passage of any length is looked for whole; one longer than a shard has a shard to itself.
    Equal passages are looked for once. A larger set of passages is more passes over the documents.
    """
    spark = docs.sparkSession
    own = passages.select(F.col(passage_id).alias("pid"), F.col(passage_text).alias("ptext"), F.md5(F.col(passage_text)).alias("key")).filter(
        F.length("ptext") > 0
    )
    path = scratch_path(spark, "passages")
    own.groupBy("key").agg(F.first("ptext").alias("ptext")).write.parquet(path)
    distinct = spark.read.parquet(path)
    n_shards = -(-(distinct.agg(F.sum(F.length("ptext"))).first()[0] or 0) // shard_chars)
    texts = docs.select(F.col(doc_id).alias("did"), F.col(doc_text).alias("dtext"))
    kind = dict(texts.dtypes)["did"]
    shards = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, n_shards))))
    found = None
    for shard in range(n_shards):
        rows = shards.filter(F.col("shard") == shard).orderBy("key").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r["key"] for r in rows], [r["ptext"] for r in rows]))
        token = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            keys, patterns = shared.value
            automaton = _automaton(token, patterns)
            for batch in batches:
                places, names = [], []
                for i, text in enumerate(batch.column(1)):
                    numbers = hits(automaton, text.as_py())
                    places += [i] * len(numbers)
                    names += [keys[n] for n in numbers]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(names, pa.string())], names=["did", "key"])

        out = scratch_path(spark, "passage-hits")
        texts.mapInArrow(scan, f"did {kind}, key string").distinct().write.parquet(out)
        shared.unpersist()
        part = spark.read.schema(f"did {kind}, key string").parquet(out)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], f"did {kind}, key string")
    pairs = join_split(found, own.select("pid", "key"), ["key"]).select("did", "pid").distinct()
    return pairs.select(F.col("did").alias(doc_id), F.col("pid").alias(passage_id))
