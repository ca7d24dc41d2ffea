"""Shards that each match the mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash inside their source, and the row of rank ``r`` (from 1) of ``n`` gets the fraction ``(2r - 1) / 2n``.
Sorted by fraction, every stretch of the order holds the sources in proportion, so the order is cut into equal runs of rows. Ranks are
taken inside hash ranges and shifted by the counts of the ranges before; no task sees a whole source. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.hashing import hash_bucket, stable_hash
from scoreloom.llm.common import free_name
from scoreloom.operators.groups import join_null_safe, ranked

SEED = "shards"
#: Ranges of the fraction, in two levels, for the ranks over all rows.
RANGES = 1024


def with_shards(
    df: DataFrame, shards: int, doc_id: str = "doc_id", source: str = "source", tie: Column | None = None, seed: str = SEED,
) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard); shard sizes differ by one row at most.

    A null source is a stratum of its own, null ids are shuffled like any other. Repeated ids are told apart by ``tie``; fully repeated rows
    take neighbouring ranks. With fewer rows than shards the last shards are empty. Column names ``shard`` and ``slot`` must be free.
    """
    clash = {"shard", "slot"} & {c.lower() for c in df.columns}
    if clash or shards < 1:
        raise ValueError(f"shards must be positive and column names free: {sorted(clash)}")
    stem = free_name(df, "__i")
    h, r, f, n = (f"{stem}{x}" for x in "hrfn")
    tied = tie if tie is not None else F.lit(0)
    shuffled = df.withColumn(h, stable_hash(F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), seed=seed))
    coarse = {f"{stem}a": F.substring(F.col(h), 1, 2), f"{stem}b": hash_bucket(F.col(h))}
    inside = ranked(shuffled, [source], [F.col(h), F.col(doc_id), tied], coarse, r)
    sizes = df.groupBy(source).agg(F.count(F.lit(1)).alias(n))
    placed = join_null_safe(inside, sizes, [source], "left").withColumn(f, (2 * F.col(r) - 1) / (2 * F.col(n)))
    ranges = {f"{stem}u": F.floor(F.col(f) * RANGES), f"{stem}v": F.floor(F.col(f) * RANGES * RANGES)}
    total = df.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    place = ranked(placed, [], [F.col(f), F.col(source), F.col(h), F.col(doc_id), tied], ranges, f"{stem}p").withColumn(f"{stem}t", total)
    p, t = F.col(f"{stem}p") - 1, F.col(f"{stem}t")
    # The first (t mod shards) shards have one row more.
    small, longer = F.floor(t / shards), t % shards
    edge = longer * (small + 1)
    shard = F.when(p < edge, F.floor(p / (small + 1))).otherwise(longer + F.floor((p - edge) / F.greatest(small, F.lit(1))))
    first = shard * small + F.least(shard, longer)
    return place.select(*df.columns, shard.cast("int").alias("shard"), (p - first).cast("long").alias("slot"))
