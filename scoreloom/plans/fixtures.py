"""How the given tables stand in for rollouts, token series and plans, on the Spark side and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.plans.catalog import table

ROLLOUT_SQL = """
rollouts AS (
  SELECT event_id AS pos, event_type AS data_source, user_id, event_type || '/' || CAST(user_id AS VARCHAR) AS uid,
         value AS score, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 37 AS length,
         CAST(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) AS BIGINT) AS step, ts
  FROM events)
"""


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored responses: prompt = event type and user, score = value, length and step derived."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("data_source"),
        "user_id",
        F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("uid"),
        F.col("value").alias("score"),
        k.alias("k"),
        (F.lit(1) + k % 37).alias("length"),
        F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("step"),
        "ts",
    )


TOKEN_SQL = """
tok AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS uid, 32 + vec_id % 33 AS n, g.i AS t,
         CAST(embedding[g.i] AS DOUBLE) AS reward,
         CAST(embedding[65 - g.i] AS DOUBLE) * 0.5 AS value,
         -4.0::DOUBLE * abs(CAST(embedding[g.i] AS DOUBLE)) AS old_lp,
         -4.0::DOUBLE * abs(CAST(embedding[g.i] AS DOUBLE)) - CAST(embedding[65 - g.i] AS DOUBLE) AS roll_lp,
         exp(-8.0::DOUBLE * abs(CAST(embedding[g.i] AS DOUBLE))) + 0.1::DOUBLE AS sps,
         CASE WHEN g.i <= 32 + vec_id % 33 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m
  FROM embeddings, range(1, 65) g(i))
"""


def token_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as token series of 64 positions with a trailing mask; the second policy reads the vector backwards."""
    e = table(spark, sf_dir, "embeddings", spread=True)
    v = F.col("e")
    back = F.reverse(v)
    base = e.select(
        "vec_id",
        F.col("vec_id").alias("pos"),
        F.col("label").cast("string").alias("uid"),
        (F.lit(32) + F.col("vec_id") % 33).alias("n"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    return base.select(
        "vec_id", "pos", "uid", "n", v.alias("reward"),
        F.transform(back, lambda x: x * 0.5).alias("value"),
        F.transform(v, lambda x: F.lit(-4.0) * F.abs(x)).alias("old_log_prob"),
        F.zip_with(v, back, lambda x, y: F.lit(-4.0) * F.abs(x) - y).alias("rollout_log_prob"),
        F.transform(v, lambda x: F.exp(F.lit(-8.0) * F.abs(x)) + F.lit(0.1)).alias("sum_pi_squared"),
        F.transform(v, lambda x, i: F.when(i < F.col("n"), 1.0).otherwise(0.0)).alias("mask"),
    )


def per_token(df: DataFrame, *columns: str, row: str = "vec_id") -> DataFrame:
    """One output row per token, ``t`` counted from 1."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    flat = df.select(row, F.posexplode(zipped).alias("i", "z"))
    return flat.select(row, (F.col("i") + 1).alias("t"), *[F.col("z")[c].alias(c) for c in columns])


EVAL_SQL = """
evals AS (
  SELECT l_orderkey, l_linenumber AS views, p_type AS type, p_brand AS family, 'b' || CAST(l_suppkey % 2 AS VARCHAR) AS budget,
         CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE WHEN l_returnflag = 'R' THEN l_discount * 5 ELSE 0.0::DOUBLE END AS score,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS correct,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS answered,
         CAST(l_quantity AS BIGINT) AS tokens, CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END AS truncated,
         substr('ABCD', CAST(l_linenumber % 4 + 1 AS INTEGER), 1) AS gold,
         substr('ABCDE', CAST(l_suppkey % 5 + 1 AS INTEGER), 1) AS pred,
         CAST(l_suppkey % 5 AS BIGINT) AS extra
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def evals(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Order lines as scored benchmark rows: type and family from the part, verdicts from the flags."""
    li, p = table(spark, sf_dir, "lineitem", spread), table(spark, sf_dir, "part")
    flag = F.col("l_returnflag")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", F.col("l_linenumber").alias("views"), F.col("p_type").alias("type"), F.col("p_brand").alias("family"),
        F.concat(F.lit("b"), (F.col("l_suppkey") % 2).cast("string")).alias("budget"),
        F.when(flag == "A", 1.0).when(flag == "R", F.col("l_discount") * 5).otherwise(0.0).alias("score"),
        (flag == "A").cast("int").alias("correct"),
        (F.col("l_linestatus") == "F").cast("int").alias("answered"),
        F.col("l_quantity").cast("bigint").alias("tokens"),
        (F.col("l_quantity") >= 49).cast("int").alias("truncated"),
        F.substring(F.lit("ABCD"), (F.col("l_linenumber") % 4 + 1).cast("int"), F.lit(1)).alias("gold"),
        F.substring(F.lit("ABCDE"), (F.col("l_suppkey") % 5 + 1).cast("int"), F.lit(1)).alias("pred"),
        (F.col("l_suppkey") % 5).alias("extra"),
    )


PLAN_SQL = """
lines AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS mx, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
plan AS (
  SELECT o_orderkey AS id, o_orderpriority AS source, CAST(o_custkey % 400 AS VARCHAR) AS scene, o_orderstatus AS question_type,
    CAST(coalesce(n, 0) AS INTEGER) AS n_views,
    CASE WHEN coalesce(n, 0) >= 2 AND o_custkey % 5 = 0 THEN [0]
         WHEN coalesce(n, 0) >= 3 AND o_custkey % 5 = 1 THEN [1, CAST(n AS INTEGER) - 1] ELSE []::INTEGER[] END AS required,
    CASE WHEN coalesce(n, 0) >= 2 AND o_custkey % 5 = 0 THEN 'From the first image, see Frame-0 here.'
         WHEN coalesce(n, 0) >= 3 AND o_custkey % 5 = 1 THEN 'Compare Frame-1 with Frame-' || (n - 1) || ' and Frame-1.' ELSE 'Where is the door?' END AS body,
    CASE o_custkey % 11 WHEN 3 THEN 'it is Frame-2' WHEN 4 THEN 'the second view' ELSE 'left' END AS answer,
    o_totalprice AS price
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey)
"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as plan rows: priority = source, customer group = scene, number of lines = album size."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders", spread=True)
    n = F.coalesce(F.col("n"), F.lit(0)).cast("int")
    five, eleven = F.col("o_custkey") % 5, F.col("o_custkey") % 11
    anchor, pair = (n >= 2) & (five == 0), (n >= 3) & (five == 1)
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"),
        (F.col("o_custkey") % 400).cast("string").alias("scene"), F.col("o_orderstatus").alias("question_type"),
        n.alias("n_views"),
        F.when(anchor, F.array(F.lit(0))).when(pair, F.array(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")).alias("required"),
        F.when(anchor, "From the first image, see Frame-0 here.")
        .when(pair, F.concat(F.lit("Compare Frame-1 with Frame-"), (n - 1).cast("string"), F.lit(" and Frame-1.")))
        .otherwise("Where is the door?").alias("body"),
        F.when(eleven == 3, "it is Frame-2").when(eleven == 4, "the second view").otherwise("left").alias("answer"),
        F.col("o_totalprice").alias("price"),
    )


def csv(arr):
    """An array as comma-joined text, so results stay flat."""
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")
