"""Packing queries: O1-O5."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreloom.operators import packing as pk
from scoreloom.plans.catalog import register, table
from scoreloom.plans.fixtures import csv


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("n_chars").alias("length"), "source")


@register("o1_length_batches", "pos:l batch:l slot:l", """
WITH r AS (SELECT doc_id AS pos, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents) SELECT pos, r // 16 AS batch, r % 16 AS slot FROM r""")
def _o1(spark, sf):
    return pk.length_batches(_docs(spark, sf), 16)


@register("o1_grouped_batches", "pos:l source:s batch:l slot:l", """
WITH r AS (SELECT doc_id AS pos, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents) SELECT pos, source, r // 8 AS batch, r % 8 AS slot FROM r""")
def _o1g(spark, sf):
    return pk.length_batches(_docs(spark, sf), 8, group="source")


@register("o2_budget_chunks", "pos:l chunk:l", """
WITH RECURSIVE s AS (SELECT o_orderkey AS pos, row_number() OVER (ORDER BY o_orderkey) AS i, o_custkey % 9 AS c FROM orders),
f AS (SELECT i, pos, c AS load, CAST(0 AS BIGINT) AS chunk FROM s WHERE i = 1
  UNION ALL SELECT s.i, s.pos, CASE WHEN f.load + s.c > 20 THEN s.c ELSE f.load + s.c END, CASE WHEN f.load + s.c > 20 THEN f.chunk + 1 ELSE f.chunk END FROM s JOIN f ON s.i = f.i + 1)
SELECT pos, chunk FROM f""")
def _o2(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 9).alias("n_images"))
    return pk.budget_chunks(o, 20, block=4096).select("pos", "chunk")


@register("o2_budget_chunks_floor", "pos:l chunk:l", """
SELECT o_orderkey AS pos, (sum(o_custkey % 9) OVER (ORDER BY o_orderkey) - o_custkey % 9) // 20 AS chunk FROM orders""")
def _o2f(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 9).alias("n_images"))
    return pk.budget_chunks_floor(o, 20).select("pos", "chunk")


# Item by item: each goes to the first of eight groups with the least workload; then rows of a length are dealt in order of position.
_GREEDY = """
r AS (SELECT doc_id AS pos, n_chars AS length, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i FROM documents),
f AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS length, CAST(0 AS BIGINT) AS bin, list_transform(range(8), lambda x: CAST(0 AS BIGINT)) AS s
  UNION ALL
  SELECT r.i, r.length, list_position(f.s, list_min(f.s)) - 1,
    list_transform(f.s, lambda x, j: CASE WHEN j = list_position(f.s, list_min(f.s)) THEN x + 24576 * r.length + r.length * r.length ELSE x END)
  FROM f JOIN r ON r.i = f.i + 1),
c AS (SELECT length, bin, sum(count(*)) OVER (PARTITION BY length ORDER BY bin) AS upto FROM f WHERE i > 0 GROUP BY length, bin),
q AS (SELECT pos, length, row_number() OVER (PARTITION BY length ORDER BY pos) AS n FROM r),
g AS (SELECT q.pos, q.length, min(c.bin) AS bin FROM q JOIN c ON q.length = c.length AND q.n <= c.upto GROUP BY q.pos, q.length)"""


@register("o3_balance", "pos:l bin:l", f"""WITH RECURSIVE {_GREEDY} SELECT pos, bin FROM g""")
def _o3(spark, sf):
    return pk.balance(_docs(spark, sf), 8).withColumnRenamed("group", "bin")


@register("o3_imbalance", "min:l max:l minmax_diff:l balanced_min:l balanced_max:l mean:d", f"""
WITH RECURSIVE {_GREEDY}, b AS (SELECT (row_number() OVER (ORDER BY pos) - 1) // ((SELECT count(*) FROM g) // 8) AS blk, length FROM g), bs AS (SELECT sum(length) AS s FROM b GROUP BY blk), gs AS (SELECT sum(length) AS s FROM g GROUP BY bin)
SELECT min(bs.s) AS min, max(bs.s) AS max, max(bs.s) - min(bs.s) AS minmax_diff, (SELECT min(s) FROM gs) AS balanced_min, (SELECT max(s) FROM gs) AS balanced_max, sum(bs.s) / 8 AS mean FROM bs""")
def _o3i(spark, sf):
    return pk.imbalance(pk.balance(_docs(spark, sf), 8), 8)


@register("o3_balance_by_uid", "uid:s bin:l rows:l", """
WITH w AS (SELECT source AS uid, sum(24576 * n_chars + n_chars * n_chars) AS load, min(doc_id) AS f, count(*) AS rows FROM documents GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY load DESC, f) - 1 AS r FROM w) SELECT uid, CASE WHEN (r // 4) % 2 = 0 THEN r % 4 ELSE 3 - r % 4 END AS bin, rows FROM r""")
def _o3u(spark, sf):
    out = pk.balance_by_uid(_docs(spark, sf), 4, uid="source")
    return out.groupBy(F.col("source").alias("uid"), F.col("group").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


@register("o3_workload", "doc_id:l load:l", "SELECT doc_id, 24576 * n_chars + n_chars * n_chars AS load FROM documents")
def _o3w(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pk.workload(F.col("n_chars")).alias("load"))


@register("o4_micro_batches", "pos:l micro:l start_at:l", """
WITH t AS (SELECT least(count(*), CAST(ceil(sum(n_chars) / 200000.0::DOUBLE) AS BIGINT)) AS k FROM documents),
r AS (SELECT doc_id AS pos, n_chars AS length, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r, k FROM documents, t),
g AS (SELECT *, CASE WHEN (r // k) % 2 = 0 THEN r % k ELSE k - 1 - r % k END AS g FROM r),
o AS (SELECT g, k, row_number() OVER (ORDER BY sum(24576 * length + length * length) DESC, min(pos) DESC) - 1 AS q FROM g GROUP BY g, k),
m AS (SELECT g, CASE WHEN q % 2 = 0 THEN CAST(ceil(k / 2) AS BIGINT) - 1 - q // 2 ELSE CAST(ceil(k / 2) AS BIGINT) + (q - 1) // 2 END AS micro FROM o)
SELECT pos, micro, coalesce(sum(length) OVER (PARTITION BY micro ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM g JOIN m ON g.g = m.g""".replace('AS "offset"', "AS start_at"))
def _o4(spark, sf):
    return pk.micro_batches(_docs(spark, sf), 200000).withColumnRenamed("offset", "start_at")


@register("o5_token_windows", "vec_id:l win:l inp:s target:s", """
WITH t AS (SELECT vec_id, list_transform(list_concat(embedding, embedding[1:vec_id % 40]), lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS tok, 64 + vec_id % 40 AS n FROM embeddings),
w AS (SELECT *, unnest(range(0, CAST(ceil((n - least(n, 16)) / 9.0::DOUBLE) AS BIGINT) + 1)) AS w FROM t),
b AS (SELECT *, CASE WHEN w = 0 THEN 0 ELSE least(n, 16) + (w - 1) * 9 END AS done, CASE WHEN w = 0 THEN least(n, 16) ELSE least(n, least(n, 16) + w * 9) END AS e FROM w)
SELECT vec_id, w AS win, array_to_string(CASE WHEN w = 0 THEN list_concat([CAST(-1 AS BIGINT)], tok[1:e - 1]) ELSE tok[e - 16:e - 1] END, ',') AS inp, array_to_string(tok[done + 1:e], ',') AS target FROM b""")
def _o5(spark, sf):
    e = table(spark, sf, "embeddings")
    whole = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000.0).cast("bigint"))
    toks = F.concat(whole, F.slice(whole, F.lit(1), (F.col("vec_id") % 40).cast("int")))
    out = pk.token_windows(e.select("vec_id", toks.alias("tokens")), 16, 8, prefix=F.lit(-1).cast("bigint"))
    return out.select("vec_id", F.col("window").alias("win"), csv(F.col("input")).alias("inp"), csv(F.col("target")).alias("target"))
