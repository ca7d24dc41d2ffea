"""The operators applied to the given tables: one query each, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import codes, cotrain, decontam, langid, licenses, lm, merkle, mixing, rules, shards, simhash, sql, warc, whitening
from scoreloom.llm.common import documents
from scoreloom.session import scratch_path

TOKENIZER = "word_bpe_49k.json"


def token_encoder(name: str = TOKENIZER):
    """A maker of the text encoder, for use inside tasks."""

    def make():
        import public_tokenizers

        return codes.word_encoder(public_tokenizers.path(name))

    return make


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified leak: ``doc_id, item_id, score, overlap, question_overlap, answer_overlap``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.with_leaks(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.inline("leaks"))


def language_model(docs: DataFrame) -> langid.Centroids:
    return langid.fit(docs.filter(~held_out()))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_model(docs)
    found = langid.with_language(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
        F.col("language.margin").alias("margin"), F.col("language.rejected").alias("rejected"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
        F.round("score", 6).alias("score"), "rarest_word",
    )


def op4_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document; documents of the held-out quarter take no part in training."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    addresses = cotrain.page_addresses(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    model = cotrain.fit(docs.filter(~held_out()), labels, addresses)
    found = cotrain.scores(docs, model, addresses)
    return found.select("doc_id", held_out().alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    codes.write_tokens(documents(spark, sf_dir), path, token_encoder())
    return codes.read_tokens(spark, path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    )
    placed = shards.with_shards(rows, 8, tie=F.struct("size", "text_crc32"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed and mean conditional log-probability of every document."""
    return lm.corpus_scores(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return rules.with_rules(docs).select("doc_id", "rules.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = mixing.copies(documents(spark, sf_dir))
    return decided.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies",
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; where 2 divides the CRC-32 of the id, the text has lost its line feeds since."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = merkle.leaf_hash([*columns[:-1], F.translate("text", "\n", "")])
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, tampered)
    return merkle.manifest(documents(spark, sf_dir), merkle.leaf_hash(columns), changed).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source",
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC bundles and read back from them."""
    path = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write_bundles(pages, path)
    return warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector, fitted on each distinct vector once."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.whiten(vectors).drop("embedding")


QUERIES = {
    f.__name__: f for f in (op1_decontamination, op2_language, op3_licenses, op4_co_training, op5_token_codes, op6_sharding, op7_simhash, op8_masked_lm, op9_quality_rules, op10_mixing, op11_merkle, op12_warc, op13_whitening)
}
SQL = {"op3_licenses": sql.licenses(), "op6_sharding": sql.sharding(), "op11_merkle": sql.merkle(), "op12_warc": sql.warc()}
