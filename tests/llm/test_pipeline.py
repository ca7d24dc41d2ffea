import corpus_pipeline

from scoreloom.llm import decontam, queries

from .conftest import SMALL


def test_entry_lists_every_operator():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert after and all(kept[i] == t for i, t in after.items())
        if name != "mix":
            assert len(rows) == len(after) and len(after) >= 0.85 * len(kept)
        if name == "near duplicates":
            assert len(set(after.values())) == len(after)
        if name == "decontamination":
            assert not any(x in t for x in items for t in after.values())
        kept = after
    n = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len(last) == n and sum(r["n_tokens"] for r in last) == max(r["start"] + r["n_tokens"] for r in last)


def test_run_agrees_with_itself(spark):
    first = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_crc32").collect())
    again = sorted(tuple(r) for r in queries_run(spark))
    assert first == again


def queries_run(spark):
    import __spark_entry__ as e

    return e.queries()["pipeline"](spark, SMALL).select("doc_id", "n_tokens", "ids_crc32").collect()


def test_extra_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    for name in ("language", "leaks", "rules", "__key", "__rank", "__order", "fingerprint", "key", "copies"):
        docs = docs.withColumn(name, docs.lang)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert decontam.OVERLAP == 0.8 and queries.TOKENIZER.endswith(".json")


def test_stages_on_odd_and_empty_tables(spark, odd, nothing, tmp_path):
    """Each stage by itself on nulls, repeats and a long text, and all of them on no rows."""
    rows = [tuple(r) for r in odd.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, odd, SMALL)
        found = [tuple(r) for r in got.collect()]
        if name == "tokens":
            assert len(found) == 11 and found[0][2] >= 1
            continue
        assert got.columns == odd.columns and set(found) <= set(rows)
        if name == "language":
            assert all(r[1] and any(c.isalpha() for c in r[1]) for r in found) and len(found) == 7
        if name == "near duplicates":
            # Texts without words are one group, of the repeated row one stays, and another text under the same id is kept.
            assert len(found) == 7 and {r[1][:7] for r in found if r[0] == 1} == {"the cat", "another"}
        if name == "decontamination":
            assert sorted(map(repr, found)) == sorted(map(repr, rows))
    empty = nothing
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, empty, SMALL).write.parquet(str(tmp_path / str(k)))
        empty = spark.read.parquet(str(tmp_path / str(k)))
        assert empty.columns == nothing.columns and empty.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SMALL).collect() == []
