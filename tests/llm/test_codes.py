import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoreloom.llm import codes, queries


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip(ids):
    found = codes.Codes(codes.encode(np.array(ids, np.uint32)))
    assert found.all().tolist() == ids
    assert [found[i] for i in range(0, len(ids), 7)] == ids[::7]


def test_places_outside():
    with pytest.raises(IndexError):
        codes.Codes(codes.encode(np.array([1], np.uint32)))[1]


@pytest.fixture(scope="module")
def encoders():
    path = public_tokenizers.path(queries.TOKENIZER)
    return Tokenizer.from_file(path), codes.WordEncoder(path, limit=5)


@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'sAZaéß́Kİ<|>19"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
@settings(max_examples=80, deadline=None)
def test_words_are_encoded_as_whole_texts(encoders, texts):
    whole, encoder = encoders
    texts = [*texts, "a <|endoftext|> b", "It's THE end. " * 5]
    got = encoder(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_file_of_documents(spark, docs, texts, tmp_path):
    path, whole = str(tmp_path / "tokens"), Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    codes.write_tokens(docs, path, queries.token_encoder(), segment_tokens=5000)
    stream, want = [], {}
    for i in sorted(texts):
        ids = whole.encode(texts[i], add_special_tokens=False).ids + [1]
        want[i] = (len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stream += ids
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in codes.read_tokens(spark, path).collect()}
    assert got == want
    places = [0, 1, 4999, 5000, len(stream) // 2, len(stream) - 1, len(stream), -1, None, 1]
    found = codes.tokens_at(spark, path, spark.createDataFrame([(p,) for p in places], "place long")).collect()
    assert {r["place"]: r["token"] for r in found} == {p: stream[p] for p in places if p is not None and 0 <= p < len(stream)}


def test_odd_rows(spark, odd, nothing, tmp_path):
    codes.write_tokens(odd, str(tmp_path / "odd"), queries.token_encoder())
    rows = sorted(codes.read_tokens(spark, str(tmp_path / "odd")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 1, 1, 2, 3, 4, 5, 6, 7]
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert sum(r["n_tokens"] for r in rows[:-1]) == rows[-1]["start"]
    codes.write_tokens(nothing, str(tmp_path / "none"), queries.token_encoder())
    assert codes.read_tokens(spark, str(tmp_path / "none")).count() == 0
