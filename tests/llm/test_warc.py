"""WARC bundles: exact round trip, seek table, look-up by identifier, odd rows."""

import base64
import hashlib
import io
from collections import defaultdict

import zstandard

from scoreloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first long"


def plain(rows, least=0):
    groups = defaultdict(list)
    for page, _, html, *_ in rows:
        groups[html or ""].append(page)
    out = []
    for page, url, html, *_ in rows:
        body = (html or "").encode()
        known = [p for p in groups[html or ""] if p is not None]
        first = min(known) if known and len(body) >= least else page
        out.append((
            page, url, "response" if page == first else "revisit", None if page == first else first, len(body),
            base64.b32encode(hashlib.sha1(body).digest()).decode(),
        ))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/%41\r\nx", "<p>same</p>", "clash", 5), (9, "http://b", "<p>same</p>", None, None), (5, None, "<p>same</p>", "x", 1),
    (2, "http://c", None, "x", 1), (3, "", "", "x", 1), (None, "http://d", "<p>same</p>", "x", 1), (None, None, "alone ü\U0001f600", None, None),
    (4, "http://e", "WARC/1.1\r\n\r\n\r\n\r\n" * 3, "x", 1), (6, "http://f", "x" * 700_000, "x", 1), (8, "u", "twice", "x", 1), (8, "u", "twice", "x", 1),
]


def read(spark, path, **how):
    return sorted(
        ((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_records(spark, path, **how).collect()),
        key=repr,
    )


def test_round_trip_of_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for least in (0, 8, 10**6):
        path = str(tmp_path / f"bundles{least}")
        warc.write_bundles(df, path, least=least, frame_bytes=200, bundle_bytes=300)
        assert read(spark, path) == plain(ROWS, least)
    found = warc.read_records(spark, str(tmp_path / "bundles0"), payloads=True).filter("record_type = 'response'").collect()
    want = {r[0]: (r[2] or "").encode() for r in ROWS}
    assert all(bytes(r["payload"]) == want[r["page_id"]] for r in found) and len(found) == 7


def test_empty_table(spark, tmp_path):
    warc.write_bundles(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).collect() == [] and warc.read_index(spark, str(tmp_path / "none")).collect() == []


def test_records_by_identifier(spark, tmp_path):
    path = str(tmp_path / "bundles")
    warc.write_bundles(spark.createDataFrame(ROWS, SCHEMA).repartition(2), path, frame_bytes=200, bundle_bytes=300)
    wanted = spark.createDataFrame([("urn:page:4",), ("urn:page:8",), ("urn:page:77",), (None,), ("urn:page:9",), ("urn:page:4",)], "record_id string")
    got = warc.records_at(spark, path, wanted).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == [(4, "response", None), (8, "response", None), (8, "response", None), (9, "revisit", 1)]
    assert {bytes(r["payload"]).decode() for r in got if r["page_id"] == 4} == {ROWS[7][2]}
    index = {r["record_id"]: r for r in warc.read_index(spark, path).collect()}
    assert len(index) == 9


def test_files_are_plain_zstandard(spark, tmp_path):
    path, folder = str(tmp_path / "bundles"), f"file://{tmp_path}/files"
    warc.write_bundles(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path, frame_bytes=200)
    files = warc.export_bundles(spark, path, folder).collect()
    assert len(files) == 1
    data = (tmp_path / "files" / f"{files[0]['bundle']}.warc.zst").read_bytes()
    assert len(data) == files[0]["bytes"]
    # Any reader of Zstandard skips the seek table and sees one WARC file.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    at, kinds = 0, []
    while at < len(whole):
        fields, _, at = warc.parsed(whole, at)
        kinds.append(fields["warc-type"])
    assert len(kinds) == len(ROWS) and kinds.count("revisit") == 4
    bundle = warc.Bundle(data)
    assert b"".join(bundle.frame(i) for i in range(len(bundle.sizes))) == whole and len(bundle.sizes) > 3
