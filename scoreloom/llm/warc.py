"""WARC records in seekable Zstandard bundles.

A bundle is a ``.warc.zst`` file: records are gathered into frames that decompress on their own, and a skippable frame at the end holds the seek
table of the public seekable format (compressed and plain size of every frame, their number, and a magic number as the last four bytes). The index
maps a record's identifier to its bundle, its frame and its offset inside the plain frame, so one record costs one frame.

Bundles are rows of a Spark table, so commits and retries are Spark's; ``export_bundles`` gives plain files. Pages of equal payload are found by an
aggregate of digests: the page with the smallest id becomes a ``response``, the others ``revisit`` records that refer to it and hold the HTTP header only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.groups import lookup_by_group

#: Fixed values of the seekable format: magic of the skippable frame with the seek table, and of its last four bytes.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: A frame is closed after the record that brings it to so many plain bytes, a bundle after the frame that brings it to so many compressed ones.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 23
#: Payloads of fewer bytes are stored again instead of referred to.
LEAST_BYTES = 0
#: Fixed values of the WARC standard.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

_BUNDLES = (
    "bundle string, n_records long, record_ids array<string>, frames array<int>, offsets array<long>, lengths array<long>, payload binary"
)
_RECORDS = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _page_of(uri: str) -> int | None:
    number = uri.strip("<>").rsplit(":", 1)[1]
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record; with ``refers_to`` a revisit, whose block is the HTTP header alone. The header states the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        # A line break cannot stand in a header; it is escaped like in any address.
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields in lower case, block, and the place after the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value for name, value in (line.split(": ", 1) for line in lines)}
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return fields, block, end + 8 + size


class BundleWriter:
    """Frames of one bundle as they close, and the place of every record."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor()
        self.parts, self.sizes, self.held, self.plain, self.compressed = [], [], [], 0, 0
        self.ids, self.frames, self.offsets, self.lengths = [], [], [], []

    def add(self, identifier: str, body: bytes) -> None:
        self.ids.append(identifier)
        self.frames.append(len(self.sizes))
        self.offsets.append(self.plain)
        self.lengths.append(len(body))
        self.held.append(body)
        self.plain += len(body)
        if self.plain >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        frame = self.compressor.compress(b"".join(self.held))
        self.parts.append(frame)
        self.sizes.append((len(frame), self.plain))
        self.compressed += len(frame)
        self.held, self.plain = [], 0

    def finish(self) -> bytes:
        if self.held:
            self._close()
        table = b"".join(struct.pack("<2I", *s) for s in self.sizes)
        footer = table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<2I", SKIPPABLE, len(footer)), footer])


class Bundle:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        start = len(data) - 9 - count * entry
        if struct.unpack_from("<2I", data, start - 8) != (SKIPPABLE, len(data) - start):
            raise ValueError("the seek table has another length")
        self.sizes, self.starts, at = [], [], 0
        for i in range(count):
            compressed, plain = struct.unpack_from("<2I", data, start + i * entry)
            self.sizes.append((compressed, plain))
            self.starts.append(at)
            at += compressed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        size, plain = self.sizes[number]
        start = self.starts[number]
        return self.decompressor.decompress(self.data[start : start + size], max_output_size=plain)


def with_first_pages(pages: DataFrame, page_id: str, html: str, least: int = LEAST_BYTES) -> DataFrame:
    """``pages`` with ``first``, the smallest id among pages of equal payload; a small payload is its own first."""
    body = F.coalesce(F.col(html), F.lit(""))
    own = F.concat(F.lit("own:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")))
    keyed = pages.withColumn("digest", F.when(F.octet_length(body) >= least, F.sha2(body, 256)).otherwise(own))
    # Most payloads are alone: only the repeated ones are looked up. SHA-256 decides what is equal.
    repeated = keyed.groupBy("digest").agg(F.min(page_id).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    found = lookup_by_group(keyed, repeated, ["digest"], "copies")
    return found.withColumn("first", F.when(F.col("copies").isNull(), F.col(page_id)).otherwise(F.col("first"))).drop("digest", "copies")


def _bundles(batches: Iterator[pa.RecordBatch], frame_bytes: int, bundle_bytes: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    writer = BundleWriter(frame_bytes)

    def closed() -> pa.RecordBatch:
        payload = writer.finish()
        lists = [pa.list_(t) for t in (pa.string(), pa.int32(), pa.int64(), pa.int64())]
        values = [writer.ids, writer.frames, writer.offsets, writer.lengths]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([f"{part:06d}-{seq:06d}"]), pa.array([len(writer.ids)], pa.int64()),
                *[pa.array([v], t) for v, t in zip(values, lists, strict=True)], pa.array([payload], pa.binary()),
            ],
            names=["bundle", "n_records", "record_ids", "frames", "offsets", "lengths", "payload"],
        )

    for batch in batches:
        for i in range(batch.num_rows):
            page, url, html, first = (batch.column(k)[i].as_py() for k in range(4))
            writer.add(record_id(page), record(page, url, (html or "").encode("utf-8", "surrogatepass"), None if page == first else first))
            if writer.compressed >= bundle_bytes:
                yield closed()
                writer, seq = BundleWriter(frame_bytes), seq + 1
    if writer.ids:
        yield closed()


def write_bundles(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES,
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> None:
    """Write one record per row of ``pages`` to bundles below ``path``.

    A null payload is empty, a null address has no header. Of equal payloads of at least ``least`` bytes, empty ones included, the page with the
    smallest id is a response and the others revisit it; where that id is repeated, each of its rows is a response. A null id comes after all others:
    such pages are responses if all pages of the payload have none. Repeated rows are records of their own under one identifier. One page of any
    length is one frame. An empty table gives no bundles. Extra columns are left out, whatever their names.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    found = with_first_pages(rows, "page_id", "html", least).select("page_id", "url", "html", "first")
    found.mapInArrow(lambda it: _bundles(it, frame_bytes, bundle_bytes), _BUNDLES).write.option("compression", "none").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, bundle, frame, offset, length`` of every record; reads no payload."""
    places = F.arrays_zip("record_ids", "frames", "offsets", "lengths")
    return spark.read.parquet(path).select("bundle", F.explode(places).alias("p")).select(
        F.col("p.record_ids").alias("record_id"), "bundle", F.col("p.frames").alias("frame"), F.col("p.offsets").alias("offset"),
        F.col("p.lengths").alias("length"),
    )


def _row(fields: dict[str, str], block: bytes) -> tuple:
    header, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:])
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(http["Content-Length"])
    if fields["warc-type"] == "response":
        if len(payload) != size or digest_of(payload) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
        refers_to = None
    else:
        payload, refers_to = None, _page_of(fields["warc-refers-to"])
    url = fields.get("warc-target-uri")
    url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if url is not None else None
    name = fields["warc-record-id"].strip("<>")
    return name, _page_of(name), url, fields["warc-type"], refers_to, size, digest, payload


_ROW_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_ROW_NAMES = ["record_id", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ROW_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW_TYPES, strict=True)], names=_ROW_NAMES)


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record of the bundles: identifier, page, address, kind, page referred to, length and digest of the full payload.

    A response's digest is computed from what is stored and must be the one its header states. ``payloads`` adds the stored payload, null for a revisit.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                bundle = Bundle(data.as_py())
                for number in range(len(bundle.sizes)):
                    plain, at, rows = bundle.frame(number), 0, []
                    while at < len(plain):
                        fields, block, at = parsed(plain, at)
                        row = _row(fields, block)
                        rows.append(row if payloads else (*row[:-1], None))
                    yield _batch(rows)

    out = spark.read.parquet(path).select("payload").mapInArrow(read, _RECORDS)
    return out if payloads else out.drop("payload")


def records_at(spark: SparkSession, path: str, wanted: DataFrame, identifier: str = "record_id") -> DataFrame:
    """The records with the distinct identifiers of ``wanted``, with payloads: only the frames that hold them are decompressed.

    An identifier that several rows share gives all of them; an unknown or null one gives none. What is gathered for a bundle is at most its records.
    """
    names = wanted.select(F.col(identifier).alias("record_id")).distinct()
    places = read_index(spark, path).join(names, "record_id").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))
    rows = places.join(spark.read.parquet(path).select("bundle", "payload"), "bundle").select("places", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bundle, number, plain, rows = Bundle(data.as_py()), None, b"", []
                for place in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                    if place["frame"] != number:
                        number, plain = place["frame"], bundle.frame(place["frame"])
                    fields, block, _ = parsed(plain, place["offset"])
                    rows.append(_row(fields, block))
                yield _batch(rows)

    return rows.mapInArrow(read, _RECORDS)


def export_bundles(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write every bundle as ``folder/<bundle>.warc.zst`` and give ``bundle, bytes``; ``folder`` is an address that all executors reach.

    A bundle's name and bytes are fixed by the table, so a repeated task writes the same file again.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with store.open_output_stream(f"{base}/{name}.warc.zst", compression=None) as out:
                    out.write(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data.as_py())], pa.int64())], names=["bundle", "bytes"])

    return spark.read.parquet(path).select("bundle", "payload").mapInArrow(save, "bundle string, bytes long")
