"""Token ids as directly addressable codes.

An id is cut into chunks of ``WIDTH`` bits, lowest first. Level 0 holds the first chunk of every token; a continuation bitmap says which
tokens go on, and their next chunks form level 1, and so on. A rank directory counts the set bits before every block of a bitmap, so any
token is read by one array access, one bit and one rank per level; no block is decoded.

A file is a Spark table of segments (Parquet, one row per segment, uncompressed), so commits and retries are Spark's. ``payload`` is
self-contained: the magic ``DAC1``, little-endian unsigned 32-bit numbers (chunk width, tokens, levels, then per level its length), and
per level the chunk bytes, the bitmap (padded to 8 bytes) and the directory of unsigned 32-bit ranks.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.common import text_key

MAGIC = b"DAC1"
WIDTH = 8
RANK_BLOCK = 512
#: A segment is closed after the document that brings it to so many tokens.
SEGMENT_TOKENS = 1 << 19
#: Pieces whose ids a Python worker keeps in a generation; there are two.
CACHE_WORDS = 400_000

SEGMENTS = (
    "part int, seq int, n_docs int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, payload binary"
)


def encode(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids."""
    levels, parts, rest = [], [], np.ascontiguousarray(ids, np.uint32)
    while True:
        chunk, high = (rest & np.uint32(255)).astype(np.uint8), rest >> np.uint32(WIDTH)
        more = high != 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % 8, np.uint8)])
        per_block = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BLOCK)) if len(more) else np.empty(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(per_block)[:-1])).astype("<u4") if len(more) else np.empty(0, "<u4")
        levels.append(len(chunk))
        parts += [chunk.tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest = high[more]
        if not len(rest):
            break
    return b"".join([MAGIC, struct.pack(f"<3I{len(levels)}I", WIDTH, len(ids), len(levels), *levels), *parts])


class Codes:
    """Random access and whole decoding of one payload; the arrays are views of its bytes."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token file")
        self.width, self.n, n_levels = struct.unpack_from("<3I", payload, 4)
        lengths = struct.unpack_from(f"<{n_levels}I", payload, 16)
        at, self.levels = 16 + 4 * n_levels, []
        for length in lengths:
            n_bits, n_ranks = -(-length // 64) * 8, -(-length // RANK_BLOCK)
            chunk = np.frombuffer(payload, np.uint8, length, at)
            bitmap = np.frombuffer(payload, np.uint8, n_bits, at + length)
            ranks = np.frombuffer(payload, "<u4", n_ranks, at + length + n_bits)
            self.levels.append((chunk, bitmap, ranks))
            at += length + n_bits + 4 * n_ranks

    def __getitem__(self, i: int) -> int:
        """The token at place ``i``: one chunk, one bit and one rank per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunk, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (self.width * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            before = bitmap[block * RANK_BLOCK // 8 : i >> 3]
            tail = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + tail.bit_count()
        return value

    def all(self) -> np.ndarray:
        values = None
        for chunk, bitmap, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            if values is not None:
                more = np.unpackbits(bitmap, bitorder="little")[: len(chunk)].astype(bool)
                here[more] |= values << np.uint32(self.width)
            values = here
        return values


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer lower-cases, splits a text into letter runs, single digits and runs of other signs, and encodes every piece by itself. In
    Latin-1 texts a pattern gives the same pieces, and pieces repeat, so their ids are kept as bytes and a text is a join of them. New pieces of
    a block are encoded together as one text, whose ids part where a piece ends. Other texts, and texts that may hold special tokens, are
    encoded whole.
    """

    #: The tokenizer's split rule on lower-case Latin-1 text.
    LETTERS, DIGITS, WHITE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
    PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}{WHITE}]+")
    END_OF_WORD = "</w>"

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END_OF_WORD)]] = True
        # Two generations: what was not used since the last turn is forgotten.
        self.limit, self.known, self.old = limit, {}, {}

    def __call__(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text; a null text is empty."""
        return [x for at in range(0, len(texts), 512) for x in self._block(texts[at : at + 512])]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, text: str | None) -> list[str] | bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        return self.PIECE.findall(text.lower())

    def _learn(self, pieces: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(pieces):
            raw, starts = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.known.update(zip(pieces, map(raw.__getitem__, map(slice, starts, starts[1:])), strict=False))
        else:
            self.known.update((p, self._whole(p)) for p in pieces)

    def _block(self, texts: Sequence[str | None]) -> list[bytes]:
        split = [self._pieces(t) for t in texts]
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        wanted = set().union(*(p for p in split if isinstance(p, list))).difference(known)
        seen = wanted.intersection(old)
        known.update((p, old[p]) for p in seen)
        new = list(wanted - seen)
        for at in range(0, len(new), 20_000):
            self._learn(new[at : at + 20_000])
        return [p if isinstance(p, bytes) else b"".join(map(known.__getitem__, p)) for p in split]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker: workers serve many tasks, and so do the vocabulary they have read and the pieces they know."""
    return WordEncoder(path)


def _segments(batches: Iterator[pa.RecordBatch], make: Callable[[], Callable], end_id: int | None, size: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    tokens_of = make()
    end = b"" if end_id is None else struct.pack("<I", end_id)
    ids: list[int | None] = []
    counts: list[int] = []
    held: list[bytes] = []
    total = 0

    def closed() -> pa.RecordBatch:
        payload = encode(np.frombuffer(b"".join(held), "<u4"))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([total], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ],
            names=["part", "seq", "n_docs", "n_tokens", "doc_ids", "doc_tokens", "payload"],
        )

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            piece = batch.slice(at, 512)
            for doc, raw in zip(piece.column(0).to_pylist(), tokens_of(piece.column(1).to_pylist()), strict=True):
                ids.append(doc)
                held.append(raw + end)
                counts.append(len(held[-1]) // 4)
                total += counts[-1]
                if total >= size:
                    yield closed()
                    ids, counts, held, total, seq = [], [], [], 0, seq + 1
    if ids:
        yield closed()


def write_tokens(
    df: DataFrame, path: str, make: Callable[[], Callable], doc_id: str = "doc_id", text: str = "text", end_id: int | None = 1,
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Write the ids of all texts in ascending id order (null ids first, equal ids by text hash) to ``path``.

    ``make`` builds, once per Python worker, a function from texts to little-endian id bytes. Rows are range-partitioned by id; only the
    id and the text move. A null or empty text has no ids of its own, only the end id. Repeated rows are written as often as they occur.
    An empty table gives an empty file.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    placed = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions(F.col("doc_id"), text_key(F.col("text")))
    placed.mapInArrow(lambda it: _segments(it, make, end_id, segment_tokens), SEGMENTS).write.option("compression", "none").parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, seq, docs, counts = (batch.column(i)[row].as_py() for i in (0, 1, 2, 3))
            codes = Codes(batch.column(4)[row].as_py()).all().astype("<u4")
            ends = np.cumsum(np.array(counts, np.int64))
            starts = ends - counts
            crc = [zlib.crc32(codes[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(docs), pa.int32()), pa.array([seq] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                    pa.array(starts), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def segment_starts(segments: DataFrame) -> DataFrame:
    """``(part, seq, first)``: ids before each segment. The totals of the parts, one number per written partition, go through the driver."""
    from pyspark.sql import Window

    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r["part"], before))
        before += r["n"]
    parts = segments.sparkSession.createDataFrame(rows, "part int, part_first long")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside")).join(parts, "part").select(
        "part", "seq", (F.col("part_first") + F.col("inside")).alias("first"),
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the file."""
    segments = spark.read.parquet(path)
    docs = segments.select("part", "seq", "doc_ids", "doc_tokens", "payload").mapInArrow(
        _decoded, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"
    )
    return docs.join(segment_starts(segments), ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32",
    )


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """``place, token`` for the distinct wanted places of the whole id stream: each is looked up in its segment without decoding it.

    The places gathered for a segment are at most its tokens.

    Places outside the stream, and null places, give no row.
    """
    segments = spark.read.parquet(path)
    spans = segment_starts(segments).join(segments.select("part", "seq", "n_tokens"), ["part", "seq"])
    grid = SEGMENT_TOKENS
    spans = spans.filter("n_tokens > 0").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("first") / grid), F.floor((F.col("first") + F.col("n_tokens") - 1) / grid)))
    )
    wanted = places.select(F.col(place).cast("long").alias("place")).filter("place is not null").withColumn("cell", F.floor(F.col("place") / grid))
    inside = (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n_tokens"))
    hits = wanted.distinct().join(spans, "cell").filter(inside).groupBy("part", "seq").agg(
        F.collect_list(F.struct("place", (F.col("place") - F.col("first")).alias("at"))).alias("wanted")
    )
    rows = hits.join(segments.select("part", "seq", "payload"), ["part", "seq"]).select("wanted", "payload")

    def look_up(batches):
        for batch in batches:
            for wanted_here, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = Codes(payload.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["place"] for w in wanted_here], pa.int64()), pa.array([codes[w["at"]] for w in wanted_here], pa.int64())],
                    names=["place", "token"],
                )

    return rows.mapInArrow(look_up, "place long, token long")
