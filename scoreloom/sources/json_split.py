"""One large JSON document read by many tasks (survey rows S1, S2).

Spark's text source cuts a file into byte ranges as soon as its rows end with a separator, so the document is read as fragments that end with ``}``.
A range does not know whether it starts inside a string, or how deep. A first pass tells for both cases how it ends: still in a string or
not, and how many brackets deeper. These small answers are chained file by file. The second pass knows the state at the start of its range and
cuts out the records; a record that runs over the end of a range is put together from its pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.session import scratch_path

_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_CLOSED = re.compile('"' + _REST.pattern, re.S)
_TOKEN = re.compile(_CLOSED.pattern + r'|"|[{\[\]:]', re.S)

#: Kinds of what the second pass gives: a whole record, its begin, a piece of its middle, its end, a key with an array, the last key of a range.
WHOLE, BEGIN, MIDDLE, END, ARRAY, LAST = range(6)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, value``: pieces of the files up to and without a ``}``, in order; ``start`` is the byte range they belong to."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def passed(text: str, inside: bool) -> tuple[bool, int]:
    """Whether the text after a fragment and its ``}`` is inside a string, and how much deeper it is."""
    if inside:
        end = _REST.match(text)
        if end is None:
            return True, 0
        text = text[end.end() :]
    bare = _CLOSED.sub("", text)
    opened = bare.find('"')
    if opened >= 0:
        bare = bare[:opened]
    deeper = bare.count("{") + bare.count("[") - bare.count("]")
    return (True, deeper) if opened >= 0 else (False, deeper - 1)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        for file, start, value in zip(files, starts, values, strict=True):
            yield (file, start), value


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, out, top = None, None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(file=own[0], start=own[1], top=top, out_in=out[0][0], out_by=out[0][1], in_in=out[1][0], in_by=out[1][1])], _SUMMARY)

    for at, text in _ranges(batches):
        if at != own:
            if own is not None:
                yield row()
            own, out, top = at, [(False, 0), (True, 0)], None
        top = top or text.lstrip("\ufeff \t\r\n")[:1] or None
        for k, (inside, depth) in enumerate(out):
            inside, deeper = passed(text, inside)
            out[k] = (inside, depth + deeper)
    if own is not None:
        yield row()


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("top", pa.string()), ("out_in", pa.bool_()), ("out_by", pa.int64()), ("in_in", pa.bool_()), ("in_by", pa.int64())])
_SUMMARY_DDL = "file string, start long, top string, out_in boolean, out_by long, in_in boolean, in_by long"


def _chained(ranges: pd.DataFrame) -> pd.DataFrame:
    inside, depth, top, rows = False, 0, None, []
    for r in ranges.sort_values("start").itertuples(index=False):
        top = top or r.top
        rows.append((r.file, r.start, top, inside, depth))
        inside, depth = (r.in_in, depth + r.in_by) if inside else (r.out_in, depth + r.out_by)
    return pd.DataFrame(rows, columns=["file", "start", "top", "inside", "depth"])


class _Cutter:
    """Cuts the records of one byte range; ``rows`` are (kind, key, text)."""

    def __init__(self, top: str | None, inside: bool, depth: int):
        # Records are the objects of the outer array, or those of an array under a key of the outer object.
        self.base = 1 if top == "[" else 2
        self.inside, self.depth = inside, depth
        self.key, self.word, self.array = None, None, True
        self.open = depth > self.base
        self.begun_here, self.held, self.rows = False, [], []

    def add(self, text: str) -> None:
        if self.open:
            self.held.append(text + "}")
            inside, deeper = passed(text, self.inside)
            self.inside, self.depth = inside, self.depth + deeper
            if self.depth == self.base and not inside:
                self._give(END if not self.begun_here else WHOLE)
            elif self.depth < self.base:
                # The range began inside something that is no record.
                self.open, self.held = False, []
            return
        at = 0
        if self.inside:
            end = _REST.match(text)
            if end is None:
                return
            at, self.inside = end.end(), False
        for token in _TOKEN.finditer(text, at):
            sign = token.group()
            if sign == '"':
                self.inside = True
                return
            if sign[0] == '"':
                self.word = sign
            elif sign == ":":
                self.key = json.loads(self.word) if self.depth == 1 and self.base == 2 and self.word else self.key
            elif sign == "]":
                self.depth -= 1
            else:
                if self.depth == 1 and self.base == 2:
                    self.array = sign == "["
                    if self.array:
                        self.rows.append((ARRAY, self.key, None))
                if sign == "{" and self.depth == self.base:
                    self.open, self.begun_here = True, True
                    self.add(text[token.start() :])
                    return
                self.depth += 1
        self.depth -= 1

    def _give(self, kind: int) -> None:
        if self.array:
            self.rows.append((kind, self.key, "".join(self.held)))
        self.open, self.begun_here, self.held = False, False, []

    def finish(self) -> None:
        # What is not under an array is marked as of no key, so that its later pieces are not taken for a record's.
        if self.open and self.begun_here and not self.array:
            self.rows.append((BEGIN, "", ""))
        elif self.open and self.held:
            self._give(BEGIN if self.begun_here else MIDDLE)
        if self.key is not None:
            self.rows.append((LAST, self.key if self.array else "", None))


_PIECE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("key", pa.string()), ("value", pa.string())])
_PIECE_DDL = "file string, start long, seq long, kind int, key string, value string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, cutter, seq = None, None, 0

    def rows() -> pa.RecordBatch:
        nonlocal seq
        out = [dict(file=own[0], start=own[1], seq=seq + i, kind=k, key=key, value=v) for i, (k, key, v) in enumerate(cutter.rows)]
        seq += len(out)
        cutter.rows = []
        return pa.RecordBatch.from_pylist(out, _PIECE)

    for batch in batches:
        for file, start, text, top, inside, depth in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (file, start) != own:
                if own is not None:
                    cutter.finish()
                    yield rows()
                own, cutter, seq = (file, start), _Cutter(top, inside, depth), 0
            cutter.add(text)
            if len(cutter.rows) >= 1000:
                yield rows()
    if own is not None:
        cutter.finish()
        yield rows()


class JsonDocuments:
    """The JSON documents at ``path``, read in byte ranges. Small rows only, one for each range, are gathered per file and broadcast: their number
    is the files plus the bytes read divided by ``spark.sql.files.maxPartitionBytes``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.fragments = spark, fragments(spark, path)
        states = scratch_path(spark, "json-states")
        ranges = self.fragments.mapInArrow(_summaries, _SUMMARY_DDL)
        ranges.groupBy("file").applyInPandas(_chained, "file string, start long, top string, inside boolean, depth long").write.parquet(states)
        self.ranges = spark.read.parquet(states)
        #: How the documents begin: ``[``, ``{``, or other signs.
        self.tops = {r[0] for r in self.ranges.select("top").distinct().collect()}
        known = self.ranges.select(F.col("file").alias("f"), F.col("start").alias("s"), "top", "inside", "depth")
        placed = self.fragments.join(F.broadcast(known), (F.col("file") == F.col("f")) & (F.col("start") == F.col("s")))
        pieces = scratch_path(spark, "json-pieces")
        placed.select("file", "start", "value", "top", "inside", "depth").mapInArrow(_cut, _PIECE_DDL).write.parquet(pieces)
        found = spark.read.schema(_PIECE_DDL).parquet(pieces)
        # The key that holds at the start of a range: the last one of the ranges before it.
        before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        last = found.filter(F.col("kind") == LAST).select("file", "start", F.col("key").alias("last"))
        held = self.ranges.select("file", "start").join(last, ["file", "start"], "left").withColumn("held", F.last("last", ignorenulls=True).over(before))
        named = found.filter(F.col("kind") != LAST).join(F.broadcast(held.select("file", "start", "held")), ["file", "start"])
        self.pieces = named.withColumn("key", F.coalesce("key", "held")).drop("held")

    def records(self) -> DataFrame:
        """``file, key, value``: the text of every object of an outer array (``key`` is null) or of an array under a key of an outer object."""
        # A record over several ranges: its pieces follow its begin. There are at most two pieces in a range.
        order = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, 0)
        begin = F.last(F.when(F.col("kind") == BEGIN, F.struct("start", "key")), ignorenulls=True).over(order)
        cut_ones = self.pieces.filter(F.col("kind").isin(BEGIN, MIDDLE, END)).withColumn("begin", begin)
        joined = cut_ones.groupBy("file", "begin").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "value"))), lambda p: p["value"]), "").alias("value"),
            F.max("kind").alias("kind"),
        ).filter(F.col("kind") == END)
        whole = self.pieces.filter(F.col("kind") == WHOLE).select("file", "key", "value")
        return whole.union(joined.select("file", "begin.key", "value"))

    def chosen_keys(self, keys: Sequence[str]) -> DataFrame:
        """``file, key``: of the keys with an array in the outer object, the first in the order of ``keys``."""
        rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
        return self.pieces.filter((F.col("kind") == ARRAY) & (rank > 0)).groupBy("file").agg(F.min_by("key", rank).alias("key"))

    def record_lines(self) -> str:
        """Write the records of outer arrays one per line and give the folder: any JSON reader of Spark takes it from there."""
        out = scratch_path(self.spark, "json-lines")
        self.records().filter("key is null").select(F.translate("value", "\r\n", "  ").alias("value")).write.text(out)
        return out
