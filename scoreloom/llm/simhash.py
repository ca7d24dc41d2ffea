"""SimHash near-duplicates with bit-sliced comparison.

Texts become 64-bit fingerprints. Equal fingerprints are one class. Classes within ``radius`` differing bits agree on at least
``pieces - radius`` of ``pieces`` bit ranges, so they meet in a block that holds those ranges; nothing within the radius is missed. A
block keeps its fingerprints as vertical bit planes: one machine word holds the same bit of 64 fingerprints, and carry-save counters
add 64 distances at a time. A word whose 64 distances all exceed the radius is abandoned.

Blocks of more than ``tile`` fingerprints are cut into tiles and compared tile against tile in separate tasks. A tile reports a
spanning forest of its links, never all pairs. ``pieces`` sets the block size: about ``n / 2**(64 * (pieces - radius) / pieces)``
fingerprints for random bits, 8 pieces serve tens of billions of documents. The result does not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import free_name, text_key, with_keys, written
from scoreloom.llm.components import components

#: Shingle length, hash seed and radius of the near-duplicate contract.
SHINGLE, SEED, RADIUS = 4, 42, 4
PIECES, TILE = 5, 2048

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def run_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words in their order; a shorter text is one run, a text without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [
            digest(joined[s:e], seed)
            for s, e in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        ]
    return np.array(hashes, np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of one text; zero for a text without words."""
    return majority(run_hashes(text, shingle, seed))


def majority(values: np.ndarray) -> int:
    """Signed 64-bit SimHash of run hashes, repeats included: the bits that more than half of them have."""
    if not len(values):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        block = values[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text: str, name: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``df`` with the fingerprint as a long. Arrow batches; a text is worked on once, whole."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(x, shingle, seed) for x in texts], dtype="int64")

    return df.withColumn(name, of(F.col(text)))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of shape (64, words) for uint64 ``values``, and for every word a mask of the places that are in use."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    used = np.packbits(np.arange(words * 64) < len(values), bitorder="little").view(np.uint64)
    return planes, used


def within_radius(queries: np.ndarray, values: np.ndarray, radius: int = RADIUS, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, value) at most ``radius`` bits apart; ``upper``: both sides are the same, give each pair once.

    A cell is a query against one word of 64 values. Its distances are counted in bit-sliced carry-save counters that stick once they
    overflow; cells that are all over the radius are dropped every eight planes.
    """
    if not len(queries) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    planes, used = bit_planes(values)
    n_words = planes.shape[1]
    depth = max(1, (radius + 1).bit_length())
    found_q, found_v = [], []
    step = max(1, 65536 // n_words)
    for at in range(0, len(queries), step):
        block = queries[at : at + step]
        masks = np.where((block[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), _ONES, np.uint64(0))
        q, w = np.divmod(np.arange(len(block) * n_words), n_words)
        if upper:
            keep = w >= (q + at) // 64
            q, w = q[keep], w[keep]
        counters = [np.zeros(len(q), np.uint64) for _ in range(depth)]
        over = ~used[w]
        for bit in range(0, 64, 2):
            x, y = planes[bit][w] ^ masks[bit][q], planes[bit + 1][w] ^ masks[bit + 1][q]
            either = x ^ y
            carry = (x & y) | (counters[0] & either)
            counters[0] ^= either
            for k in range(1, depth):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if bit % 8 == 6:
                live = ~(over | _above(counters, radius))
                keep = live != 0
                if not keep.all():
                    q, w, over = q[keep], w[keep], over[keep]
                    counters = [c[keep] for c in counters]
                if not len(q):
                    break
        if len(q):
            live = ~(over | _above(counters, radius))
            cell, place = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            query, value = q[cell] + at, w[cell] * 64 + place
            if upper:
                keep = query < value
                query, value = query[keep], value[keep]
            found_q.append(query)
            found_v.append(value)
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_v)


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bit-sliced comparison: places whose counter is larger than ``radius``."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ONES)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smallest value it reaches in this tile) that connect exactly what links of the tile connect."""
    values = left if right is None else np.concatenate([left, right])
    root = np.arange(len(values))
    step = 256
    for at in range(0, len(left), step):
        if right is None:
            a, b = within_radius(left[at : at + step], left[at:], radius, upper=True)
            a, b = a + at, b + at
        else:
            a, b = within_radius(left[at : at + step], right, radius)
            a, b = a + at, b + len(left)
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(values)))
    return values[moved], values[root[moved]]


def _block_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (part, key, ti, tj, side, fp); a block that runs over the end of a batch waits for the next."""
    held: list[np.ndarray] = []

    def links(table: list[np.ndarray], last: bool):
        n = len(table[0])
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in table[:4]], axis=0)) + 1
        starts = np.concatenate(([0], change)) if n else np.empty(0, np.int64)
        ends = np.append(change, n) if n else starts
        upto = len(starts) if last else len(starts) - 1
        out_a, out_b = [], []
        for s, e in zip(starts[:upto].tolist(), ends[:upto].tolist(), strict=True):
            if e - s < 2:
                continue
            fps, side = table[5][s:e].view(np.uint64), table[4][s:e]
            diagonal = table[2][s] == table[3][s]
            a, b = spanning_links(fps, None, radius) if diagonal else spanning_links(fps[side == 0], fps[side == 1], radius)
            out_a.append(a)
            out_b.append(b)
        rest = [c[starts[-1] :] for c in table] if n and not last else []
        a = np.concatenate(out_a) if out_a else np.empty(0, np.uint64)
        b = np.concatenate(out_b) if out_b else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]), rest

    for batch in batches:
        columns = [np.asarray(batch.column(i)) for i in range(6)]
        held = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
        out, held = links(held, False)
        if out.num_rows:
            yield out
    if held:
        yield links(held, True)[0]


def fingerprint_links(classes: DataFrame, fp: str, radius: int = RADIUS, pieces: int = PIECES, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints of ``classes`` exactly as all pairs within ``radius`` bits do."""
    if not 0 <= radius < pieces <= 64:
        raise ValueError("pieces must be above radius and at most 64")
    bounds = [64 * i // pieces for i in range(pieces + 1)]
    masks = []
    for kept in combinations(range(pieces), pieces - radius):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    members = classes.select(
        F.col(fp).alias("fp"),
        F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("part", "key"),
    )
    # Only blocks above a tile are listed: at most one entry for every `tile` members.
    hot = members.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile).select(
        F.col("part").alias("__part"), F.col("key").alias("__key"), F.ceil(F.col("n") / tile).cast("int").alias("__tiles"),
    )
    split = members.join(hot, (F.col("part") == F.col("__part")) & (F.col("key") == F.col("__key")), "left")
    own = F.pmod(F.xxhash64("fp"), F.col("__tiles")).cast("int")
    cells = F.when(F.col("__tiles").isNull(), F.array(F.struct(F.lit(0).alias("ti"), F.lit(0).alias("tj"), F.lit(0).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("__tiles") - 1),
            lambda t: F.struct(F.least(own, t).alias("ti"), F.greatest(own, t).alias("tj"), (own > t).cast("int").alias("side")),
        )
    )
    placed = split.select("part", "key", "fp", F.inline(cells)).select("part", "key", "ti", "tj", "side", "fp")
    sorted_ = placed.repartition("part", "key", "ti", "tj").sortWithinPartitions("part", "key", "ti", "tj", "side", "fp")
    return sorted_.mapInArrow(lambda it: _block_links(it, radius), "a long, b long")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    pieces: int = PIECES, tile: int = TILE,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, text_key, fingerprint`` (long), ``component`` (some fingerprint of the component, the same for all
    its rows) and ``component_id``, the smallest id reachable over links; where ids repeat, two components may have the same smallest id.

    Null texts, and texts without words, have fingerprint zero and link like any other. Rows with a null id belong to their class and get
    the smallest id of the component, null if it has none. Repeated rows and repeated ids stay separate rows. An empty table gives no rows.
    """
    prints = written(
        with_fingerprint(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "fingerprint", shingle)
        .select("doc_id", text_key(F.col("text")).alias("text_key"), "fingerprint"),
        "prints",
    )
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    classes = written(classes, "classes")
    roots = components(fingerprint_links(classes, "fingerprint", radius, pieces, tile))
    linked = roots.join(classes, F.col("node") == F.col("fingerprint"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(smallest, "root").select("node", "root", "component_id")
    ids = classes.join(named, F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("__fp"), F.coalesce("root", "fingerprint").alias("component"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return prints.join(ids, F.col("fingerprint") == F.col("__fp"), "left").drop("__fp")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", find=near_duplicates, **how) -> DataFrame:
    """``df`` with one row of each near-duplicate component: the one with the smallest id (null last), then the smallest text hash.

    ``find`` names the components; repeated ids do not join them. An empty table stays empty. Clashing extra columns are carried through untouched; of fully repeated rows one stays.
    """
    found = find(df, doc_id, text, **how)
    best = found.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("text_key"))).alias("s")
    ).select("s.doc_id", "s.text_key")
    stem, order = free_name(df, "__key"), free_name(df, "__order")
    keyed, names = with_keys(df, stem, [F.col(doc_id).cast("long"), text_key(F.col(text))])
    wanted, _ = with_keys(best, stem, [F.col("doc_id"), F.col("text_key")])
    kept = keyed.join(wanted.select(*names), names)
    one = Window.partitionBy(*names).orderBy(names[0])
    return kept.withColumn(order, F.row_number().over(one)).filter(F.col(order) == 1).select(*df.columns)
