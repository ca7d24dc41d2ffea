"""Near duplicates by word-shingle sets: texts whose sets have Jaccard similarity ``least`` or more are linked.

Texts with the same set are one class. Candidates are classes in one SimHash component (``simhash.fingerprint_links``: no pair within the radius is
missed), and, as that radius reaches few pairs near ``least``, classes that share a band of MinHash values; a pair of similarity ``s`` shares none
with probability ``(1 - s**ROWS)**BANDS``, 5 in a million at 0.8 and less above. Every candidate pair is verified on the sets themselves, so no
pair below ``least`` is linked.

A component or a band is a group. Pairs inside one component of verified links need no comparison. Two turns compare the members of a group with
one member of its largest component, which settles large groups of copies with two pairs per member. What is left, groups with several components,
is compared tile against tile, but for tiles of the largest one: a task takes the sets of two tiles, counts all common hashes by one matrix product
over those that several sets have, and gives a spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import text_key, written
from scoreloom.llm.components import components
from scoreloom.llm.simhash import PIECES, RADIUS, SEED, fingerprint_links, majority, run_hashes

#: The rule of the corpus pipeline: words of a shingle, and the least similarity of near copies, as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: MinHash bands and values of a band.
BANDS, ROWS = 40, 6
#: Members of a band that are compared in one task, hashes that so many sets have go into the matrix product, and its columns at a time.
TILE, DENSE, COLUMNS = 1024, 8, 4096
#: Texts whose sets a task holds at a time.
TEXTS = 256

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PRINTS = "doc_id long, text_key long, fingerprint long, n long, bands array<long>, simhash long"


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word runs of ``text``; a shorter text is one run."""
    return np.unique(run_hashes(text, shingle, SEED))


def set_hash(runs: np.ndarray) -> int:
    """Signed hash of a set; zero for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(runs.tobytes(), SEED)).astype(np.int64)) if len(runs) else 0


def bands(runs: np.ndarray) -> list[int]:
    """One key for every band, none for the empty set."""
    if not len(runs):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(runs), 1024):
        np.minimum(least, (_FACTORS[:, None] * runs[None, at : at + 1024]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _prints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
        ids, keys, texts = batch.columns
        sets, bits = [], []
        for x in texts.to_pylist():
            hashes = run_hashes(x, shingle, SEED)
            sets.append(np.unique(hashes))
            bits.append(majority(hashes))
        yield pa.RecordBatch.from_arrays(
            [
                ids, keys, pa.array([set_hash(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(bits, pa.int64()),
            ],
            names=["doc_id", "text_key", "fingerprint", "n", "bands", "simhash"],
        )


def simhash_groups(prints: DataFrame, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """``(fingerprint, n, key)``: classes of ``prints(fingerprint, n, simhash)`` by their SimHash component; all within ``radius`` bits share a key."""
    seen = written(prints.filter("n > 0").select("fingerprint", "n", "simhash").distinct(), "simhash-seen")
    roots = components(fingerprint_links(seen.select("simhash").distinct(), "simhash", radius, pieces))
    key = F.xxhash64(F.lit("simhash"), F.coalesce("root", "simhash")).alias("key")
    return seen.join(roots, F.col("simhash") == F.col("node"), "left").select("fingerprint", "n", key).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The ``pairs(a, b)`` whose sets are similar enough, in whole numbers: common / (n + m - common) >= least."""
    a, b = (sets.select(*[F.col(c).alias(f"{c}_{x}") for c in ("fingerprint", "runs")]) for x in "ab")
    both = pairs.distinct().join(a, F.col("a") == F.col("fingerprint_a")).join(b, F.col("b") == F.col("fingerprint_b"))
    counted = both.select("a", "b", (F.size("runs_a") + F.size("runs_b")).alias("n"), F.size(F.array_intersect("runs_a", "runs_b")).alias("common"))
    return counted.filter(F.col("common") * sum(least) >= F.col("n") * least[0]).select("a", "b")


def set_links(members: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """Links ``(a, b)`` that connect classes exactly as all verified pairs of ``members(key, fingerprint, n)`` with equal ``key`` do."""
    top, bottom = least
    fits = (F.col("n") * bottom >= F.col("m") * top) & (F.col("m") * bottom >= F.col("n") * top)
    links, placed = None, members.withColumn("root", F.col("fingerprint"))
    for turn in range(2):
        # A member of every component of a key, another one each time; the head of a key is that of its largest component.
        one = F.min_by(F.struct("fingerprint", "n"), F.struct(F.xxhash64("fingerprint", F.lit(turn)), "fingerprint"))
        parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), one.alias("one"))
        heads = parts.groupBy("key").agg(F.max_by(F.struct("root", "one"), F.struct("size", "root")).alias("head"), F.count(F.lit(1)).alias("parts"))
        pairs = placed.join(heads.filter("parts > 1"), "key").filter(F.col("root") != F.col("head.root")).select(
            F.col("fingerprint").alias("a"), F.col("head.one.fingerprint").alias("b"), "n", F.col("head.one.n").alias("m"),
        ).filter(fits).select("a", "b")
        found = _verified(pairs, sets, least)
        links = written(found if links is None else links.union(found), "set-links")
        roots = components(links)
        placed = members.join(roots, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint")).drop("node")
    # Members of a key's largest component have no pair to compare among themselves: their tiles, the last ones, only meet those of the rest.
    parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("key").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("size"),
    ).filter("most < size")
    mixed = mixed.select(
        "key", "main", F.ceil((F.col("size") - F.col("most")) / TILE).cast("int").alias("rest"), F.ceil(F.col("most") / TILE).cast("int").alias("mains"),
    )
    left = placed.join(mixed, "key")
    inner, spot = F.col("root") == F.col("main"), F.xxhash64("fingerprint")
    own = F.when(inner, F.col("rest") + F.pmod(spot, F.col("mains"))).otherwise(F.pmod(spot, F.col("rest"))).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.when(inner, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1),
        lambda t: F.struct(F.least(own, t).alias("ti"), F.greatest(own, t).alias("tj"), (own > t).cast("int").alias("side")),
    )
    dealt = left.select("key", "fingerprint", "root", F.inline(cells)).join(sets, "fingerprint")
    dealt = dealt.select("key", "ti", "tj", "side", "fingerprint", "root", "runs").repartition("key", "ti", "tj")
    placed_sets = dealt.sortWithinPartitions("key", "ti", "tj", "side", "fingerprint")
    return links.union(placed_sets.mapInArrow(lambda it: _tile_links(it, least), "a long, b long"))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes every two of the sets have in common, (n, n); the diagonal is zero."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(values)))
    pairs = [np.empty(0, np.int64)]
    for size in range(2, DENSE):
        held = owner[starts[sizes == size][:, None] + np.arange(size)]
        pairs += [held[:, i] * n + held[:, j] for i, j in combinations(range(size), 2)]
    common = np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n).astype(np.float32)
    common += common.T
    dense = np.flatnonzero(sizes >= DENSE)
    for at in range(0, len(dense), COLUMNS):
        some = dense[at : at + COLUMNS]
        rows = np.zeros((n, len(some)), np.float32)
        lengths = sizes[some]
        places = np.repeat(starts[some] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        rows[owner[places], np.repeat(np.arange(len(some)), lengths)] = 1
        common += rows @ rows.T
    np.fill_diagonal(common, 0)
    return common.astype(np.int64)


def tile_links(names: np.ndarray, roots: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], diagonal: bool, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (name, smallest name it reaches) that connect what similar pairs of different roots connect: of one tile, or of two tiles."""
    n = np.array([len(s) for s in sets])
    similar = common_counts(sets) * sum(least) >= (n[:, None] + n[None, :]) * least[0]
    similar &= roots[:, None] != roots[None, :]
    if not diagonal:
        similar &= sides[:, None] != sides[None, :]
    a, b = np.nonzero(np.triu(similar, 1))
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _tile_links(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows (key, ti, tj, side, fingerprint, root, runs), cell by cell."""
    cell, held = None, []

    def links() -> pa.RecordBatch:
        sides, names, roots = (np.array([r[i] for r in held], np.int64) for i in range(3))
        a, b = tile_links(names, roots, sides, [r[3] for r in held], cell[1] == cell[2], least)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        runs = batch.column(6)
        for i, (key, ti, tj, side, name, root) in enumerate(zip(*columns, strict=True)):
            if (key, ti, tj) != cell:
                if len(held) > 1:
                    yield links()
                cell, held = (key, ti, tj), []
            held.append((side, name, root, np.asarray(runs[i].values)))
    if len(held) > 1:
        yield links()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per row of ``df``: ``doc_id, text_key, fingerprint`` (hash of the set), ``component`` and ``component_id`` as in ``simhash.near_duplicates``.

    Null texts, and texts without words, have the empty set and are one class. Rows with a null id are treated as in ``simhash.near_duplicates``.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    prints = written(rows.mapInArrow(lambda it: _prints(it, shingle), _PRINTS), "set-prints")
    classes = written(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.min("text_key").alias("text_key"), F.first("n").alias("n")), "set-classes",
    )
    # One row of a class: its bands, once for each text of it.
    members = prints.join(classes.select("fingerprint", "text_key"), ["fingerprint", "text_key"]).select("fingerprint", "n", F.explode("bands").alias("key")).distinct()
    members = members.union(simhash_groups(prints))
    shared = members.groupBy("key").agg(F.min("fingerprint").alias("low"), F.max("fingerprint").alias("high")).filter("low <> high").select("key")
    members = written(members.join(shared, "key"), "set-members")
    wanted = classes.join(members.select("fingerprint").distinct(), "fingerprint").select(F.col("text_key").alias("__key"))
    texts = rows.join(wanted, F.col("text_key") == F.col("__key")).groupBy("text_key").agg(F.first("text").alias("text"))

    @F.pandas_udf("array<long>")
    def runs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([shingle_set(x, shingle).view(np.int64) for x in values])

    sets = written(
        texts.select("text_key", runs("text").alias("runs")).join(classes, "text_key").select("fingerprint", "runs"), "sets",
    )
    roots = components(set_links(members, sets, least))
    smallest = roots.join(classes, F.col("node") == F.col("fingerprint")).groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(smallest, "root").select("node", "root", "component_id")
    ids = classes.join(named, F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("__fp"), F.coalesce("root", "fingerprint").alias("component"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return prints.select("doc_id", "text_key", "fingerprint").join(ids, F.col("fingerprint") == F.col("__fp"), "left").drop("__fp")
