"""Merkle manifest of a dataset: a tree of hash states per group of rows, and one over the groups.

A parent's message is its children's digests as hex text, and each digest fills one block of the hash. So the state before every child slot is
eight words; parents keep a copy of each. When a leaf changes, folding takes the state its parent kept before that slot, adds the replacement and the
right siblings only, and closes; nothing to the left is hashed again.

Leaves are sorted once, by ranges of (group, order), so a large group lies in many tasks; a leaf's place is its row in its task plus the rows of
the group before that task. A block of ``FANOUT ** LEVELS`` leaves grows ``LEVELS`` levels in one task and is one row of a written table: its nodes
and the kept states. Block roots are the leaves of the next pass, so a pass takes a two-thousandth of the rows of the one before it. Paths come
down the same way: a block is joined with the one path above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm import sha256
from scoreloom.llm.common import written

#: Children of a node, and levels that one task grows: blocks of 2,187 leaves.
FANOUT, LEVELS = 3, 7

_BLOCKS = "key string, block long, n_blocks long, items array<long>, nodes binary, changed binary, states binary, root binary"
_PATHS = "key string, block long, siblings binary, steps array<binary>, subroot binary, root binary"
_ROWS = "key string, item long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of a row: each value as ``-`` if null, else its UTF-8 bytes, ``:`` and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def levels_above(n: int, fanout: int = FANOUT) -> int:
    """Levels until ``n`` nodes are one."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


@dataclass
class Block:
    """Nodes of one block by level, raw digests (m, 32), and for every level below the top the states (parents, fanout, 8)."""

    nodes: list[np.ndarray]
    states: list[np.ndarray]
    fanout: int

    @classmethod
    def grown(cls, leaves: np.ndarray, levels: int, fanout: int = FANOUT) -> Block:
        out = cls([leaves], [], fanout)
        for _ in range(levels):
            hexes, size = sha256.hex_blocks(out.nodes[-1]), len(out.nodes[-1])
            parents = -(-size // fanout)
            state, kept = sha256.starts(parents), np.empty((parents, fanout, 8), np.uint32)
            for slot in range(fanout):
                kept[:, slot] = state.T
                there = len(range(slot, size, fanout))
                if there:
                    state[:, :there] = sha256.absorb(state[:, :there], hexes[slot::fanout])
            out.states.append(kept)
            out.nodes.append(_closed(state, out._children(len(out.states) - 1)))
        return out

    @classmethod
    def read(cls, leaves: int, nodes: bytes, states: bytes, fanout: int = FANOUT) -> Block:
        raw, words = np.frombuffer(nodes, np.uint8).reshape(-1, 32), np.frombuffer(states, "<u4")
        out, at, word = cls([], [], fanout), 0, 0
        while at < len(raw):
            out.nodes.append(raw[at : at + leaves])
            at, leaves = at + leaves, -(-leaves // fanout)
            if at < len(raw):
                size = leaves * fanout * 8
                out.states.append(words[word : word + size].reshape(leaves, fanout, 8).astype(np.uint32))
                word += size
        return out

    def written(self) -> tuple[bytes, bytes]:
        return b"".join(n.tobytes() for n in self.nodes), b"".join(s.astype("<u4").tobytes() for s in self.states)

    def _children(self, level: int) -> np.ndarray:
        size = len(self.nodes[level])
        return np.minimum(self.fanout, size - np.arange(0, size, self.fanout))

    def folded(self, leaves: np.ndarray) -> np.ndarray:
        """The block's root, one for every leaf, if that leaf alone were the one in ``leaves``."""
        current, at = leaves, np.arange(len(leaves))
        for level, kept in enumerate(self.states):
            parent, slot = np.divmod(at, self.fanout)
            children = self._children(level)[parent]
            hexes = sha256.hex_blocks(self.nodes[level])
            state = sha256.absorb(np.ascontiguousarray(kept[parent, slot].T), sha256.hex_blocks(current))
            for right in range(1, self.fanout):
                lanes = np.flatnonzero(slot + right < children)
                if len(lanes):
                    state[:, lanes] = sha256.absorb(state[:, lanes], hexes[at[lanes] + right])
            current, at = _closed(state, children), parent
        return current

    def siblings(self) -> list[bytes]:
        """For every leaf the hex digests of its siblings, level by level up to the block's root."""
        above = [b""]
        for level in range(len(self.states) - 1, -1, -1):
            text = sha256.hex_blocks(self.nodes[level]).tobytes()
            size, width = len(self.nodes[level]), 64 * self.fanout
            above = [
                text[i // self.fanout * width : 64 * i] + text[64 * (i + 1) : (i // self.fanout + 1) * width] + above[i // self.fanout]
                for i in range(size)
            ]
        return above

    def steps(self) -> list[list[bytes]]:
        """For every leaf, level by level, what folding needs: number of children, the state kept before it, right siblings."""
        above: list[list[bytes]] = [[]]
        for level in range(len(self.states) - 1, -1, -1):
            raw, children, out = self.nodes[level], self._children(level), []
            for i in range(len(raw)):
                parent, slot = divmod(i, self.fanout)
                last = parent * self.fanout + int(children[parent])
                state = self.states[level][parent, slot].astype("<u4").tobytes()
                out.append([bytes([children[parent]]) + state + raw[i + 1 : last].tobytes(), *above[parent]])
            above = out
        return above


def _closed(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    for k in np.unique(children).tolist():
        lanes = np.flatnonzero(children == k)
        state[:, lanes] = sha256.absorb(state[:, lanes], sha256.closing(k))
    return sha256.digests(state)


def folded_over(current: np.ndarray, steps: Sequence[bytes]) -> np.ndarray:
    """Raw digests carried up a path: kept state, replacement, right siblings, level by level."""
    for step in steps:
        kept = np.frombuffer(step, "<u4", 8, 1).astype(np.uint32)
        state = sha256.absorb(np.repeat(kept[:, None], len(current), axis=1), sha256.hex_blocks(current))
        for sibling in np.frombuffer(step, np.uint8, offset=33).reshape(-1, 1, 32):
            state = sha256.absorb(state, sha256.hex_blocks(sibling))
        current = sha256.digests(sha256.absorb(state, sha256.closing(step[0])))
    return current


def placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos``, the place inside the ``key`` by ``order``, and ``n``, the key's rows."""
    sides = [F.col("key"), *order]
    rows = rows.repartitionByRange(*sides).sortWithinPartitions(*sides)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    # The rows of a task are numbered from task << 33 on. A key has one entry for each task it lies in.
    task = F.shiftright("row", 33)
    pieces = rows.groupBy("key", task.alias("task")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy("key")
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select(
        F.col("key").alias("__key"), F.col("task").alias("__task"), (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(whole).alias("n"),
    )
    found = rows.join(shifts, (F.col("key") == F.col("__key")) & (task == F.col("__task")))
    return found.withColumn("pos", F.col("row") + F.col("shift")).drop("__key", "__task", "row", "shift")


def _packed(table: pa.Table, fanout: int, levels: int) -> pa.Table:
    table = table.sort_by("pos")
    n, first = table["n"][0].as_py(), table["pos"][0].as_py()
    leaves = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, 32)
    block = Block.grown(leaves, min(levels, levels_above(n, fanout)), fanout)
    size = fanout**levels
    nodes, states = block.written()
    changed = [new or old for new, old in zip(table["changed"].to_pylist(), table["digest"].to_pylist(), strict=True)]
    return pa.table(
        {
            "key": table["key"].slice(0, 1), "block": [first // size], "n_blocks": [-(-n // size)],
            "items": pa.array([table["item"].to_pylist()], pa.list_(pa.int64())), "nodes": [nodes], "changed": [b"".join(changed)],
            "states": [states], "root": [block.nodes[-1][0].tobytes()],
        }
    )


def grow(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Passes of blocks over ``nodes(key, item, digest, changed, pos, n)``; a key whose one block is left takes no part in later passes."""
    size, passes = fanout**levels, []
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        grouped = nodes.withColumn("block", F.floor(F.col("pos") / size)).groupBy("key", "block")
        passes.append(written(grouped.applyInArrow(lambda t: _packed(t, fanout, levels), _BLOCKS), "merkle-blocks"))
        largest = -(-largest // size)
        if largest <= 1:
            return passes
        nodes = passes[-1].filter("n_blocks > 1").select(
            "key", F.lit(None).cast("long").alias("item"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("changed"),
            F.col("block").alias("pos"), F.col("n_blocks").alias("n"),
        )


def roots(passes: Sequence[DataFrame]) -> DataFrame:
    """``(key, digest)``: the root of every key."""
    out = None
    for blocks in passes:
        done = blocks.filter("n_blocks = 1").select("key", F.col("root").alias("digest"))
        out = done if out is None else out.union(done)
    return out


def _blocks_of(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, Block.read(len(row["items"]), row["nodes"], row["states"], fanout)


def _child_paths(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    for row, block in _blocks_of(batches, fanout):
        size = len(row["items"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row["key"]] * size), pa.array(range(row["first"], row["first"] + size), pa.int64()),
                pa.array([s + row["siblings"] for s in block.siblings()], pa.binary()),
                pa.array([s + row["steps"] for s in block.steps()], pa.list_(pa.binary())),
                pa.array([row["subroot"]] * size, pa.binary()), pa.array([row["root"]] * size, pa.binary()),
            ],
            names=["key", "block", "siblings", "steps", "subroot", "root"],
        )


def _with_paths(blocks: DataFrame, paths: DataFrame, *columns: str) -> DataFrame:
    above = paths.select(F.col("key").alias("__key"), F.col("block").alias("__block"), "siblings", "steps", "subroot", "root")
    return blocks.select("key", "block", *columns).join(above, (F.col("key") == F.col("__key")) & (F.col("block") == F.col("__block"))).drop(
        "__key", "__block",
    )


def paths_down(passes: Sequence[DataFrame], above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Paths of the blocks of the first pass; ``above(key, siblings, steps, subroot, root)`` is the path of each key's root."""
    done = above.withColumn("block", F.lit(0).cast("long"))
    paths, size = None, fanout**levels
    for i in range(len(passes) - 1, -1, -1):
        own = _with_paths(passes[i].filter("n_blocks = 1"), done).select("key", "block", "siblings", "steps", "subroot", "root")
        paths = own if paths is None else own.union(paths)
        if i:
            blocks = _with_paths(passes[i], paths, "items", "nodes", "states").withColumn("first", F.col("block") * size)
            paths = written(blocks.mapInArrow(lambda it: _child_paths(it, fanout), _PATHS), "merkle-paths")
    return paths


def _rows(batches: Iterator[pa.RecordBatch], fanout: int) -> Iterator[pa.RecordBatch]:
    for row, block in _blocks_of(batches, fanout):
        leaves = np.frombuffer(row["changed"], np.uint8).reshape(-1, 32)
        folded = folded_over(block.folded(leaves), row["steps"])
        size, root = len(leaves), row["root"].hex()
        texts = [f.hex() for f in map(bytes, folded)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([row["key"]] * size), pa.array(row["items"], pa.int64()), pa.array([bytes(x).hex() for x in block.nodes[0]]),
                pa.array([row["subroot"].hex()] * size), pa.array([root] * size),
                pa.array([hashlib.sha256(s + row["siblings"]).hexdigest() for s in block.siblings()]), pa.array(texts),
                pa.array([t == root for t in texts]),
            ],
            names=["key", "item", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def manifest(
    df: DataFrame, leaf: Column, changed: Column | None = None, group: str = "source", order: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``df``: ``group, order, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``leaf`` is the row's digest in hex. ``changed`` is the digest the row is found with later (null: unchanged); ``folded_root`` is the root with
    that one leaf replaced, ``verified`` says that it equals the root. Groups are ordered null first, then by bytes. Inside a group rows
    ascend by ``order``, a whole number, null first; equal ones ascend by leaf, so repeated rows are leaves of their own next to each other.
    An empty table has no root and gives no rows. Only the columns named take part; others may have any name.
    """
    if not 2 <= fanout <= 255:
        raise ValueError("fanout must be 2 to 255")
    leaves = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"), F.col(order).cast("long").alias("item"),
        F.unhex(leaf).alias("digest"), F.unhex(changed if changed is not None else F.lit(None).cast("string")).alias("changed"),
    )
    passes = grow(placed(leaves, [F.col("item").asc_nulls_first(), F.col("digest")]), fanout, levels)
    subroots = written(roots(passes).withColumnRenamed("key", "group"), "merkle-roots")
    # The tree over the groups: one key, its leaves in the order of the groups.
    none = F.lit(None)
    named = written(placed(
        subroots.select(F.lit("").alias("key"), "group", none.cast("long").alias("item"), "digest", none.cast("binary").alias("changed")), [F.col("group")],
    ), "merkle-tops")
    top_passes = grow(named.drop("group"), fanout, levels)
    whole = roots(top_passes).select(
        "key", F.lit(b"").alias("siblings"), F.array().cast("array<binary>").alias("steps"), F.lit(b"").alias("subroot"), F.col("digest").alias("root"),
    )
    top_blocks = _with_paths(top_passes[0], paths_down(top_passes, whole, fanout, levels), "items", "nodes", "states")
    size = fanout**levels
    top_paths = top_blocks.withColumn("first", F.col("block") * size).mapInArrow(lambda it: _child_paths(it, fanout), _PATHS)
    above = named.select("group", F.col("digest").alias("subroot"), "pos").join(
        top_paths.select("block", "siblings", "steps", "root"), F.col("pos") == F.col("block")
    ).select(F.col("group").alias("key"), "siblings", "steps", "subroot", "root")
    paths = paths_down(passes, written(above, "merkle-above"), fanout, levels)
    rows = _with_paths(passes[0], paths, "items", "nodes", "changed", "states").mapInArrow(lambda it: _rows(it, fanout), _ROWS)
    return rows.select(
        F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias(group), F.col("item").alias(order), "leaf", "subroot", "root", "proof_sha256",
        "folded_root", "verified",
    )
