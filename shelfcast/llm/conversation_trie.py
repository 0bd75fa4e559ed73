"""Prefix trie of conversations: union-find over the edges between neighbours in sorted order.

A conversation is a sequence of turns; a node is a distinct start of ``d`` turns, from the root (no turns) on. Turns go by
the MD5 of role and text, 16 bytes a turn, so a sequence is a binary string whose order is the order of the trie, and texts
are read once and never shuffled.

Sequences are sorted globally (ranges of sequence and id, so a group of equal conversations spreads over ranges). Inside a
range, the edge between two neighbours has the length of their common start as its depth. Edges are taken in descending
depth: the conversations an edge of depth d connects share a node there, so every merge creates the branching node of that
depth, and the chain above each part that is merged is finished. Components carry their count, least id, leaves and
the shared characters of their edges, all of which add up, so no subtree is walked:

    saved(v) = sum of the characters shared along the edges inside v - (members - 1) * characters before v's last turn

Every range also sees the last sequence of the range before and the first one of the range after. Nodes that it shares with
them, the starts of its own first or last sequence, stay open: they leave the range contracted to one row each, are merged by
(depth, hash of the start) and give finished nodes below them their parents. The ids that end in a node are hashed in ascending
order where they stand; those of a node over several ranges are hashed range by range in a stream.

Defined results: rows without a conversation id are left out. NULL roles and texts are empty; a NULL turn comes first, turns of
equal number go by the MD5 of their content. Empty texts are turns like others. An empty table gives no nodes. Columns
besides the four are not read. One conversation's sequence (24 bytes a turn) is one row, and must fit a task.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a turn in a sequence.
WIDTH = 16
#: Conversations, and bytes of their sequences, in one range, about.
RANGE_ROWS, RANGE_BYTES = 20_000, 4 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()
FOUND = pa.schema([
    ("part", pa.int64()), ("is_open", pa.bool_()), ("prefix", pa.binary()), ("parent_prefix", pa.binary()), ("depth", pa.int64()),
    ("conv", pa.int64()), ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("shared", pa.int64()), ("before", pa.int64()), ("ends", pa.string()),
])
FOUND_DDL = (
    "part long, is_open boolean, prefix binary, parent_prefix binary, depth long, conv long, parent long, n_convs long, n_children long, "
    "n_leaves long, shared long, before long, ends string"
)


def turn_sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv and its turns in order: an array of (digest, chars)."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said))
    one = F.struct(F.col(turn).isNotNull().alias("numbered"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("chars"))
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), one.alias("one"))
    in_order = rows.groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("all"))
    return in_order.select("conv", F.transform("all", lambda t: F.struct(t["digest"], t["chars"])).alias("turns"))


def shared_starts(sequences: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c begun anew: the first crc32(c) % ``most`` turns of conversation c - c % ``group``, then its own after as many."""
    heads = sequences.filter(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    rows = sequences.withColumn("base", F.col("conv") - F.col("conv") % group).withColumn("h", (F.crc32(F.col("conv").cast("string")) % most).cast("int"))
    rows = rows.join(heads, "base", "left")
    begun = F.slice(F.coalesce("head", F.slice("turns", 1, F.lit(0))), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv", F.concat(begun, own).alias("turns"))


@dataclass
class Part:
    """A component: rows ``lo`` to ``hi`` of the range, which share their first ``top`` turns."""

    lo: int
    hi: int
    top: int
    least: int
    shared: int
    leaves: int
    children: int
    ends: int  # so many rows from ``lo`` on end at ``top``


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    differs = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(differs.argmax()) // WIDTH


class Forest:
    """The nodes of one range. Rows are sorted; ``depths[i]`` is the depth of the edge before row i, -1 where there is none."""

    def __init__(self, part: int, keys: list[bytes], ids: list[int], chars: list[np.ndarray], before: bytes | None, after: bytes | None):
        self.part, self.keys, self.ids = part, keys, ids
        self.sums = [np.concatenate([[0], np.cumsum(c, dtype=np.int64)]) for c in chars]
        n = len(keys)
        self.depths = [-1 if before is None else common_turns(before, keys[0])]
        self.depths += [common_turns(keys[i - 1], keys[i]) for i in range(1, n)]
        self.depths.append(-1 if after is None else common_turns(keys[-1], after))
        self.out: dict[str, list] = {name: [] for name in FOUND.names}
        self.names: list[list[bytes]] = [[], []]  # hashes of the starts of the first and the last row, as far as they are open
        for side, (key, depth) in enumerate([(keys[0], self.depths[0]), (keys[-1], self.depths[n])]):
            state = hashlib.md5()
            for d in range(depth + 1):
                self.names[side].append(state.copy().digest())
                state.update(key[d * WIDTH : (d + 1) * WIDTH])

    def name(self, of: Part, depth: int) -> bytes | None:
        """The start's hash if the node is open."""
        if of.lo == 0 and depth < len(self.names[0]):
            return self.names[0][depth]
        if of.hi == len(self.keys) - 1 and depth < len(self.names[1]):
            return self.names[1][depth]
        return None

    def grow(self) -> dict[str, list]:
        n, depths = len(self.keys), self.depths
        parts = {}
        for i, key in enumerate(self.keys):
            size = len(key) // WIDTH
            parts[i] = Part(i, i, size, self.ids[i], 0, int(depths[i + 1] < size), 0, 1)
        up = list(range(n))

        def find(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        edges = sorted(range(1, n), key=lambda i: (-depths[i], i))
        for depth, same in groupby(edges, key=lambda i: depths[i]):
            merged: dict[int, list[Part]] = {}
            for i in same:
                a, b = find(i - 1), find(i)
                merged.setdefault(a, [parts[a]]).append(parts.pop(b))
                up[b] = a
            for root, below in merged.items():
                lo, hi = below[0].lo, below[-1].hi
                edge_chars = sum(int(self.sums[p.lo][depth]) for p in below[1:])
                deeper = [p for p in below if p.top > depth]
                parts[root] = Part(
                    lo, hi, depth, min(p.least for p in below), sum(p.shared for p in below) + edge_chars,
                    sum(p.leaves for p in below), len(deeper), len(below) - len(deeper),
                )
                for p in deeper:
                    self.finish(p, depth, parts[root])
        for p in parts.values():
            self.finish(p, -1, None)
        return self.out

    def finish(self, of: Part, above: int, parent: Part | None) -> None:
        """The nodes from the top of a component down to the depth ``above`` at which it was merged."""
        out, sums, n = self.out, self.sums[of.lo], of.hi - of.lo + 1
        for depth in range(above + 1, of.top + 1):
            name = self.name(of, depth)
            over = of if depth - 1 > above else parent
            over_name = self.name(over, depth - 1) if over else None
            children = of.children if depth == of.top else 1
            shared = of.shared
            if name is not None and of.lo == 0 and depth <= self.depths[0]:
                shared += int(sums[self.depths[0]])  # the edge to the range before lies inside the node
                children -= int(depth < self.depths[0])  # and that child was counted there
            ids = ",".join(map(str, self.ids[of.lo : of.lo + of.ends])) if depth == of.top else ""
            row = (
                self.part, name is not None, name, over_name, depth, of.least, over.least if over and over_name is None else None, n, children,
                of.leaves, shared, int(sums[max(depth - 1, 0)]), ids if name is not None else hashlib.sha256(ids.encode()).hexdigest(),
            )
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)


def _forest(table: pa.Table) -> pa.Table:
    kind, key, conv = table["kind"].to_pylist(), table["key"].to_pylist(), table["conv"].to_pylist()
    order = sorted(range(len(kind)), key=lambda i: (kind[i], key[i], conv[i]))
    before = next((key[i] for i in order if kind[i] < 0), None)
    after = next((key[i] for i in order if kind[i] > 0), None)
    rows = [i for i in order if kind[i] == 0]
    chars = table["chars"].combine_chunks()
    values, bounds = chars.values.to_numpy(zero_copy_only=False), chars.offsets.to_numpy()
    grown = Forest(
        table["part"][0].as_py(), [key[i] for i in rows], [conv[i] for i in rows], [values[bounds[i] : bounds[i + 1]] for i in rows], before, after
    ).grow()
    return pa.table(grown, schema=FOUND)


def _streamed_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each key; the rows come sorted, and only the state of one hash is held."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"prefix": pa.array([key], pa.binary()), "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        for prefix, piece in zip(batch.column("prefix"), batch.column("ends"), strict=True):
            if prefix.as_py() != key:
                if state is not None:
                    yield row()
                key, state = prefix.as_py(), hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_py().encode())
    if state is not None:
        yield row()


def _ranges(sequences: DataFrame) -> DataFrame:
    """The sorted sequences with the number of their range, and each range's neighbours beside them (kind -1 and 1)."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key")
    rows = tables.written(sequences.select("conv", key, F.transform("turns", lambda t: t["chars"]).alias("chars")))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    parts = max(tables.buckets_for(size["bytes"] or 0, RANGE_BYTES), size["n"] // RANGE_ROWS)
    rows = tables.written(rows.repartitionByRange(parts, "key", "conv").withColumn("part", F.spark_partition_id().cast("long")))
    one = F.struct("key", "conv", "chars")
    ends = rows.groupBy("part").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    ends = tables.written(ends.coalesce(8))
    # One row per range: the range before each one, as some may be empty.
    order = Window.orderBy("part")
    near = ends.select(F.col("part").alias("here"), F.lag("part").over(order).alias("previous")).filter("previous IS NOT NULL")
    left = near.join(ends, F.col("previous") == F.col("part")).select(F.col("here").alias("part"), F.lit(-1).alias("kind"), "last.*")
    right = near.join(ends, F.col("here") == F.col("part")).select(F.col("previous").alias("part"), F.lit(1).alias("kind"), "first.*")
    return rows.select("part", F.lit(0).alias("kind"), "key", "conv", "chars").unionByName(left).unionByName(right)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """A row per node of the trie over ``turn_sequences`` rows (conv unique): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""

    def make() -> DataFrame:
        found = tables.written(_ranges(sequences).groupBy("part").applyInArrow(_forest, FOUND_DDL))
        open_ = found.filter("is_open")
        merged = tables.written(open_.groupBy("prefix").agg(
            F.first("depth").alias("depth"), F.first("parent_prefix").alias("parent_prefix"), F.min("conv").alias("conv"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("shared").alias("shared"), F.first("before").alias("before"),
        ).coalesce(8))
        pieces = open_.filter("ends != ''").select("prefix", "part", "ends").repartition("prefix").sortWithinPartitions("prefix", "part")
        hashes = pieces.select("prefix", "ends").mapInArrow(_streamed_hash, "prefix binary, ends_sha256 string")
        named = merged.select(F.col("prefix").alias("parent_prefix"), F.col("conv").alias("open_parent"))
        # Finished nodes look up their open parents by range too, so that no parent gathers the rows of all ranges.
        by_range = open_.select("part", F.col("prefix").alias("parent_prefix")).join(named, "parent_prefix")
        closed = found.filter("NOT is_open")
        under_open = closed.filter("parent_prefix IS NOT NULL").drop("parent").join(by_range, ["part", "parent_prefix"])
        across = merged.join(hashes, "prefix", "left").join(named, "parent_prefix", "left")
        columns = ["conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "shared", "before", "ends"]
        nodes = closed.filter("parent_prefix IS NULL").select(*columns)
        nodes = nodes.unionByName(under_open.withColumnRenamed("open_parent", "parent").select(*columns))
        across = across.withColumn("ends", F.coalesce("ends_sha256", F.lit(NO_ENDS))).withColumnRenamed("open_parent", "parent")
        nodes = nodes.unionByName(across.select(*columns))
        return nodes.select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            (F.col("shared") - (F.col("n_convs") - 1) * F.col("before")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
        )

    return tables.result_of(make)
