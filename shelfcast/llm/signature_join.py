"""N-gram Jaccard join with signature trees.

Every document is the set of its distinct 5-word shingles (64-bit hashes); documents link when the Jaccard similarity of
their sets is at least 3/4. The work falls into four parts.

1. Shingle frequency. Sets are sent, packed by ranges of the hash, to buckets that count in how many different sets each
   shingle occurs; equal sets count once. Only shingles of two sets or more come back. Since a link needs 3/4 of a set to
   be shared, a set with too few shared shingles is finished here, and overlaps need only the shared ones.
2. Candidate groups. In the order of frequency, rarest first, two linked sets have one of their first
   ``shared - ceil(3/4 size) + 1`` shared shingles in common. Components over those shingles are the candidate groups: no
   link leaves a group, and shingles of common passages, which are last in the order, tie nothing together.
3. Signature trees. The sets of a group, cut into chunks where it is large, are the leaves of a tree whose nodes hold the
   OR of the bitmaps below, the range of set sizes, and whether all sets below are one class already. Two trees (or one
   with itself) are traversed together; a pair of nodes is left out if the sizes can't fit, if the bits in common can't
   reach the least overlap, or if both are of one class. What remains is compared exactly. Large groups go on in rounds:
   chunks by themselves, then one set of each class found so far, then only pairs of chunks that are not of one class and
   whose root nodes fit. So a group of many near copies costs about its size, not its square, and no pair is skipped.
4. Classes are the connected components of the links; the members of equal sets share their class.

NULL, empty and word-less texts have an empty set and are linked with nothing. Texts of fewer words than a shingle are
one shingle. Rows that repeat an id are judged each, and count as one document of that id. A NULL id is the least of all;
a class that holds one has a NULL component. An empty table gives an empty
result. Columns besides id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import arrays as A
from shelfcast.llm.components import components
from shelfcast.llm.tables import buckets_for, given, numbered, result_of, text_bytes, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
#: Least similarity as a fraction.
PART, WHOLE = 3, 4
#: Bytes of text whose shingles meet in one bucket, about.
BUCKET_BYTES = 12 << 20
#: Sets in one tree, and in one of its leaves.
CHUNK, LEAF, FAN = 1024, 16, 8
BITS = 2048

_PACKED = "bucket long, ids binary, sets binary, counts binary, values binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("ids", "sets", "counts", "values"))])


def shingles(part: A.Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each): the distinct shingles of every text, ascending in each text."""
    data = A.LOWER[part.data]
    start, end, of = A.word_spans(data, part.bounds, A.NOT_SPACE)
    word = A.byte_hashes(data, start, end)
    n = len(part.bounds) - 1
    count = np.bincount(of, minlength=n)
    weight = A.mix(np.arange(1, size + 1, dtype=A.U64))
    full = max(0, len(word) - size + 1)
    key = np.full(full, size, dtype=A.U64)
    for j in range(size):
        key += word[j : j + full] * weight[j]
    at = np.flatnonzero(of[:full] == of[size - 1 :]) if full else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    first = np.searchsorted(of, short)
    whole = count[short].astype(A.U64)
    for j in range(size - 1):
        inside = count[short] > j
        whole[inside] += word[first[inside] + j] * weight[j]
    key = A.mix(np.concatenate([key[at], whole]))
    of = np.concatenate([of[at], short])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], of[new]


def set_keys(key: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of every set: equal sets, equal keys; its size). Empty sets have key 0."""
    size = np.bincount(of, minlength=n).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(A.mix(key), dtype=A.U64)]).astype(A.U64)
    ends = np.cumsum(size)
    out = A.mix(total[ends] - total[ends - size] + size.astype(A.U64))
    out[out == 0] = 1
    out[size == 0] = 0
    return out.view(np.int64), size


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _by_bucket(bucket: np.ndarray, sets: np.ndarray, values: np.ndarray, extra: np.ndarray | None = None) -> Iterator[tuple]:
    """A row per bucket: its values in runs of equal sets. sets: the set of each value, equal ones adjacent."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bucket, sets, values = bucket[order], sets[order], values[order]
    extra = extra[order] if extra is not None else None
    edges = A.runs(bucket)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if a == b:
            continue
        run = A.runs(sets[a:b])
        yield int(bucket[a]), A.pack(extra[a:b]) if extra is not None else b"", A.pack(sets[a:b][run[:-1]]), A.pack(np.diff(run).astype(np.uint32)), A.pack(values[a:b])


def _emit(buckets: int, size: int):
    """Documents to packed rows: bucket b holds shingles, bucket -1 - b the documents (id, set, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for part in A.text_slices(batch.column("_text"), 8 << 20):
                n = part.last - part.first
                keys, ofs, base = [], [], 0
                for small in A.slices(part.data, part.bounds):
                    key, of = shingles(small, size)
                    keys.append(key)
                    ofs.append(of + base)
                    base += small.last - small.first
                key, of = np.concatenate(keys), np.concatenate(ofs)
                sets, sizes = set_keys(key, of, n)
                own = ids[part.first : part.last]
                spread = (A.mix(own.view(A.U64)) % A.U64(buckets)).astype(np.int64)
                rows = [(-1 - k, i, s, b"", v) for k, i, s, _, v in _documents(spread, own, sets, sizes)]
                # Equal sets of a batch are sent once.
                first = np.zeros(n, bool)
                first[np.unique(sets, return_index=True)[1]] = True
                keep = first[of]
                key, of = key[keep], of[keep]
                rows += _by_bucket(((key >> A.U64(32)) * A.U64(buckets) >> A.U64(32)).astype(np.int64), sets[of], key)
                yield _rows(rows)

    return run


def _documents(spread: np.ndarray, ids: np.ndarray, sets: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(spread, kind="stable")
    edges = A.runs(spread[order])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            at = order[a:b]
            yield int(spread[at[0]]), A.pack(ids[at]), A.pack(sets[at]), b"", A.pack(sizes[at])


def _get(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(column)] or [np.zeros(0, kind)])


def _share(buckets: int):
    """A bucket of shingles to those of two sets or more, with their frequency, packed by home bucket of the set."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:  # documents: hand on, and tell each set's home its size
            sets, sizes = _get(table, "sets", np.int64), _get(table, "values", np.int64)
            one, at = np.unique(sets, return_index=True)
            at = at[one != 0]
            home = (sets[at].view(A.U64) % A.U64(buckets)).astype(np.int64)
            sized = [(k, i, s, b"", v) for k, i, s, _, v in _documents(home, sets[at], sets[at], sizes[at])]
            rows = [(-1, A.pack(_get(table, "ids", np.int64)), A.pack(sets), b"", A.pack(sizes))] + [(k, b"", s, b"", v) for k, _, s, _, v in sized]
            return pa.Table.from_batches([_rows(rows)])
        value = _get(table, "values", A.U64)
        sets = np.repeat(_get(table, "sets", np.int64), _get(table, "counts", np.uint32))
        order = np.lexsort((sets, value))
        value, sets = value[order], sets[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (sets[1:] != sets[:-1])
        value, sets = value[new], sets[new]
        edges = A.runs(value)
        count = np.diff(edges)
        frequency = np.repeat(count, count) if len(value) else np.zeros(0, np.int64)
        shared = frequency > 1
        value, sets, frequency = value[shared], sets[shared], frequency[shared]
        order = np.argsort(sets, kind="stable")
        value, sets, frequency = value[order], sets[order], frequency[order]
        rows = list(_by_bucket((sets.view(A.U64) % A.U64(buckets)).astype(np.int64), sets, value, frequency.astype(np.uint32)))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _least(size: np.ndarray) -> np.ndarray:
    """Shingles that a set has at least in common with a linked one."""
    return -(-PART * size // WHOLE)


def _gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A home bucket to the sets that can have links: key, size, shared shingles (ascending) and the first of them, rarest first."""
    sized = pc.equal(pc.binary_length(table.column("counts")), 0)
    sizes, parts = table.filter(sized), table.filter(pc.invert(sized))
    one, at = np.unique(_get(sizes, "sets", np.int64), return_index=True)
    size_of = _get(sizes, "values", np.int64)[at]
    value, frequency = _get(parts, "values", A.U64), _get(parts, "ids", np.uint32)
    sets = np.repeat(_get(parts, "sets", np.int64), _get(parts, "counts", np.uint32))
    order = np.lexsort((value, frequency, sets))
    value, sets = value[order], sets[order]
    edges = A.runs(sets)
    shared = np.diff(edges)
    own = sets[edges[:-1]] if len(sets) else np.zeros(0, np.int64)
    size = size_of[np.searchsorted(one, own)] if len(own) else np.zeros(0, np.int64)
    fine = np.flatnonzero(shared[: len(own)] >= _least(size))
    out = {"set": own[fine], "size": size[fine], "values": [], "first": []}
    for i in fine.tolist():
        v = value[edges[i] : edges[i + 1]]
        out["first"].append(v[: len(v) - int(_least(size[i])) + 1].view(np.int64))
        out["values"].append(A.pack(np.sort(v)))
    return pa.table({
        "set": pa.array(out["set"], pa.int64()), "size": pa.array(out["size"], pa.int64()),
        "values": pa.array(out["values"], pa.binary()), "first": pa.array(out["first"], pa.list_(pa.int64())),
    })


class Tree:
    """Signature tree of some sets. Level 0 holds the sets, each level above nodes of up to ``FAN`` (at first ``LEAF``)."""

    def __init__(self, sets: np.ndarray, size: np.ndarray, values: list[np.ndarray], label: np.ndarray):
        # Sets of one class, then of like size, stand together: their nodes are tight.
        order = np.lexsort((sets, size, label))
        self.sets, self.size, self.label = sets[order], size[order], label[order]
        self.values = [values[i] for i in order]
        self.shared = np.array([len(v) for v in self.values], np.int64)
        bits = np.zeros((len(sets), BITS // 64), A.U64)
        for row, v in zip(bits, self.values, strict=True):
            at = (v & A.U64(BITS - 1)).astype(np.int64)
            np.bitwise_or.at(row, at >> 6, A.U64(1) << (at & 63).astype(A.U64))
        self.bits = bits
        # Shingles beyond the distinct bits: so many more than the bits in common two sets may share.
        self.extra = self.shared - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = []
        bounds = np.append(np.arange(0, len(sets), LEAF), len(sets))
        while True:
            self.levels.append((bounds, *self._summary(bounds)))
            if len(bounds) <= 2:
                break
            bounds = np.unique(np.append(bounds[:: FAN], bounds[-1]))

    def _summary(self, bounds: np.ndarray):
        at = bounds[:-1]
        return (
            np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.size, at), np.maximum.reduceat(self.size, at),
            np.maximum.reduceat(self.extra, at), np.maximum.reduceat(self.shared, at),
        )


def _can_link(a: tuple, b: tuple) -> bool:
    """May any set below one node be linked with any below the other?"""
    (bits_a, low_a, high_a, extra_a, shared_a), (bits_b, low_b, high_b, extra_b, shared_b) = a, b
    if WHOLE * high_a < PART * low_b or WHOLE * high_b < PART * low_a:
        return False
    # Overlap o links sizes a and b if o >= 3/7 (a + b).
    least = -(-PART * (low_a + low_b) // (PART + WHOLE))
    most = min(int(np.bitwise_count(bits_a & bits_b).sum()) + min(extra_a, extra_b), shared_a, shared_b)
    return most >= least


class Classes:
    """Classes of sets under the links found so far."""

    def __init__(self, labels: np.ndarray):
        self.parent = {int(x): int(x) for x in labels}

    def find(self, x: int) -> int:
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def dual_traversal(x: Tree, y: Tree, classes: Classes) -> list[tuple[int, int]]:
    """Links between the sets of two trees (or one and itself) that join different classes, each exactly checked."""
    links: list[tuple[int, int]] = []
    same = x is y

    def node(t: Tree, level: int, i: int) -> tuple:
        _, bits, low, high, extra, shared = t.levels[level]
        return bits[i], int(low[i]), int(high[i]), int(extra[i]), int(shared[i])

    def span(t: Tree, level: int, i: int) -> tuple[int, int]:
        bounds = t.levels[level][0]
        return int(bounds[i]), int(bounds[i + 1])

    def one_class(a: tuple[int, int], b: tuple[int, int]) -> bool:
        root = classes.find(int(x.label[a[0]]))
        seen = set(x.label[a[0] : a[1]].tolist()) | set(y.label[b[0] : b[1]].tolist())
        return all(classes.find(k) == root for k in seen)

    def children(t: Tree, level: int, i: int) -> range:
        a, b = span(t, level, i)
        below = t.levels[level - 1][0]
        return range(int(np.searchsorted(below, a)), int(np.searchsorted(below, b)))

    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        a, b = span(x, lx, i), span(y, ly, j)
        if not _can_link(node(x, lx, i), node(y, ly, j)) or one_class(a, b):
            continue
        if lx == 0 and ly == 0:
            _compare(x, y, a, b, same and i == j, classes, links)
        elif same and lx == ly:
            kids = list(children(x, lx, i)), list(children(y, ly, j))
            stack += [(lx - 1, p, ly - 1, q) for p in kids[0] for q in kids[1] if i != j or p <= q]
        elif lx >= ly:
            stack += [(lx - 1, p, ly, j) for p in children(x, lx, i)]
        else:
            stack += [(lx, i, ly - 1, q) for q in children(y, ly, j)]
    return links


def _compare(x: Tree, y: Tree, a: tuple[int, int], b: tuple[int, int], triangle: bool, classes: Classes, links: list) -> None:
    """The sets of two leaves, pair by pair, after the bounds of all pairs at once."""
    common = np.bitwise_count(x.bits[a[0] : a[1], None, :] & y.bits[None, b[0] : b[1], :]).sum(axis=2).astype(np.int64)
    most = common + np.minimum(x.extra[a[0] : a[1], None], y.extra[None, b[0] : b[1]])
    least = -(-PART * (x.size[a[0] : a[1], None] + y.size[None, b[0] : b[1]]) // (PART + WHOLE))
    may = most >= least
    if triangle:
        may &= np.arange(a[0], a[1])[:, None] < np.arange(b[0], b[1])[None, :]
    for p, q in zip(*(k.tolist() for k in np.nonzero(may)), strict=True):
        s, t = a[0] + p, b[0] + q
        if classes.find(int(x.label[s])) == classes.find(int(y.label[t])):
            continue
        both = np.concatenate([x.values[s], y.values[t]])
        both.sort()
        if int((both[1:] == both[:-1]).sum()) >= least[p, q]:
            classes.join(int(x.label[s]), int(y.label[t]))
            links.append((int(x.sets[s]), int(y.sets[t])))


def _tree(frame: pd.DataFrame) -> Tree:
    return Tree(
        frame["set"].to_numpy(np.int64), frame["size"].to_numpy(np.int64), [np.frombuffer(v, A.U64) for v in frame["values"]], frame["label"].to_numpy(np.int64)
    )


_LINKS = "src long, dst long"


def _within(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Links inside every chunk of a task, as stars: each label that was joined with others, and the least of them."""
    links: list[tuple[int, int]] = []
    for _, chunk in frame.groupby(["group", "chunk"], sort=False):
        if len(chunk) > 1:
            tree, classes = _tree(chunk), Classes(chunk["label"].to_numpy(np.int64))
            dual_traversal(tree, tree, classes)
            links += [(x, root) for x in classes.parent if (root := classes.find(x)) != x]
    return pd.DataFrame(links, columns=["src", "dst"])


def _between(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Links of the pairs of chunks of a task; both chunks of a pair stand in its rows."""
    links: list[tuple[int, int]] = []
    for _, pair in frame.groupby("pair", sort=False):
        sides = [_tree(side) for _, side in pair.groupby("side")]
        links += dual_traversal(sides[0], sides[-1], Classes(pair["label"].to_numpy(np.int64)))
    return pd.DataFrame(links, columns=["src", "dst"])


def _relabel(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """``rows`` with the class of each label after the stars of ``_within``; a label stands in one chunk, so in one star."""
    new = stars.select(F.col("src").alias("label"), F.col("dst").alias("_new"))
    return rows.join(new, "label", "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def _chunks_within(rows: DataFrame) -> DataFrame:
    """Chunk numbers: a group of n sets has n / CHUNK of them, filled by a hash of the set."""
    counts = rows.groupBy("group").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    return rows.join(counts, "group").withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks"))).drop("chunks")


def _join_within(rows: DataFrame, tasks: int) -> DataFrame:
    rows = rows.select("group", "chunk", "set", "size", "values", "label")
    return rows.groupBy(F.pmod(F.xxhash64("group", "chunk"), F.lit(tasks)).alias("task")).applyInPandas(_within, _LINKS)


def _or_bits(frame: pd.DataFrame) -> pd.DataFrame:
    values = np.unique(np.concatenate([np.frombuffer(v, A.U64) for v in frame["values"]]))
    bits = np.zeros(BITS // 64, A.U64)
    at = (values & A.U64(BITS - 1)).astype(np.int64)
    np.bitwise_or.at(bits, at >> 6, A.U64(1) << (at & 63).astype(A.U64))
    size = np.array([len(v) // 8 for v in frame["values"]])
    distinct = np.array([len(np.unique(np.frombuffer(v, A.U64) & A.U64(BITS - 1))) for v in frame["values"]])
    return pd.DataFrame({
        "group": [int(frame["group"].iloc[0])], "chunk": [int(frame["chunk"].iloc[0])], "bits": [A.pack(bits)], "low": [int(frame["size"].min())],
        "high": [int(frame["size"].max())], "extra": [int((size - distinct).max())], "shared": [int(size.max())],
        "label": [int(frame["label"].iloc[0]) if frame["label"].nunique() == 1 else None],
    }).astype({"label": "Int64"})


_NODE = "group long, chunk long, bits binary, low long, high long, extra long, shared long, label long"


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of root nodes that may hold links."""
    for batch in batches:
        fits = []
        for r in batch.to_pylist():
            sides = [(np.frombuffer(r[f"bits{s}"], A.U64), r[f"low{s}"], r[f"high{s}"], r[f"extra{s}"], r[f"shared{s}"]) for s in (0, 1)]
            fits.append(_can_link(*sides))
        yield batch.filter(pa.array(fits, pa.bool_())).select(["group", "chunk0", "chunk1"])


def _remaining_links(rows: DataFrame, tasks: int) -> DataFrame:
    """Links between classes of the groups that are not one class yet: pairs of chunks whose root nodes fit.

    Classes of at least half a chunk get chunks of their own, in which nothing is left to find; the others are mixed.
    """
    open_ = rows.groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("group")
    rows = rows.join(open_, "group")
    sizes = rows.groupBy("group", "label").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("own", F.col("n") >= CHUNK // 2)
    rest = sizes.filter(~F.col("own")).groupBy("group").agg(F.ceil(F.sum("n") / CHUNK).alias("mixed"))
    sizes = sizes.join(rest, "group", "left").withColumn("parts", F.when(F.col("own"), F.ceil(F.col("n") / CHUNK)).otherwise(F.col("mixed")))
    rows = rows.join(sizes.select("group", "label", "own", "parts"), ["group", "label"])
    part = F.pmod(F.xxhash64("set", F.lit(1)), F.col("parts"))
    rows = rows.withColumn("chunk", F.when(F.col("own"), F.xxhash64("label", part)).otherwise(part))
    rows = written(rows.select("group", "chunk", "set", "size", "values", "label"))
    nodes = written(rows.groupBy("group", "chunk").applyInPandas(_or_bits, _NODE))
    side = lambda k: nodes.select("group", *(F.col(c).alias(f"{c}{k}") for c in ("chunk", "bits", "low", "high", "extra", "shared", "label")))
    pairs = side(0).join(side(1), "group").filter("chunk0 < chunk1 OR (chunk0 = chunk1 AND label0 IS NULL)")
    pairs = pairs.filter("label0 IS NULL OR label1 IS NULL OR label0 != label1")
    pairs = pairs.mapInArrow(_fitting, "group long, chunk0 long, chunk1 long")
    sides = pairs.select(
        "group", F.xxhash64("group", "chunk0", "chunk1").alias("pair"),
        F.explode(F.when(F.col("chunk0") == F.col("chunk1"), F.array(F.struct(F.lit(0).alias("side"), F.col("chunk0").alias("chunk"))))
                  .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("chunk0").alias("chunk")), F.struct(F.lit(1).alias("side"), F.col("chunk1").alias("chunk"))))).alias("s"),
    ).select("group", "pair", "s.side", "s.chunk")
    work = sides.join(rows, ["group", "chunk"])
    return work.groupBy(F.pmod(F.col("pair"), F.lit(tasks)).alias("task")).applyInPandas(_between, _LINKS)


def links_and_members(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(links between sets that connect all linked ones: src, dst; members: id, set, size of every document)."""
    total = text_bytes(docs, text)
    buckets = buckets_for(total, BUCKET_BYTES)
    packed = docs.select(numbered(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(_emit(buckets, shingle), _PACKED)
    shared = written(packed.groupBy("bucket").applyInArrow(_share(buckets), _PACKED))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(batch.column(c)[i].as_buffer(), np.int64)) for c in ("ids", "sets", "values")], ["_id", "set", "size"])

    members = shared.filter("bucket = -1").select("ids", "sets", "values").mapInArrow(unpack, "_id long, set long, size long")
    sets = written(shared.filter("bucket >= 0").groupBy("bucket").applyInArrow(_gather, "set long, size long, values binary, first array<long>"))
    ties = sets.select("set", F.explode("first").alias("value"))
    least = ties.groupBy("value").agg(F.min("set").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    group = components(ties.join(least, "value").filter("set != hub").select(F.col("set").alias("src"), F.col("hub").alias("dst")).distinct())
    rows = sets.drop("first").join(group.select(F.col("node").alias("set"), F.col("component").alias("group")), "set")
    rows = written(_chunks_within(rows).withColumn("label", F.col("set")))
    tasks = max(8, buckets * 2)
    links = written(_join_within(rows, tasks))
    large = rows.groupBy("group").agg(F.max("chunk").alias("_c")).filter("_c > 0").select("group")
    rows = written(_relabel(rows.join(large, "group"), links))
    if rows.limit(1).count():
        # One set of each class found inside the chunks stands for it, then what is still open is compared in full.
        heads = rows.join(rows.groupBy("group", "label").agg(F.min("set").alias("set")), ["group", "label", "set"]).drop("chunk")
        more = written(_join_within(_chunks_within(heads), tasks))
        rows = written(_relabel(rows, more))
        links = links.union(more).union(written(_remaining_links(rows, tasks)))
    return links, members


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, n_shingles, component_id (the least id reachable by links) of every document: three numbers each, written."""
    return result_of(lambda: _classes(docs, id_col, text, shingle))


def _classes(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    links, members = links_and_members(docs, id_col, text, shingle)
    classes = components(links).select(F.col("node").alias("set"), "component")
    members = written(members)
    # Equal sets first: one row per set and task, however many copies there are.
    least = members.filter("set != 0").groupBy("set").agg(F.min("_id").alias("least"))
    least = least.join(classes, "set", "left").withColumn("component", F.coalesce("component", "set"))
    whole = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = least.join(whole, "component").select("set", "component_id")
    out = members.join(of_set, "set", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "_id"))
    return out.select(given("_id").alias(id_col), F.col("size").alias("n_shingles"), given("component_id").alias("component_id"))
