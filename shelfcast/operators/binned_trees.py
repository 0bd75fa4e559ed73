"""Trees over all rows, grown from histograms of features coded to 8 bits; boosting with gradients and curvatures.

Rows are coded once and packed into blocks of at most ``BLOCK_ROWS``, written to the shared folder. A level of all trees that
grow at the same time (those of several models and folds, or all trees of a forest) is one Spark job: each task sums the
statistics of its blocks by (tree, node, feature, bin), the sums are merged by (tree, node), and the best split of a node is
all that comes back. A split maximises G_left**2 / (H_left + ridge) + G_right**2 / (H_right + ridge), for boosting with G the
gradients and H the curvatures.

A table of one block needs no merging, so there a job grows whole trees, one task for each model or run of trees. Both
ways use the same functions on the same sums and give the same trees.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import cut_lineage

# The functions travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256
BLOCK_ROWS = 1 << 16
#: Sums that a task holds before it hands them on.
HELD_BYTES = 128 << 20
#: G, H and rows of every bin.
STATS = 3


@dataclass
class Tree:
    """Nodes in the order of levels: feature (-1: leaf), last bin of the left side, first child, and the sums of each node."""

    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    sums: np.ndarray = field(default_factory=lambda: np.zeros((1, STATS)))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))
    first: int = 0  # of the level that may still be split

    @property
    def open(self) -> int:
        return len(self.feature) - self.first

    def place(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            right = bins[rows, np.maximum(f, 0)] > self.cut[node]
            node = np.where(inner, self.child[node] + right, node)

    def split(self, best: Best) -> None:
        """Split the open level: nodes whose best gain is above 0 get two children, which are the next level."""
        if self.first == 0:
            self.sums[0] = best.total[0]
        here = self.first + np.flatnonzero(best.gain > 1e-9)
        which = here - self.first
        new = len(self.feature)
        self.feature[here], self.cut[here], self.gain[here] = best.feature[which], best.cut[which], best.gain[which]
        self.child[here] = new + 2 * np.arange(len(here))
        below = np.stack([best.left[which], best.total[which] - best.left[which]], axis=1).reshape(-1, STATS)
        n = len(below)
        self.feature = np.concatenate([self.feature, np.full(n, -1)])
        self.cut, self.child = (np.concatenate([a, np.zeros(n, np.int64)]) for a in (self.cut, self.child))
        self.gain = np.concatenate([self.gain, np.zeros(n)])
        self.sums = np.concatenate([self.sums, below])
        self.first = new


@dataclass
class Best:
    """The best split of every node of a level."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    total: np.ndarray


def histogram(slots: np.ndarray, node: np.ndarray, count: int, stats: Sequence[np.ndarray]) -> np.ndarray:
    """Sums by (statistic, node, feature, bin). slots: feature * BINS + bin of every row and feature."""
    width = slots.shape[1]
    index = (slots + (node * (width * BINS))[:, None]).reshape(-1)
    # For the squared loss the curvatures are the weights.
    made = [np.bincount(index, np.repeat(s, width), count * width * BINS) if k != 2 or s is not stats[1] else None for k, s in enumerate(stats)]
    made[2] = made[1] if made[2] is None else made[2]
    return np.stack(made).reshape(STATS, count, width, BINS)


def best_splits(sums: np.ndarray, ridge: float, least: float, allowed: np.ndarray) -> Best:
    """Ties go to the first feature, then the least bin."""
    chosen = np.flatnonzero(allowed)
    left = np.cumsum(sums[:, :, chosen], axis=3)
    total = left[:, :, :1, -1:]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda s: np.where(s[1] + ridge > 0, s[0] ** 2 / (s[1] + ridge), 0.0)
        gain = part(left) + part(right) - part(total)
    fine = (left[2] >= least) & (right[2] >= least) & (left[2] > 0) & (right[2] > 0)
    gain = np.where(fine, gain, 0.0).reshape(sums.shape[1], -1)
    at = gain.argmax(axis=1)
    rows = np.arange(len(at))
    f, cut = at // BINS, at % BINS
    return Best(chosen[f], cut, gain[rows, at], left[:, rows, f, cut].T, total[:, :, 0, 0].T)


# --- rows as blocks -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Coding:
    """The borders of each feature's bins: bin b holds values above border b - 1, up to border b."""

    features: tuple[str, ...]
    borders: tuple[np.ndarray, ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x[:, j]) for j, b in enumerate(self.borders)], axis=1).astype(np.uint8)


def _filled(f: str) -> Column:
    return F.coalesce(F.col(f).cast("double"), F.lit(0.0))


def coding(rows: DataFrame, features: Sequence[str]) -> Coding:
    """At most 255 borders per feature, at its quantiles."""
    shares = [k / BINS for k in range(1, BINS)]
    row = rows.agg(*[F.percentile_approx(_filled(f), shares, 10_000).alias(f"_{j}") for j, f in enumerate(features)]).first()
    return Coding(tuple(features), tuple(np.unique(np.array(row[j] or [], float)) for j in range(len(features))))


@dataclass(frozen=True)
class Blocks:
    """Coded rows: one DataFrame row per block (block, n, bins, columns), and the names of the packed columns."""

    table: DataFrame
    coding: Coding
    names: tuple[str, ...]
    count: int


def blocks_of(rows: DataFrame, features: Sequence[str], columns: dict[str, str], row_id: Sequence[str]) -> Blocks:
    """``columns``: packed name -> column of doubles. A row's 63-bit ``key``, a hash of its id, comes with them."""
    n = rows.count()
    code, count = coding(rows, features), max(1, -(-n // BLOCK_ROWS))
    names = tuple(columns)
    key = F.shiftrightunsigned(F.xxhash64(*row_id), 1)
    flat = rows.select(key.alias("_key"), *[F.col(c).cast("double").alias(f"_c_{k}") for k, c in columns.items()], *[_filled(f).alias(f"_f_{f}") for f in features])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_key")
        x = np.stack([table[f"_f_{f}"].to_numpy() for f in code.features], axis=1)
        values = [np.ascontiguousarray(table[f"_c_{k}"].to_numpy(), float).tobytes() for k in names]
        packed = {"block": [table["_block"][0].as_py()], "n": [len(x)], "key": [table["_key"].to_numpy().tobytes()], "bins": [code.bins(x).tobytes()], "columns": [values]}
        return pa.table(packed, schema=pa.schema([("block", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("bins", pa.binary()), ("columns", pa.list_(pa.binary()))]))

    table = flat.withColumn("_block", F.col("_key") % count).groupBy("_block").applyInArrow(pack, "block long, n long, key binary, bins binary, columns array<binary>")
    return Blocks(cut_lineage(table), code, names, count)


@dataclass
class Block:
    number: int
    key: np.ndarray
    bins: np.ndarray
    columns: dict[str, np.ndarray]

    @cached_property
    def slots(self) -> np.ndarray:
        return self.bins + np.arange(self.bins.shape[1]) * BINS

    def chance(self, salt: int) -> np.ndarray:
        """A uniform number for every row, by its id and ``salt``."""
        return uniform(self.key, salt)


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    x = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def unpacked(table: pa.Table | pa.RecordBatch, names: Sequence[str]) -> Iterator[Block]:
    for k in range(table.num_rows):
        n = table["n"][k].as_py()
        bins = np.frombuffer(table["bins"][k].as_py(), np.uint8).reshape(n, -1)
        columns = {c: np.frombuffer(v, float) for c, v in zip(names, table["columns"][k].as_py(), strict=True)}
        yield Block(table["block"][k].as_py(), np.frombuffer(table["key"][k].as_py(), np.int64), bins, columns)


# --- growing ------------------------------------------------------------------------------------------------------

#: (block, number of the tree) -> G, H and weight of every row; rows of weight 0 take no part.
Statistics = Callable[[Block, int], Sequence[np.ndarray]]


@dataclass(frozen=True)
class Rule:
    depth: int
    ridge: float
    least: float


def _level(block: Block, tree: Tree, stats: Sequence[np.ndarray]) -> np.ndarray:
    node = tree.place(block.bins) - tree.first
    rows = np.flatnonzero((node >= 0) & (stats[2] != 0))
    return histogram(block.slots[rows], node[rows], tree.open, _taken(stats, rows))


def _taken(stats: Sequence[np.ndarray], rows: np.ndarray) -> list[np.ndarray]:
    first = [s[rows] for s in stats[:2]]
    return [*first, first[1] if stats[2] is stats[1] else stats[2][rows]]


def grown_here(block: Block, stats: Sequence[np.ndarray], rule: Rule, allowed: np.ndarray) -> Tree:
    """A whole tree of a table of one block. Of two siblings the smaller one is summed, the other is the rest of their parent."""
    rows = np.flatnonzero(stats[2])
    bins, slots, stats = block.bins[rows], block.slots[rows], _taken(stats, rows)
    every, node, tree, parents = np.arange(len(rows)), np.zeros(len(rows), np.int64), Tree(), None
    for _ in range(rule.depth):
        if parents is None:
            sums = histogram(slots, node, 1, stats)
        else:
            pair, sizes = tree.open // 2, tree.sums[tree.first :, 2].reshape(-1, 2)
            smaller = (sizes[:, 1] < sizes[:, 0]).astype(np.int64)
            place = node - tree.first
            mine = np.flatnonzero((place >= 0) & ((place & 1) == smaller[np.maximum(place, 0) >> 1]))
            small = histogram(slots[mine], place[mine] >> 1, pair, _taken(stats, mine))
            sums = np.empty((STATS, pair, 2, *small.shape[2:]))
            sums[:, np.arange(pair), smaller] = small
            sums[:, np.arange(pair), 1 - smaller] = parents - small
            sums = sums.reshape(STATS, 2 * pair, *small.shape[2:])
        best = best_splits(sums, rule.ridge, rule.least, allowed)
        parents = sums[:, best.gain > 1e-9]
        tree.split(best)
        if not tree.open:
            break
        f = tree.feature[node]
        right = bins[every, np.maximum(f, 0)] > tree.cut[node]
        node = np.where(f >= 0, tree.child[node] + right, node)
    return tree


_PARTIAL = "tree int, node int, sums binary"
_BEST = "tree int, node int, feature int, cut int, gain double, left array<double>, total array<double>"


def grown_level(blocks: Blocks, trees: dict[int, Tree], statistics: Statistics, rule: Rule, allowed: dict[int, np.ndarray]) -> None:
    """One job: the open level of all ``trees`` is split."""
    spark, names, width = blocks.table.sparkSession, blocks.names, len(blocks.coding.features)
    state = spark.sparkContext.broadcast(trees)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for number, sums in total.items():
                n = sums.shape[1]
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([number] * n, pa.int32()), "node": pa.array(range(n), pa.int32()),
                    "sums": pa.array([np.ascontiguousarray(sums[:, k]).tobytes() for k in range(n)], pa.binary()),
                })
            total.clear()

        for batch in batches:
            for block in unpacked(batch, names):
                for number, tree in state.value.items():
                    if tree.open:
                        sums = _level(block, tree, statistics(block, number))
                        total[number] = total[number] + sums if number in total else sums
                        if sum(s.nbytes for s in total.values()) > HELD_BYTES:
                            yield from out()
        yield from out()

    def merge(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(s.as_buffer(), float) for s in table["sums"]).reshape(STATS, 1, width, BINS)
        tree = table["tree"][0].as_py()
        best = best_splits(sums, rule.ridge, rule.least, allowed[tree])
        row = {"tree": [tree], "node": [table["node"][0].as_py()], "feature": best.feature, "cut": best.cut, "gain": best.gain, "left": best.left.tolist(), "total": best.total.tolist()}
        return pa.table(row, schema=pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("left", pa.list_(pa.float64())), ("total", pa.list_(pa.float64()))]))

    found = blocks.table.mapInArrow(partial, _PARTIAL).groupBy("tree", "node").applyInArrow(merge, _BEST).orderBy("tree", "node").toPandas()
    state.destroy()
    for number, rows in found.groupby("tree"):
        best = Best(rows["feature"].to_numpy(), rows["cut"].to_numpy(), rows["gain"].to_numpy(), np.stack(rows["left"]), np.stack(rows["total"]))
        trees[number].split(best)


def grown(blocks: Blocks, numbers: Sequence[int], statistics: Statistics, rule: Rule, allowed: dict[int, np.ndarray]) -> dict[int, Tree]:
    """All trees of ``numbers``, a job per level."""
    trees = {k: Tree() for k in numbers}
    for _ in range(rule.depth):
        if not any(t.open for t in trees.values()):
            break
        grown_level(blocks, trees, statistics, rule, allowed)
    return trees


# --- models -------------------------------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """Trees with thresholds, as flat node arrays: start + the sum of the leaves' values."""

    features: tuple[str, ...]
    start: float
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    gains: np.ndarray
    logistic: bool = False

    @classmethod
    def of(cls, code: Coding, start: float, trees: Sequence[Tree], values: Sequence[np.ndarray], logistic: bool = False) -> TreeModel:
        sizes = [len(t.feature) for t in trees]
        roots = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        join = lambda parts, kind=float: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        thresholds = [np.array([code.borders[f][c] if f >= 0 else 0.0 for f, c in zip(t.feature, t.cut, strict=True)]) for t in trees]
        gains = np.zeros(len(code.features))
        for t in trees:
            np.add.at(gains, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return cls(
            code.features, start, join([t.feature for t in trees], np.int64), join(thresholds),
            join([np.where(t.feature >= 0, t.child + r, 0) for t, r in zip(trees, roots, strict=True)], np.int64), join(values), roots, gains, logistic,
        )

    def leaves(self, x: np.ndarray, root: int) -> np.ndarray:
        node, rows = np.full(len(x), root), np.arange(len(x))
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            node = np.where(inner, self.child[node] + (x[rows, np.maximum(f, 0)] > self.threshold[node]), node)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for root in self.roots:
            out += self.value[self.leaves(x, root)]
        return 1 / (1 + np.exp(-out)) if self.logistic else out

    def importances(self) -> np.ndarray:
        total = self.gains.sum()
        return self.gains / total if total > 0 else self.gains


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch[n].to_numpy(zero_copy_only=False) for n in names], axis=1) if batch.num_rows else np.zeros((0, len(names)))


def with_arrays(df: DataFrame, features: Sequence[str], make: Callable[[np.ndarray], Sequence[np.ndarray]], names: Sequence[str]) -> DataFrame:
    """``df`` with the columns ``names``, computed by ``make`` from whole Arrow batches of the features. Missing values count as 0."""
    inputs, kept = [f"_x_{i}" for i in range(len(features))], df.columns
    rows = df.withColumns({i: _filled(f) for i, f in zip(inputs, features, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(matrix(batch, inputs))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(m, pa.float64()) for m in made]], [*kept, *names])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *[f"`{n}` double" for n in names]])
    return rows.mapInArrow(run, schema)


def scored(model: TreeModel, df: DataFrame, out: str = "Predicted") -> DataFrame:
    return with_arrays(df.drop(out), model.features, lambda x: [model.predict(x)], [out])


# --- boosting -----------------------------------------------------------------------------------------------------

RIDGE = 1.0
#: Salt of the random numbers that choose rows; a tree's number is added.
_ROWS = 1_000_003


@dataclass(frozen=True)
class Task:
    """One model of a joint fit: target column, loss, and the 0/1 column of the rows it learns from."""

    target: str
    learns: str
    logistic: bool = False


class Margins:
    """What a Python worker remembers of the sums of leaves so far; a worker that does not know them walks the trees again."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return {"known": {}}

    def of(self, block: Block, task: int, start: float, trees: Sequence[Tree], values: Sequence[np.ndarray]) -> np.ndarray:
        done, margin = self.known.get((block.number, task), (0, None))
        if margin is None or done > len(trees):
            done, margin = 0, np.full(len(block.key), start)
        for tree, value in zip(trees[done:], values[done:], strict=True):
            margin = margin + value[tree.place(block.bins)]
        self.known[block.number, task] = len(trees), margin
        return margin


def gradients(block: Block, task: Task, margin: np.ndarray, tree: int, row_share: float, seed: int) -> list[np.ndarray]:
    """G, H and weight: the negative gradient of the loss, its curvature, 1 for a row that this tree learns from."""
    y, use = block.columns[task.target], block.columns[task.learns].copy()
    if row_share < 1:
        use *= block.chance(_ROWS * (seed + 1) + tree) < row_share
    if task.logistic:
        p = 1 / (1 + np.exp(-margin))
        return [(y - p) * use, p * (1 - p) * use, use]
    return [(y - margin) * use, use, use]


def leaf_values(tree: Tree, rate: float) -> np.ndarray:
    return rate * tree.sums[:, 0] / (tree.sums[:, 1] + RIDGE)


def columns_of(tree: int, width: int, share: float, seed: int) -> np.ndarray:
    allowed = np.ones(width, bool)
    if share < 1:
        allowed[:] = False
        allowed[np.random.default_rng([seed, tree]).choice(width, max(1, round(share * width)), replace=False)] = True
    return allowed


def boosted(blocks: Blocks, tasks: Sequence[Task], trees: int, depth: int, rate: float, row_share: float = 1.0, feature_share: float = 1.0, seed: int = 42) -> list[TreeModel]:
    """One model per task, all grown in step: a job splits one level of the next tree of every model."""
    width, rule = len(blocks.coding.features), Rule(depth, RIDGE, 1.0)
    starts = _starts(blocks, tasks)
    if blocks.count == 1:
        made = _boosted_here(blocks, tasks, starts, trees, rule, rate, row_share, feature_share, seed)
    else:
        made = [[] for _ in tasks]
        memory = blocks.table.sparkSession.sparkContext.broadcast(Margins())
        for k in range(trees):
            allowed = columns_of(k, width, feature_share, seed)
            sofar = blocks.table.sparkSession.sparkContext.broadcast([(ts, [leaf_values(t, rate) for t in ts]) for ts in made])

            def statistics(block: Block, task: int, sofar=sofar, k=k) -> list[np.ndarray]:
                margin = memory.value.of(block, task, starts[task], *sofar.value[task])
                return gradients(block, tasks[task], margin, k, row_share, seed)

            grown_now = grown(blocks, range(len(tasks)), statistics, rule, dict.fromkeys(range(len(tasks)), allowed))
            for task, tree in grown_now.items():
                made[task].append(tree)
            sofar.destroy()
        memory.destroy()
    return [TreeModel.of(blocks.coding, s, ts, [leaf_values(t, rate) for t in ts], task.logistic) for s, ts, task in zip(starts, made, tasks, strict=True)]


def _starts(blocks: Blocks, tasks: Sequence[Task]) -> list[float]:
    names = blocks.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in unpacked(batch, names):
                use = [block.columns[t.learns] for t in tasks]
                sums = [float((block.columns[t.target] * u).sum()) for t, u in zip(tasks, use, strict=True)]
                yield pa.RecordBatch.from_pydict({"task": pa.array(range(len(tasks)), pa.int32()), "total": sums, "rows": [float(u.sum()) for u in use]})

    found = blocks.table.mapInArrow(run, "task int, total double, rows double").groupBy("task").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows")).collect()
    mean = {r["task"]: r["total"] / r["rows"] if r["rows"] else 0.0 for r in found}
    clipped = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    return [float(np.log(clipped(m) / (1 - clipped(m)))) if t.logistic else m for t, m in ((t, mean.get(k, 0.0)) for k, t in enumerate(tasks))]


def _boosted_here(blocks: Blocks, tasks, starts, trees, rule, rate, row_share, feature_share, seed) -> list[list[Tree]]:
    names = blocks.names

    def run(table: pa.Table) -> pa.Table:
        number = table["task"][0].as_py()
        block, margin, out = next(unpacked(table, names)), None, []
        margin = np.full(len(block.key), starts[number])
        for k in range(trees):
            stats = gradients(block, tasks[number], margin, k, row_share, seed)
            tree = grown_here(block, stats, rule, columns_of(k, block.bins.shape[1], feature_share, seed))
            margin = margin + leaf_values(tree, rate)[tree.place(block.bins)]
            out.append(tree)
        return pa.table({"task": pa.array([number], pa.int32()), "trees": pa.array([cloudpickle.dumps(out)], pa.binary())})

    each = blocks.table.withColumn("task", F.explode(F.array(*[F.lit(k) for k in range(len(tasks))])))
    # As many partitions as models, by a number that spreads them: a model is a task of its own.
    found = each.repartition(len(tasks), "task").groupBy("task").applyInArrow(run, "task int, trees binary").collect()
    made = {r["task"]: cloudpickle.loads(bytes(r["trees"])) for r in found}
    return [made.get(k, []) for k in range(len(tasks))]


# --- Shapley values -----------------------------------------------------------------------------------------------


def leaf_boxes(model: TreeModel) -> list[tuple[list[int], np.ndarray, np.ndarray, float]]:
    """(features, lower bounds, upper bounds, value) of every leaf: it holds the rows with lower < x <= upper."""
    out = []
    for root in model.roots.tolist():
        stack = [(root, {})]
        while stack:
            node, box = stack.pop()
            f = int(model.feature[node])
            if f < 0:
                names = sorted(box)
                out.append((names, np.array([box[k][0] for k in names]), np.array([box[k][1] for k in names]), float(model.value[node])))
                continue
            low, high = box.get(f, (-np.inf, np.inf))
            t = float(model.threshold[node])
            if low < t:
                stack.append((int(model.child[node]), box | {f: (low, min(high, t))}))
            if t < high:
                stack.append((int(model.child[node]) + 1, box | {f: (max(low, t), high)}))
    return out


_WEIGHTS: dict[int, np.ndarray] = {}


def pattern_weights(k: int) -> np.ndarray:
    """Weight of each feature by (pattern of the row, pattern of the background row): which of the k bounds each one keeps.

    A feature that only the row keeps must be taken from the row, one that only the background keeps from the background; if
    neither keeps one, the leaf is out of reach. Of m + n such features, each of the m gets (m-1)! n! / (m+n)!, each of the n
    minus m! (n-1)! / (m+n)!.
    """
    if k not in _WEIGHTS:
        fact = np.cumprod([1.0, *range(1, k + 1)])
        out = np.zeros((1 << k, 1 << k, k))
        for p in range(1 << k):
            for q in range(1 << k):
                if p | q != (1 << k) - 1:
                    continue
                mine, theirs = [i for i in range(k) if not q >> i & 1], [i for i in range(k) if not p >> i & 1]
                m, n = len(mine), len(theirs)
                out[p, q, mine] = fact[m - 1] * fact[n] / fact[m + n] if m else 0
                out[p, q, theirs] = -fact[m] * fact[n - 1] / fact[m + n] if n else 0
        _WEIGHTS[k] = out
    return _WEIGHTS[k]


def _kept(x: np.ndarray, names: Sequence[int], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    pattern = np.zeros(len(x), np.int64)
    for i, f in enumerate(names):
        pattern |= ((x[:, f] > low[i]) & (x[:, f] <= high[i])).astype(np.int64) << i
    return pattern


def shapley_matrix(model: TreeModel, x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Exact interventional Shapley values of every row and feature, the mean over the background rows. Depth bounds the work."""
    out = np.zeros(x.shape)
    for names, low, high, value in leaf_boxes(model):
        k = len(names)
        if not k or not value:
            continue
        often = np.bincount(_kept(background, names, low, high), minlength=1 << k)
        seen = np.flatnonzero(often)
        table = np.einsum("pqi,q->pi", pattern_weights(k)[:, seen], often[seen] / len(background)) * value
        out[:, names] += table[_kept(x, names, low, high)]
    return out


def background_rows(rows: DataFrame, features: Sequence[str], row_id: Sequence[str], size: int = 100) -> np.ndarray:
    """A bounded sample, the first ``size`` rows in the order of a hash of the id."""
    values = [_filled(f).alias(f"_{i}") for i, f in enumerate(features)]
    return np.array([tuple(r) for r in rows.orderBy(F.xxhash64(*row_id), *row_id).limit(size).select(*values).collect()], float).reshape(-1, len(features))


def tree_shapley(model: TreeModel, rows: DataFrame, row_id: Sequence[str], background: np.ndarray | None = None) -> DataFrame:
    """row_id, Shap_<feature> of every feature, Predicted, Baseline: the values add up to Predicted - Baseline.

    Baseline is the mean prediction of the background rows (by default 100 of ``rows``).
    """
    if model.logistic:
        raise ValueError("values of a logistic model add up on the scale of its margins, not of its predictions")
    background = background_rows(rows, model.features, row_id) if background is None else background
    base = float(model.predict(background).mean())
    names = [f"Shap_{f}" for f in model.features]

    def make(x: np.ndarray) -> list[np.ndarray]:
        return [*shapley_matrix(model, x, background).T, model.predict(x), np.full(len(x), base)]

    made = with_arrays(rows.select(*dict.fromkeys([*row_id, *model.features])), model.features, make, [*names, "Predicted", "Baseline"])
    return made.select(*row_id, *names, "Predicted", "Baseline")
