"""Honest causal forest on residuals, with an interval for every row.

Trees come in little bags. A bag weighs every cluster (store) by a Poisson number that depends on cluster and bag alone, as a
bootstrap of whole clusters does; a tree halves the rows of its bag by a hash of the row. One half chooses the splits, which
maximise the difference of the local effects sum(t * y) / sum(t * t) of outcome and treatment residuals; the other half
alone gives each leaf its moments. The effect of a row is the ratio of the mean moments of its leaves over all trees. Its
standard error is the spread of the bags' own effects; it holds the randomness of single bags too, so intervals are
rather wide than narrow.

All trees grow together, a job per level (``binned_trees``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators import binned_trees as B

# What tasks use is named one by one: a module as a whole would bring along what workers may lack.
from shelfcast.operators.binned_trees import Block, Tree, TreeModel, grown_here, uniform, unpacked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Trees of a bag, and trees grown by one task where a table is one block.
BAG, RUN = 5, 25
#: Distribution of the Poisson number of mean 1 with which a bag weighs a cluster.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))
_BAGS, _HALVES = 7_000_003, 9_000_011


@dataclass
class CausalForest:
    """Trees with the mean moments sum(t * y) and sum(t * t) of each leaf's estimating half."""

    trees: TreeModel
    cross: np.ndarray
    square: np.ndarray
    bag: int

    @property
    def features(self) -> tuple[str, ...]:
        return self.trees.features

    def importances(self) -> np.ndarray:
        return self.trees.importances()

    def effects(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(effect, standard error) of every row; NaN where no leaf has any treatment left."""
        bags = -(-len(self.trees.roots) // self.bag)
        cross, square = np.zeros((bags, len(x))), np.zeros((bags, len(x)))
        for k, root in enumerate(self.trees.roots):
            leaf = self.trees.leaves(x, root)
            cross[k // self.bag] += self.cross[leaf]
            square[k // self.bag] += self.square[leaf]
        ratio = lambda a, b: np.divide(a, b, out=np.full(a.shape, np.nan), where=b > 0)
        effect, each = ratio(cross.sum(0), square.sum(0)), ratio(cross, square)
        known = (~np.isnan(each)).sum(0)
        middle = np.divide(np.nansum(each, 0), known, out=np.zeros(len(x)), where=known > 0)
        spread = np.nansum((each - middle) ** 2, 0)
        return effect, np.sqrt(np.divide(spread, known - 1, out=np.full(len(x), np.nan), where=known > 1))


def _weights(block: Block, tree: int, bag: int, seed: int, estimating: bool) -> np.ndarray:
    """Poisson weight of the row's cluster in the bag, 0 in the half that is not asked for."""
    often = np.searchsorted(POISSON, uniform(block.columns["cluster"].astype(np.int64), _BAGS * (seed + 1) + tree // bag)).astype(float)
    return often * ((block.chance(_HALVES * (seed + 1) + tree) < 0.5) != estimating)


def _moments(block: Block, weight: np.ndarray) -> list[np.ndarray]:
    y, t = block.columns["y"], block.columns["t"]
    return [weight * t * y, weight * t * t, weight]


def _leaf_moments(block: Block, tree: Tree, stats: Sequence[np.ndarray]) -> np.ndarray:
    node = tree.place(block.bins)
    return np.stack([np.bincount(node, s, len(tree.feature)) for s in stats])


def fit(
    residuals: DataFrame, features: Sequence[str], outcome: str, treatment: str, cluster: Sequence[str], row_id: Sequence[str],
    trees: int = 500, depth: int = 12, min_leaf: int = 50, bag: int = BAG, seed: int = 42,
) -> CausalForest:
    rows = residuals.withColumn("_cluster", F.shiftrightunsigned(F.xxhash64(*cluster), 13))
    blocks = B.blocks_of(rows, features, {"y": outcome, "t": treatment, "cluster": "_cluster"}, row_id)
    rule, names = B.Rule(depth, 0.0, float(min_leaf)), blocks.names
    allowed = np.ones(len(features), bool)

    def splitting(block: Block, tree: int) -> list[np.ndarray]:
        return _moments(block, _weights(block, tree, bag, seed, False))

    def estimating(block: Block, tree: int) -> list[np.ndarray]:
        return _moments(block, _weights(block, tree, bag, seed, True))

    if blocks.count == 1:
        runs = -(-trees // RUN)

        def whole(table: pa.Table) -> pa.Table:
            run, block, out = table["run"][0].as_py(), next(unpacked(table, names)), []
            for k in range(run * RUN, min(trees, (run + 1) * RUN)):
                tree = grown_here(block, splitting(block, k), rule, allowed)
                out.append((k, tree, _leaf_moments(block, tree, estimating(block, k))))
            return pa.table({"run": pa.array([run], pa.int32()), "trees": pa.array([cloudpickle.dumps(out)], pa.binary())})

        each = blocks.table.withColumn("run", F.explode(F.array(*[F.lit(k) for k in range(runs)]))).repartition(runs, "run")
        found = each.groupBy("run").applyInArrow(whole, "run int, trees binary").collect()
        made = sorted((x for r in found for x in cloudpickle.loads(bytes(r["trees"]))), key=lambda x: x[0])
        grown, moments = [m[1] for m in made], [m[2] for m in made]
    else:
        by = B.grown(blocks, range(trees), splitting, rule, dict.fromkeys(range(trees), allowed))
        grown = [by[k] for k in range(trees)]
        moments = _estimated(blocks, grown, estimating)
    model = TreeModel.of(blocks.coding, 0.0, grown, [np.zeros(len(t.feature)) for t in grown])
    sums = np.concatenate([np.zeros((B.STATS, 0)), *moments], axis=1)
    mean = lambda s: np.divide(s, sums[2], out=np.zeros(sums.shape[1]), where=sums[2] > 0)
    return CausalForest(model, mean(sums[0]), mean(sums[1]), bag)


def _estimated(blocks: B.Blocks, trees: list[Tree], estimating: B.Statistics) -> list[np.ndarray]:
    """The moments of every node's estimating half: one job, summed by tree."""
    names, state = blocks.names, blocks.table.sparkSession.sparkContext.broadcast(trees)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in unpacked(batch, names):
                for k, tree in enumerate(state.value):
                    sums = _leaf_moments(block, tree, estimating(block, k))
                    total[k] = total[k] + sums if k in total else sums
        yield pa.RecordBatch.from_pydict({"tree": pa.array(total, pa.int32()), "sums": pa.array([s.tobytes() for s in total.values()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_buffer(), float) for s in table["sums"])
        return pa.table({"tree": table["tree"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    found = blocks.table.mapInArrow(partial, "tree int, sums binary").groupBy("tree").applyInArrow(merge, "tree int, sums binary").collect()
    by = {r["tree"]: np.frombuffer(bytes(r["sums"])).reshape(B.STATS, -1) for r in found}
    return [by[k] for k in range(len(trees))]


def with_effects(model: CausalForest, rows: DataFrame, out: str = "Holiday_Uplift", z: float = 1.96) -> DataFrame:
    """``rows`` with the effect, its standard error and the bounds of its interval."""

    def make(x: np.ndarray) -> list[np.ndarray]:
        effect, error = model.effects(x)
        return [effect, error, effect - z * error, effect + z * error]

    return B.with_arrays(rows, model.features, make, [out, "Std_Error", "Lower", "Upper"])
