"""A random forest for many rows: all trees grow a level at a time from counts per node and bin.

It is the forest Spark ML grows (bootstrap by Poisson counts, a random subset of the
features per node, at most 32 bins per feature, Gini gain, least rows per leaf,
probabilities averaged over the trees), laid out for many rows and trees.  Rows are
kept as bytes, one a feature.  A level is one job: tasks count their rows tree by
tree, so that the counts of one tree stay in the cache, and the counts of some
hundred nodes are summed and split by one task.  Nothing is kept per row and tree:
a row's bootstrap counts follow from its block, and it walks to its node on bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgrid.sources.scratch import spread

BINS = 32
SPLIT_SAMPLE = 10_000  # rows from which the borders of the bins are taken, as in Spark ML
BLOCK_ROWS = 16_384
TASK_ROWS = 500_000
NODES_AT_ONCE = 256  # of a tree, summed and split by one task
PENDING = 1 << 17  # rows gathered before they are counted

# Bootstrap counts (Poisson with mean 1) of 65,536 equally likely numbers.
_POISSON = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])), (np.arange(65536) + 0.5) / 65536).astype("uint8")


@dataclass
class Tree:
    """Nodes by number; children are neighbours.  A leaf leads to itself."""

    feature: np.ndarray
    cut: np.ndarray  # a row with a bin above it goes right
    left: np.ndarray
    counts: np.ndarray  # bootstrap rows of either class
    gain: np.ndarray  # of a node's split, times its weighted rows
    open: np.ndarray  # numbers of the nodes to be split next
    depth: int = 0  # of a finished tree

    def slots(self) -> np.ndarray:
        out = np.full(len(self.left), -1, "int32")
        out[self.open] = np.arange(len(self.open))
        return out

    def merged(self, weights: np.ndarray) -> Tree:
        """Two leaves that say the same class become one, from the bottom up, as Spark ML does; nodes that no row reaches go."""
        left, numbers = self.left.copy(), np.arange(len(self.left))
        says = (self.counts * weights).argmax(1)
        while True:
            leaf = left == numbers
            inner = numbers[~leaf]
            same = inner[leaf[left[inner]] & leaf[left[inner] + 1] & (says[left[inner]] == says[left[inner] + 1])]
            if not len(same):
                break
            left[same] = same
        keep = [np.zeros(1, "int64")]
        while len(inner := keep[-1][left[keep[-1]] != keep[-1]]):
            keep.append(np.stack([left[inner], left[inner] + 1], axis=1).reshape(-1).astype("int64"))
        kept = np.concatenate(keep)  # level by level, children as neighbours
        renamed = np.zeros(len(left), "int32")
        renamed[kept] = np.arange(len(kept))
        ends = left[kept] == kept
        return Tree(np.where(ends, 0, self.feature[kept]).astype("int16"), np.where(ends, 255, self.cut[kept]).astype("uint8"),
                    renamed[left[kept]], self.counts[kept], np.where(ends, 0.0, self.gain[kept]), self.open[:0], len(keep) - 1)


def _subsets(seed: int, level: int, tree: int, nodes: int, features: int, size: int) -> np.ndarray:
    """The features each open node may split on."""
    chance = np.random.default_rng([seed, 1, level, tree]).random((nodes, features), "float32")
    return np.argpartition(chance, size - 1, axis=1)[:, :size] if size < features else np.tile(np.arange(features), (nodes, 1))


def _walked(bins: np.ndarray, base: np.ndarray, tree, steps: int) -> np.ndarray:
    """Node of each row; ``base`` is where a row's bytes start."""
    feature, cut, left = tree
    node = np.zeros(len(base), "int64")
    for _ in range(steps):
        node = left.take(node) + (bins.take(base + feature.take(node)) > cut.take(node))
    return node


def _binned(values: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(b, values[:, i]).astype("uint8") for i, b in enumerate(borders)], axis=1)


def _borders(values: np.ndarray) -> np.ndarray:
    """At most BINS - 1 borders, halfway between values, that part the sampled rows evenly."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2
    if len(between) < BINS:
        return between
    through = np.cumsum(counts)[:-1]
    wanted = np.arange(1, BINS) * (len(values) / BINS)
    after = np.clip(np.searchsorted(through, wanted), 1, len(through) - 1)
    nearest = np.where(wanted - through[after - 1] <= through[after] - wanted, after - 1, after)
    return between[np.unique(nearest)]


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class HistogramForest:
    """Estimator over (features, label, weight), the label 0 or 1 and the weight the same for all rows of a class."""

    trees: int
    max_depth: int
    least_rows: int
    seed: int

    def fit(self, rows: DataFrame) -> HistogramForestModel:
        classes = {int(r["label"]): (r["rows"], r["weight"]) for r in rows.groupBy("label").agg(
            F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight")).collect()}
        total = sum(size for size, _ in classes.values())
        weights = np.array([classes[c][1] if c in classes else 1.0 for c in (0, 1)])
        taken = rows.select("features")
        if total > SPLIT_SAMPLE:
            taken = taken.sample(False, SPLIT_SAMPLE / total, self.seed)
        sampled = np.array([r["features"].toArray() for r in taken.collect()])
        borders = [_borders(sampled[:, i]) for i in range(sampled.shape[1])]
        model = HistogramForestModel(borders, weights, [Tree(
            np.zeros(1, "int16"), np.full(1, 255, "uint8"), np.zeros(1, "int32"), np.zeros((1, 2), "int64"),
            np.zeros(1), np.zeros(1, "int64")) for _ in range(self.trees)])
        kept = _packed(spread(rows, TASK_ROWS), borders).persist()
        try:
            for level in range(self.max_depth):
                if not any(len(t.open) for t in model.trees):
                    break
                self._grow(kept, model, level)
        finally:
            kept.unpersist()
        model.trees = [tree.merged(weights) for tree in model.trees]
        gains = np.array([np.bincount(t.feature, t.gain, len(borders)) for t in model.trees])
        sums = gains.sum(1, keepdims=True)
        shares = np.divide(gains, sums, out=np.zeros_like(gains), where=sums > 0).sum(0)
        model.importances = shares / shares.sum() if shares.sum() else shares
        return model

    def _grow(self, kept: DataFrame, model: HistogramForestModel, level: int) -> None:
        """Split all open nodes of all trees."""
        found = _counted(kept, model, level, self.seed).groupBy("tree", "first").applyInArrow(
            _splitter(model, level, self.seed, self.least_rows), "tree int, first int, splits binary")
        splits: dict[int, list] = {}
        for r in found.collect():  # the nodes of the model's next level
            splits.setdefault(r["tree"], []).append((r["first"], np.frombuffer(r["splits"]).reshape(-1, 7)))
        for number, parts in splits.items():
            best = np.concatenate([part for _, part in sorted(parts, key=lambda p: p[0])])
            tree = model.trees[number]
            tree.counts[tree.open] = best[:, 5:7] + best[:, 3:5]
            splitting = np.flatnonzero(best[:, 0] > 0)
            split, nodes = best[splitting], tree.open[splitting]
            first = len(tree.left)
            tree.feature[nodes], tree.cut[nodes], tree.gain[nodes] = split[:, 1], split[:, 2], split[:, 0]
            tree.left[nodes] = first + 2 * np.arange(len(nodes))
            counts = split[:, 3:7].reshape(-1, 2).astype("int64")
            new = np.arange(first, first + len(counts))
            tree.feature = np.append(tree.feature, np.zeros(len(new), "int16"))
            tree.cut = np.append(tree.cut, np.full(len(new), 255, "uint8"))
            tree.left = np.append(tree.left, new.astype("int32"))
            tree.counts = np.concatenate([tree.counts, counts])
            tree.gain = np.append(tree.gain, np.zeros(len(new)))
            # pure nodes and those too small for two leaves are leaves
            tree.open = new[(counts.min(1) > 0) & (counts.sum(1) >= 2 * self.least_rows)] if level + 1 < self.max_depth else new[:0]


def _packed(rows: DataFrame, borders: list[np.ndarray]) -> DataFrame:
    """Rows by the block: a byte per feature with its bin, and a byte with the class."""

    def run(batches):
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            bins = _binned(_values(batch.column("point")), borders)
            classes = batch.column("label").to_numpy(zero_copy_only=False).astype("uint8")
            for first in range(0, len(bins), BLOCK_ROWS):
                some = slice(first, first + BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                    pa.array([bins[some].tobytes()], pa.binary()), pa.array([classes[some].tobytes()], pa.binary()),
                ], ["part", "block", "bins", "classes"])
                block += 1

    return rows.select(vector_to_array("features").alias("point"), "label").mapInArrow(
        run, "part int, block int, bins binary, classes binary")


def _starts(features: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Where the counts of each node's feature start, two per bin, and last where they end."""
    return np.append(0, np.cumsum(2 * widths[features]))


def _counted(kept: DataFrame, model: HistogramForestModel, level: int, seed: int) -> DataFrame:
    """Bootstrap rows per tree, open node, feature of its subset, bin and class: a row per task and some nodes."""
    widths = np.array([len(b) + 1 for b in model.borders])
    size = model.subset_size
    shipped = [(i, t.feature, t.cut, t.left, t.slots(), len(t.open)) for i, t in enumerate(model.trees) if len(t.open)]

    def run(batches):
        blocks = [(r["part"], r["block"], np.frombuffer(r["bins"], "uint8"), np.frombuffer(r["classes"], "uint8"))
                  for batch in batches for r in batch.to_pylist()]
        if not blocks:
            return
        for number, feature, cut, left, slots, nodes in shipped:
            tree = feature.astype("int64"), cut, left.astype("int64")
            features = np.ascontiguousarray(_subsets(seed, level, number, nodes, len(widths), size).T)
            starts = [_starts(f, widths) for f in features]
            counts = [np.zeros(s[-1]) for s in starts]
            places, times, pending = [[] for _ in starts], [], 0

            def count():
                weights = np.concatenate(times, dtype="float64")
                for s, found in enumerate(places):  # the counts of one feature of the subsets stay in the cache
                    counts[s] += np.bincount(np.concatenate(found), weights, len(counts[s]))
                    found.clear()
                times.clear()

            for part, block, bins, classes in blocks:
                chance = np.random.Generator(np.random.SFC64([seed, 2, number, part, block])).bytes(2 * len(classes))
                drawn = _POISSON.take(np.frombuffer(chance, "uint16"))
                row = np.flatnonzero(drawn)
                base = row * len(widths)
                slot = slots.take(_walked(bins, base, tree, level))
                if slot.size and slot.min() < 0:
                    here = np.flatnonzero(slot >= 0)
                    row, base, slot = row.take(here), base.take(here), slot.take(here)
                own = classes.take(row)
                for s in range(size):
                    place = bins.take(base + features[s].take(slot)).astype("int64")
                    place *= 2
                    place += own
                    place += starts[s].take(slot)
                    places[s].append(place)
                times.append(drawn.take(row))
                pending += len(row)
                if pending >= max(PENDING, len(counts[0])):
                    count()
                    pending = 0
            if times:
                count()
            firsts = range(0, nodes, NODES_AT_ONCE)
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * len(firsts), pa.int32()), pa.array(firsts, pa.int32()),
                pa.array([np.concatenate([c[s[i]:s[min(i + NODES_AT_ONCE, nodes)]] for c, s in zip(counts, starts)]).astype("uint32").tobytes()
                          for i in firsts], pa.binary()),
            ], ["tree", "first", "counts"])

    return kept.mapInArrow(run, "tree int, first int, counts binary")


def _splitter(model: HistogramForestModel, level: int, seed: int, least_rows: int):
    """Best split of each node from the counts of all tasks: (gain, feature, cut, rows left of either class, rows right of either)."""
    widths = np.array([len(b) + 1 for b in model.borders])
    weights, size = model.weights, model.subset_size
    open_nodes = [len(t.open) for t in model.trees]
    most = int(widths.max())

    def gini(counts):
        weighted = counts * weights
        total = weighted.sum(-1)
        return total, 1 - np.divide((weighted * weighted).sum(-1), total * total, out=np.ones_like(total), where=total > 0)

    def run(table: pa.Table) -> pa.Table:
        number, first = table["tree"][0].as_py(), table["first"][0].as_py()
        features = _subsets(seed, level, number, open_nodes[number], len(widths), size)[first:first + NODES_AT_ONCE]
        starts = _starts(features.T.ravel(), widths)
        counts = np.zeros(starts[-1], "int64")
        for one in table["counts"]:
            counts += np.frombuffer(one.as_buffer(), "uint32")
        even = np.zeros((size, len(features), most, 2), "int64")  # as many bins for every feature
        even.reshape(-1)[np.repeat(np.arange(features.size) * 2 * most - starts[:-1], np.diff(starts)) + np.arange(len(counts))] = counts
        even = even.transpose(1, 0, 2, 3)
        total = even[:, 0].sum(1)
        left = even.cumsum(2)
        right = total[:, None, None] - left
        (weight, impurity), (on_left, left_gini), (on_right, right_gini) = gini(total), gini(left), gini(right)
        gain = impurity[:, None, None] - (on_left * left_gini + on_right * right_gini) / np.maximum(weight, 1e-300)[:, None, None]
        gain[(left.sum(-1) < least_rows) | (right.sum(-1) < least_rows)] = -1
        best = gain.reshape(len(features), -1).argmax(1)
        node, which, cut = np.arange(len(features)), best // most, best % most
        splits = np.column_stack([
            gain[node, which, cut] * weight, features[node, which], cut, left[node, which, cut], right[node, which, cut]]).astype("float64")
        return pa.table({"tree": pa.array([number], pa.int32()), "first": pa.array([first], pa.int32()),
                         "splits": pa.array([np.ascontiguousarray(splits).tobytes()], pa.binary())})

    return run


@dataclass
class HistogramForestModel:
    borders: list[np.ndarray]
    weights: np.ndarray
    trees: list[Tree]
    importances: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def subset_size(self) -> int:
        return int(np.ceil(np.sqrt(len(self.borders))))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``: the mean over the trees of the weighted share of either class in a row's leaf."""
        borders = self.borders
        shipped = []
        for t in self.trees:
            weighted = t.counts * self.weights
            shipped.append((t.feature, t.cut, t.left, weighted[:, 1] / np.maximum(weighted.sum(1), 1e-300), t.depth))

        def positive(column: pa.Array) -> pa.Array:
            bins = _binned(_values(column), borders)
            base = np.arange(len(bins)) * len(borders)
            total, flat = np.zeros(len(bins)), bins.reshape(-1)
            for feature, cut, left, share, depth in shipped:
                total += share.take(_walked(flat, base, (feature.astype("int64"), cut, left.astype("int64")), depth))
            return pa.array(total / len(shipped))

        share = F.arrow_udf(positive, "double")(vector_to_array("features"))
        return df.withColumn("_positive", share).withColumn(
            "probability", array_to_vector(F.array(1 - F.col("_positive"), F.col("_positive")))).drop("_positive")
