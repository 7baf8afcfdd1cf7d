"""Random forests of many rows, grown level by level from histograms of binned rows.

Spark ML's forests keep a bootstrap count and a node of every row and tree and touch the statistics of all trees for every row, so their time
goes into memory and their disk into what they persist. Here a row is its bins (one byte a feature), the bootstrap count of a row in a
tree is a hash of both, and its node is walked again at every level, so nothing is kept by row and tree. The rules are Spark ML's: at most BINS
bins of a feature at quantiles of its values, Poisson bootstrap, a random subset of features a node, Gini impurity or variance, leaves that
vote with their shares, two leaves that predict the same made one. Rows of one class with equal bins are one cell with a count; a Poisson count of the cell has the law of the sum over
its rows. Trees of all folds grow together. A task adds up the histograms of a group of trees over all its cells, so its memory depends on
HISTOGRAM_BYTES and not on the rows; a histogram of each tree and task goes to the tree's group, and only splits reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from sievestone.session import cut_lineage, ship

BINS = 32
POINTS = 2048  # weighted quantile points a task keeps of a feature
CHUNK_ROWS = 100_000  # cells a task works on at a time
HISTOGRAM_BYTES = 64 << 20  # histograms a task holds at once
FIELDS = 4  # 16-bit draws in a hash


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(numbers: np.ndarray, *salts: int) -> np.ndarray:
    for salt in salts:
        numbers = _mix(numbers + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return numbers


# --- bins ----------------------------------------------------------------------------------------------------------
def _merged(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with their counts, in at most `most` groups of about equal count that stand at their last value."""
    values, back = np.unique(values, return_inverse=True)
    counts = np.bincount(back, counts, len(values))
    if len(values) <= most:
        return values, counts
    group = ((np.cumsum(counts) - counts / 2) * most / counts.sum()).astype(np.int64)
    last = np.flatnonzero(np.diff(group, append=most + 1))
    return values[last], np.diff(np.cumsum(counts)[last], prepend=0)


def cuts(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most `bins` - 1 thresholds between the sorted values: between all of them, or where the running count passes even shares."""
    middle = (values[1:] + values[:-1]) / 2
    if len(middle) < bins:
        return middle
    running, stride, found = np.cumsum(counts), counts.sum() / bins, []
    target = stride
    for i in range(1, len(values)):
        if abs(running[i - 1] - target) < abs(running[i] - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found[:bins - 1])


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def thresholds(rows: DataFrame, size: int) -> list[np.ndarray]:
    """Thresholds of every feature of `features`, from all rows: each task hands on POINTS points of a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(np.zeros(0), np.zeros(0))] * size
        for batch in batches:
            x = _flat(batch, "f").reshape(-1, size)
            for i in range(size):
                values, counts = np.unique(x[:, i], return_counts=True)
                seen[i] = _merged(np.concatenate([seen[i][0], values]), np.concatenate([seen[i][1], counts]), POINTS)
        for i, (values, counts) in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i)), pa.array(values), pa.array(counts)], names=["feature", "value", "n"])

    ship(rows.sparkSession)
    points = rows.select(vector_to_array("features").alias("f")).mapInArrow(run, "feature long, value double, n double").toArrow()
    feature, value, n = (points.column(c).to_numpy() for c in ("feature", "value", "n"))
    return [cuts(*_merged(value[feature == i], n[feature == i], 1 << 16)) for i in range(size)]


def binned(rows: DataFrame, cut: list[np.ndarray], keep: list[str]) -> DataFrame:
    """The columns `keep` of `rows` and `_x`: one byte a feature, the number of thresholds below its value."""
    size = len(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _flat(batch, "_f").reshape(-1, size)
            bins = np.empty(x.shape, np.uint8)
            for i in range(size):
                bins[:, i] = np.searchsorted(cut[i], x[:, i])
            ends = pa.py_buffer(np.arange(batch.num_rows + 1, dtype=np.int32) * size)
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(bins)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*keep, "_x"])

    ship(rows.sparkSession)
    ready = rows.select(*keep, vector_to_array("features").alias("_f"))
    schema = ready.schema
    schema = StructType(schema.fields[:-1]).add("_x", "binary")
    return ready.mapInArrow(run, schema)


def _bins_of(column: pa.Array, size: int) -> np.ndarray:
    """All bins of a batch, row after row."""
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    return data[start:start + len(column) * size]


# --- bootstrap -----------------------------------------------------------------------------------------------------
_TABLES: dict[int, np.ndarray] = {}


def _table(bit: int) -> np.ndarray:
    """Poisson counts of mean 2 ** `bit` by 16-bit draw: the inverse of their distribution at 65,536 even places."""
    if bit not in _TABLES:
        mean = 1 << bit
        low, high = max(0, mean - 12 * math.isqrt(mean) - 12), mean + 12 * math.isqrt(mean) + 12
        mass = np.exp([i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(low, high)])
        table = low + np.searchsorted(np.cumsum(mass) / mass.sum(), (np.arange(65536) + 0.5) / 65536)
        _TABLES[bit] = table.astype(np.uint8) if bit == 0 else table
    return _TABLES[bit]


class Bootstrap:
    """Poisson counts of rows by tree, from a hash of row and tree: the same whenever they are asked for. A hash holds the draws of FIELDS trees."""

    def __init__(self, hashes: np.ndarray, seed: int):
        self.hashes, self.seed, self.group, self.kept = hashes, seed, -1, {}

    def _draws(self, tree: int, bit: int) -> np.ndarray:
        if tree // FIELDS != self.group:
            self.group, self.kept = tree // FIELDS, {}
        if bit not in self.kept:
            self.kept[bit] = _hash(self.hashes, self.seed, self.group, bit).view(np.uint16).reshape(-1, FIELDS)
        return self.kept[bit][:, tree % FIELDS]

    def counts(self, tree: int, rows: np.ndarray, means: np.ndarray) -> np.ndarray:
        """A count of mean `means` (whole numbers above 0) for each of the `rows`: the sum over the binary digits of the mean."""
        most = int(means.max(initial=0))
        if most <= 1:
            return _table(0)[self._draws(tree, 0)[rows]]
        out = np.zeros(len(rows), np.int64)
        for bit in range(most.bit_length()):
            own = np.flatnonzero(means >> bit & 1)
            out[own] += _table(bit)[self._draws(tree, bit)[rows[own]]]
        return out


# --- trees ---------------------------------------------------------------------------------------------------------
@dataclass
class Forest:
    """Complete binary trees: by level, feature and highest bin to the left of every node; what every last node says. A leaf above the last
    level sends all rows to the left."""

    size: int
    features: list[np.ndarray]
    bins: list[np.ndarray]
    values: np.ndarray | None = None

    def node(self, tree: int, x: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """The node of `level` of each row whose bins start at `at` of `x`."""
        node = np.zeros(len(at), np.int64)
        for k in range(level):
            node = 2 * node + (x[at + self.features[k][tree][node]] > self.bins[k][tree][node])
        return node

    def predict(self, x: np.ndarray, trees: range) -> np.ndarray:
        """Mean of what the trees say of every row: shares of the classes, or one number."""
        at = np.arange(len(x) // self.size) * self.size
        total = np.zeros((len(at), self.values.shape[2]))
        for tree in trees:
            total += self.values[tree][self.node(tree, x, at, len(self.features))]
        return total / len(trees)


def _subsets(seed: int, tree: int, level: int, size: int, take: int) -> np.ndarray:
    """The features each node of the level may split on."""
    return np.sort(np.argsort(np.random.default_rng([seed & 0xFFFFFFFF, tree, level]).random((1 << level, size)), axis=1)[:, :take], axis=1)


@dataclass
class _Plan:
    size: int
    classes: int  # 0 for a number
    folds: int  # 0 for one forest of all rows
    trees: int  # of a fold
    depth: int
    seed: int

    @property
    def take(self) -> int:
        return min(self.size, math.ceil(math.sqrt(self.size)) if self.classes else math.ceil(self.size / 3))

    @property
    def sums(self) -> int:
        return self.classes or 3


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, rows = [], 0
    if rows:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _histograms(plan: _Plan, level: int, group: list[int], grown_of):
    """Sums (of each class, or of count, target and its square) by open node, allowed feature and bin, for every tree of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, opened = grown_of.value
        allowed = {t: _subsets(plan.seed, t, level, plan.size, plan.take)[opened[t]].astype(np.int64) for t in group}
        place = {t: np.where(opened[t], np.cumsum(opened[t]) - 1, -1) for t in group}
        found = {t: np.zeros((plan.sums, len(allowed[t]) * plan.take * BINS) if not plan.classes else len(allowed[t]) * plan.take * BINS * plan.sums) for t in group}
        for batch in _chunks(batches):
            x, y, hashes, counts = _bins_of(batch.column("_x"), plan.size), batch.column("_y").to_numpy(), batch.column("_h").to_numpy().view(np.uint64), _flat(batch, "_n").reshape(batch.num_rows, -1)
            means = [counts[:, 0] - counts[:, 1 + f] for f in range(plan.folds)] if plan.folds else [counts[:, 0]]
            rows = [np.flatnonzero(m) for m in means]
            means = [m[r] for m, r in zip(means, rows)]
            drawn, label = Bootstrap(hashes, plan.seed), y.astype(np.int64) if plan.classes else None
            for t in group:
                many = drawn.counts(t, rows[t // plan.trees], means[t // plan.trees])
                own = np.flatnonzero(many)
                many, own = many[own].astype(np.float64), rows[t // plan.trees][own]
                spot = place[t][grown.node(t, x, own * plan.size, level)]
                if not opened[t].all():
                    inside = np.flatnonzero(spot >= 0)
                    own, spot, many = own[inside], spot[inside], many[inside]
                at, target = own * plan.size, label[own] if plan.classes else y[own]
                for j in range(plan.take):
                    index = (spot * plan.take + j) * BINS + x[at + allowed[t][spot, j]]
                    if plan.classes:
                        found[t] += np.bincount(index * plan.classes + target, many, len(found[t]))
                    else:
                        for k, weight in enumerate((many, many * target, many * target * target)):
                            found[t][k] += np.bincount(index, weight, found[t].shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array([pa.compress(found[t], "zstd", asbytes=True) for t in group], pa.binary())], names=["tree", "sums"])

    return run


def _impurity(sums: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, Gini impurity or variance) along the last axis."""
    n = sums.sum(-1) if classes else sums[..., 0]
    safe = np.maximum(n, 0.5)  # counts are whole; an empty side holds rounding errors only
    return n, 1 - ((sums / safe[..., None]) ** 2).sum(-1) if classes else np.maximum(sums[..., 2] / safe - (sums[..., 1] / safe) ** 2, 0.0)


def best_splits(sums: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place among the allowed features or -1, highest bin to the left, sums of the node, sums to the left) of each node from its sums (node,
    feature, bin, sum)."""
    whole = sums[:, 0].sum(1)
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    n, own = _impurity(whole, classes)
    n_left, of_left = _impurity(left, classes)
    n_right, of_right = _impurity(whole[:, None, None] - left, classes)
    gain = own[:, None, None] - (n_left * of_left + n_right * of_right) / np.maximum(n, 1)[:, None, None]
    gain = np.where((n_left >= 0.5) & (n_right >= 0.5), gain, -1.0).reshape(len(sums), -1)
    best = gain.argmax(1)
    feature, split = best // (BINS - 1), best % (BINS - 1)
    return np.where(gain[np.arange(len(sums)), best] > 0, feature, -1), split, whole, left[np.arange(len(sums)), feature, split]


def _split(plan: _Plan):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(pa.decompress(x.as_py(), size, "zstd"), np.float64) for x, size in zip(table.column("sums"), table.column("size").to_pylist()))
        sums = total.reshape(-1, plan.take, BINS, plan.sums) if plan.classes else np.moveaxis(total.reshape(3, -1, plan.take, BINS), 0, -1)
        parts = [np.ascontiguousarray(p, np.float64).tobytes() for p in best_splits(sums, plan.classes)]
        return pa.table([table.column("tree").slice(0, 1), *[pa.array([p], pa.binary()) for p in parts]], names=["tree", "feature", "bin", "whole", "left"])

    return run


def grow(cells: DataFrame, plan: _Plan) -> Forest:
    """The trees of all folds on `cells` (_x, _y, _h, _n: rows in all and by fold)."""
    spark = cells.sparkSession
    total = max(1, plan.folds) * plan.trees
    forest, opened = Forest(plan.size, [], []), np.ones((total, 1), bool)
    says, nodes = np.zeros((total, 1, plan.sums)), []
    cells = cells.coalesce(max(1, spark.sparkContext.defaultParallelism))
    ship(spark)
    for level in range(plan.depth):
        features, bins = np.zeros((total, 1 << level), np.int64), np.full((total, 1 << level), 255, np.uint8)
        following, after = np.zeros((total, 2 << level), bool), np.zeros((total, 2 << level, plan.sums))
        after[:, ::2] = says
        left_open = np.flatnonzero(opened.any(1))
        room = max(1, HISTOGRAM_BYTES // (max(1, int(opened.sum(1).max())) * plan.take * BINS * plan.sums * 8))
        grown_of = spark.sparkContext.broadcast((forest, opened))
        for at in range(0, len(left_open), room):
            group = left_open[at:at + room].tolist()
            size = {t: int(opened[t].sum()) * plan.take * BINS * plan.sums * 8 for t in group}
            sums = cells.mapInArrow(_histograms(plan, level, group, grown_of), "tree long, sums binary")
            sizes = F.element_at(F.create_map(*[F.lit(v) for t in group for v in (t, size[t])]), F.col("tree")) if len(set(size.values())) > 1 else F.lit(size[group[0]])
            found = sums.withColumn("size", sizes.cast("long")).groupBy("tree").applyInArrow(_split(plan), "tree long, feature binary, bin binary, whole binary, left binary")
            for row in found.collect():
                t, asked = row["tree"], np.flatnonzero(opened[row["tree"]])
                feature, split = (np.frombuffer(row[c]).astype(np.int64) for c in ("feature", "bin"))
                whole, left = (np.frombuffer(row[c]).reshape(-1, plan.sums) for c in ("whole", "left"))
                if level == 0:
                    says[t, 0] = after[t, 0] = whole[0]
                yes = feature >= 0
                allowed = _subsets(plan.seed, t, level, plan.size, plan.take)[asked]
                features[t, asked[yes]] = allowed[yes, feature[yes]]
                bins[t, asked[yes]] = split[yes]
                for child, sums_of in ((2 * asked[yes], left[yes]), (2 * asked[yes] + 1, whole[yes] - left[yes])):
                    after[t, child] = sums_of
                    following[t, child] = _impurity(sums_of, plan.classes)[1] > 1e-16
        forest.features.append(features)
        forest.bins.append(bins)
        nodes.append(says)
        opened, says = following, after
        grown_of.unpersist()
    nodes.append(says)
    return _pruned(forest, nodes, plan.classes)


def _said(sums: np.ndarray, classes: int) -> np.ndarray:
    """Shares of the classes, or the mean."""
    n = np.maximum(sums.sum(-1) if classes else sums[..., 0], 1e-300)[..., None]
    return sums / n if classes else sums[..., 1:2] / n


def _pruned(forest: Forest, nodes: list[np.ndarray], classes: int) -> Forest:
    """The forest with its values: two leaves that predict the same are one, from the last level up. `nodes`: sums of all nodes by level."""
    predicted = lambda sums: sums.argmax(-1) if classes else _said(sums, 0)[..., 0]
    depth = len(forest.features)
    forest.values = _said(nodes[depth], classes)
    leaf, ahead = np.ones(nodes[depth].shape[:2], bool), predicted(nodes[depth])
    for level in range(depth - 1, -1, -1):
        divided = forest.bins[level] < BINS
        merged = divided & leaf[:, ::2] & leaf[:, 1::2] & (ahead[:, ::2] == ahead[:, 1::2])
        forest.bins[level][merged] = 255
        tree, node = np.nonzero(merged)
        forest.values[tree, node << depth - level] = _said(nodes[level][tree, node], classes)
        leaf, ahead = ~divided | merged, predicted(nodes[level])
    return forest


# --- what the models module calls ----------------------------------------------------------------------------------
def _cells(rows: DataFrame, plan: _Plan, fold: str | None) -> DataFrame:
    """`rows` (_x, _y, fold) as cells: equal bins of one class are one; rows of a number stay apart."""
    one = [F.lit(1).cast("long"), *[(F.col(fold) == f).cast("long") for f in range(plan.folds)]]
    if plan.classes:
        names = [f"n{i}" for i in range(len(one))]
        cells = rows.groupBy("_x", "_y").agg(*[F.sum(c).alias(n) for c, n in zip(one, names)]).select("_x", "_y", F.array(*names).alias("_n"))
    else:
        cells = rows.select("_x", "_y", F.array(*one).alias("_n"))
    return cut_lineage(cells.withColumn("_h", F.monotonically_increasing_id()))


def _fit(rows: DataFrame, estimator, folds: int, fold: str | None):
    """(plan, thresholds, forest, binned rows with all columns but the features)."""
    first = rows.select(F.size(vector_to_array("features")).alias("n")).first()
    cut = thresholds(rows, first["n"])
    classes = 0
    if isinstance(estimator, RandomForestClassifier):
        classes = max(2, int(rows.agg(F.max("_y")).first()[0]) + 1)
    plan = _Plan(first["n"], classes, folds, estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed())
    ready = cut_lineage(binned(rows, cut, [c for c in rows.columns if c != "features"]))
    return plan, cut, grow(_cells(ready, plan, fold), plan), ready


def _scored(rows: DataFrame, plan: _Plan, forest: Forest, fold: str | None, keep: list[str]) -> DataFrame:
    """`keep` of binned rows, with `prediction` and, of classes, `probability`; rows of a fold are scored by the trees that never saw them."""
    own = [c for c in rows.columns if c in keep]
    forest_of = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = forest_of.value
        for batch in _chunks(batches):
            x = _bins_of(batch.column("_x"), plan.size)
            if fold is None:
                said = grown.predict(x, range(plan.trees))
            else:
                said, of = np.zeros((batch.num_rows, grown.values.shape[2])), batch.column("_fold").to_numpy()
                for f in range(plan.folds):
                    at = np.flatnonzero(of == f)
                    said[at] = grown.predict(x.reshape(-1, plan.size)[at].reshape(-1), range(f * plan.trees, (f + 1) * plan.trees))
            prediction = said.argmax(1).astype(np.float64) if plan.classes else said[:, 0]
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * said.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(own)], pa.array(prediction), pa.ListArray.from_arrays(ends, pa.array(said.reshape(-1)))], names=[*own, "prediction", "probability"])

    chosen = rows.select(*own, "_x", *([F.col(fold).cast("long").alias("_fold")] if fold else []))
    schema = StructType(chosen.schema.fields[:len(own)]).add("prediction", "double").add("probability", ArrayType(DoubleType()))
    scored = chosen.mapInArrow(run, schema)
    return scored.withColumn("probability", array_to_vector("probability")).select(*keep) if "probability" in keep else scored.select(*keep)


def out_of_fold(rows: DataFrame, estimator, folds: int, keep: list[str]) -> DataFrame:
    """Every row of `rows` (features, _y, fold) scored by the forest of the other folds."""
    plan, _, forest, ready = _fit(rows, estimator, folds, "fold")
    return _scored(ready, plan, forest, "fold", keep)


def fit_and_predict(rows: DataFrame, estimator, others: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` of `others` (features), with `prediction`, by the forest of `rows` (features, _y)."""
    plan, cut, forest, _ = _fit(rows.select("_y", "features"), estimator, 0, None)
    return _scored(binned(others, cut, keep), plan, forest, None, [*keep, "prediction"])
