"""Second-order boosted trees on histograms, for many models at once.

Features are cut into at most 256 bins once per training table, at approximate quantiles. A level of all
trees is one Spark job: tasks add up gradients and hessians by (model, node, feature, bin), the sums meet
by model, and one best split a node reaches the driver. All models (the folds of a walk-forward run, the
parts of a calibration) grow in step, so a run takes as many jobs as its deepest model.

The rows live in an RDD of NumPy blocks: the work is imperative within a block, and a job without a query
plan is cheap enough to be repeated thousands of times. The first level of a tree moves the margins past the
tree before it and keeps them, so no tree is walked twice; they are checkpointed every few trees, and a lost
executor repeats at most those. Sums are of integers, so that they do not depend on the order of tasks.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.scale import checkpoint_folder

YEAR, ROW, LABEL = "filing_year", "row_id", "label"
BINS = 256
BLOCK_ROWS = 1 << 16
# Trees between two checkpoints of the margins.
REBASE = 10
# A task sums up this many blocks at most, and an eighth of one at least; between these, each core has one task.
TASK_BLOCKS = 16
# Gradients and hessians are counted in units of 1 / SCALE; a block's sums stay exact in doubles.
SCALE = float(1 << 30)
# A split that gains less is numerical noise.
LEAST_GAIN = 1e-6

# Defaults of the boosted trees.
TREE_DEFAULTS = {
    "n_estimators": 400,
    "learning_rate": 0.05,
    "max_depth": 6,
    "min_child_weight": 5,
    "subsample": 0.80,
    "colsample_bytree": 0.80,
    "gamma": 0.0,
    "reg_alpha": 0.0,
    "reg_lambda": 1.0,
    "scale_pos_weight": 1.0,
}
# Parameters that are shares of rows or columns, and those that may be 0.
SHARES = {"subsample", "colsample_bytree"}
PENALTIES = {"gamma", "reg_alpha", "reg_lambda"}


def validate_parameters(parameters: dict) -> dict:
    """Check every tree parameter against its range, and name all that lie outside."""
    outside = []
    for name in TREE_DEFAULTS:
        value, highest = parameters[name], 1.0 if name in SHARES else math.inf
        low = value >= 0 if name in PENALTIES else value > 0
        if not (low and value <= highest):
            outside.append(f"{name} = {value}")
    if outside:
        raise ValueError("tree parameters out of range: " + ", ".join(outside))
    return parameters


@dataclass(frozen=True)
class Tree:
    """Nodes as in a heap: the children of node i are 2i + 1 and 2i + 2. A leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray  # rows whose bin is at most this go left
    threshold: np.ndarray  # the same for the value itself
    value: np.ndarray
    cover: np.ndarray  # sum of hessians
    gain: np.ndarray


@dataclass(frozen=True)
class Booster:
    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    base: float
    trees: tuple[Tree, ...]

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Log-odds of rows given by feature values."""
        total = np.full(len(values), self.base)
        columns = np.ascontiguousarray(values.T)
        for tree in self.trees:
            total += tree.value.take(descend(tree, columns, tree.threshold))
        return total


@dataclass(frozen=True)
class Fit:
    """One model to fit: on rows of years before `before` (all rows, if None)."""

    before: int | None = None
    parameters: dict = field(default_factory=dict)
    seed: int = 42

    @property
    def settings(self) -> dict:
        return validate_parameters({**TREE_DEFAULTS, **self.parameters})


def descend(tree: Tree, columns: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each row; `columns` holds bins or values by feature, `cuts` the tree's cuts of that kind."""
    n = columns.shape[1]
    node, rows, flat = np.zeros(n, np.int64), np.arange(n), np.ascontiguousarray(columns).reshape(-1)
    inner = tree.feature >= 0
    # A row at a leaf stays there: nothing lies to the right of its cut.
    heap = np.arange(len(inner))
    start, following = np.where(inner, tree.feature, 0) * n, np.where(inner, 2 * heap + 1, heap)
    cuts = np.where(inner, cuts, np.inf if columns.dtype.kind == "f" else np.iinfo(columns.dtype).max)
    cuts = cuts.astype(columns.dtype)
    for _ in range(int(np.flatnonzero(inner).max(initial=-1) + 1).bit_length()):
        right = flat.take(start.take(node) + rows) > cuts.take(node)
        node = following.take(node)
        node += right
    return node


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


# Binning


def quantile_cuts(table: DataFrame, features, before: int | None, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last, per feature: approximate quantiles of the training rows."""
    train = table if before is None else table.where(F.col(YEAR) < before)
    shares = [k / bins for k in range(1, bins)]
    row = train.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 50 * bins).alias(f"c{k}") for k, f in enumerate(features)]).first()
    return [np.unique(np.array(cuts or [], np.float64)) for cuts in row]


def _binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for k, own in enumerate(cuts):
        out[:, k] = np.searchsorted(own, values[:, k], side="left")
    return out


def feature_matrix(batch: pa.RecordBatch, features) -> np.ndarray:
    columns = [batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features]
    return np.column_stack(columns) if columns else np.empty((batch.num_rows, 0))


def _pack(features, cut_sets: dict):
    """Arrow batches as rows of packed columns ordered by year, one set of bins for each training table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                year = part.column(YEAR).cast(pa.int64()).to_numpy(zero_copy_only=False)
                order = np.argsort(year, kind="stable")
                values = feature_matrix(part, features)[order]
                label = part.column(LABEL).cast(pa.float64()).to_numpy(zero_copy_only=False)
                row = {
                    "label": label[order],
                    "year": year[order],
                    "hash": part.column("_hash").to_numpy(zero_copy_only=False)[order],
                    "bins": np.concatenate([_binned(values, cuts).T.reshape(-1) for cuts in cut_sets.values()]),
                }
                yield pa.RecordBatch.from_pydict({n: pa.array([x.tobytes()], pa.binary()) for n, x in row.items()})

    return run


@dataclass
class _Block:
    label: np.ndarray
    hash: np.ndarray
    bins: dict  # by training table: features, and its rows, which are the first ones of the block
    margin: dict  # by model, of all trees that are done


def _unpack(row, befores: list, width: int, models: list) -> _Block:
    label = np.frombuffer(row["label"], np.float64)
    year = np.frombuffer(row["year"], np.int64)
    n = len(label)
    bins = np.frombuffer(row["bins"], np.uint8).reshape(len(befores), width, n)
    # Only training rows: others never count.
    rows = {b: n if b is None else int(np.searchsorted(year, b)) for b in befores}
    own = {b: np.ascontiguousarray(bins[k][:, : rows[b]]) for k, b in enumerate(befores)}
    margin = {m: np.full(rows[b], base) for m, (b, base) in enumerate(models)}
    return _Block(label, np.frombuffer(row["hash"], np.int64), own, margin)


# Growing


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) of row hashes, other ones for each seed."""
    x = values.astype(np.uint64) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


@dataclass
class _Growing:
    """A tree under construction: split nodes so far, and the nodes of the current level."""

    model: int
    before: int | None
    seed: int
    columns: list[int]
    subsample: float
    positive_weight: float
    tree: Tree
    active: list[int]
    widths: list[int]  # bins of each drawn column


def _level(growing: list[_Growing], blocks) -> Iterator[tuple[int, np.ndarray]]:
    """Sums of gradients and hessians of a task: model, [2, nodes, columns, bins] as integers."""
    sums: dict[int, np.ndarray] = {}
    with np.errstate(over="ignore"):
        for block in blocks:
            for g in growing:
                bins, margin = block.bins[g.before], block.margin[g.model]
                n = len(margin)
                if not n:
                    continue
                place = np.full(len(g.tree.feature), -1)
                place[g.active] = np.arange(len(g.active))
                at = place.take(descend(g.tree, bins, g.tree.cut))
                used = at >= 0
                if g.subsample < 1:
                    used &= _mixed(block.hash[:n], g.seed) < g.subsample
                used = np.flatnonzero(used)
                wide = max(g.widths)
                at, positive, p = at.take(used) * wide, block.label[:n].take(used), sigmoid(margin.take(used))
                weight = np.where(positive == 1, g.positive_weight, 1.0)
                gradient = np.rint(weight * (p - positive) * SCALE)
                hessian = np.rint(weight * p * (1 - p) * SCALE)
                out = sums.get(g.model)
                if out is None:
                    out = sums[g.model] = np.zeros((2, len(g.active), len(g.columns), wide), np.int64)
                for k, column in enumerate(g.columns):
                    cell = at + bins[column].take(used)
                    for which, values in enumerate((gradient, hessian)):
                        total = np.bincount(cell, values, len(g.active) * wide)
                        out[which, :, k, :] += total.astype(np.int64).reshape(-1, wide)
    yield from sums.items()


def shrink(gradient, alpha: float):
    """Soft threshold of a sum of gradients."""
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0.0)


def best_splits(sums: np.ndarray, parameters: dict) -> list[tuple]:
    """Per node: column, bin and gain of the best split (column -1 for none), G, H, and G, H to its left.

    Ties go to the first column, then to the first bin.
    """
    alpha, lam, least = parameters["reg_alpha"], parameters["reg_lambda"], parameters["min_child_weight"]
    gradient, hessian = sums[0] / SCALE, sums[1] / SCALE
    total_g, total_h = gradient[:, 0].sum(1), hessian[:, 0].sum(1)
    left_g, left_h = np.cumsum(sums[0], axis=2) / SCALE, np.cumsum(sums[1], axis=2) / SCALE
    right_g, right_h = total_g[:, None, None] - left_g, total_h[:, None, None] - left_h

    def score(g, h):
        return shrink(g, alpha) ** 2 / np.maximum(h + lam, 1e-12)

    gain = score(left_g, left_h) + score(right_g, right_h) - score(total_g, total_h)[:, None, None]
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    # Sums that differ by rounding alone count as ties.
    best = np.argmax(flat >= np.max(flat, axis=1, keepdims=True) - 1e-9, axis=1)
    out = []
    for k, b in enumerate(best.tolist()):
        column, cut = divmod(b, gain.shape[2])
        found = flat[k, b] > LEAST_GAIN
        out.append(
            (column if found else -1, cut, float(flat[k, b]), float(total_g[k]), float(total_h[k]),
             float(left_g[k, column, cut]), float(left_h[k, column, cut]))
        )
    return out


def _empty_tree(depth: int) -> Tree:
    n = (1 << (depth + 1)) - 1
    return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n))


def finish(tree: Tree, gradients: np.ndarray, parameters: dict) -> Tree:
    """Cut off splits that gain less than `gamma` from the leaves upward, and give leaves their values."""
    for node in reversed(range(len(tree.feature) // 2)):
        children = (2 * node + 1, 2 * node + 2)
        if tree.feature[node] >= 0 and all(tree.feature[c] < 0 for c in children) and tree.gain[node] < parameters["gamma"]:
            tree.feature[node] = -1
    reach = {0}
    for node in range(len(tree.feature) // 2):
        if node in reach and tree.feature[node] >= 0:
            reach |= {2 * node + 1, 2 * node + 2}
    for node in reach:
        if tree.feature[node] < 0:
            weight = -shrink(gradients[node], parameters["reg_alpha"]) / max(tree.cover[node] + parameters["reg_lambda"], 1e-12)
            tree.value[node] = parameters["learning_rate"] * weight
    return tree


def _histograms(blocks: RDD, growing: list[_Growing], settings: list[dict]) -> dict[int, list[tuple]]:
    """The best splits of all open nodes, by model."""
    sums = blocks.mapPartitions(partial(_level, growing))
    own = {g.model: settings[g.model] for g in growing}
    if blocks.getNumPartitions() > 1:
        sums = sums.reduceByKey(np.add, min(len(growing), blocks.getNumPartitions()))
    return dict(sums.map(lambda item: (item[0], best_splits(item[1], own[item[0]]))).collect())


def _moved(done: dict[int, tuple], block: _Block) -> _Block:
    """The block with margins moved past one more tree of each model."""
    margin = dict(block.margin)
    for model, (before, tree) in done.items():
        margin[model] = margin[model] + tree.value.take(descend(tree, block.bins[before], tree.cut))
    return _Block(block.label, block.hash, block.bins, margin)


def _kept(blocks: RDD) -> RDD:
    blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.checkpoint()
    blocks.count()
    return blocks


def _grow(blocks: RDD, open_trees: list[_Growing], settings: list[dict], thresholds: list) -> None:
    """Grow one tree of each model, all level by level."""
    gradients = {g.model: np.zeros(len(g.tree.feature)) for g in open_trees}
    depth = {g.model: int(settings[g.model]["max_depth"]) for g in open_trees}
    current = open_trees
    level = 0
    while current:
        found = _histograms(blocks, current, settings)
        following = []
        for g in current:
            # A task has no sums of a model whose rows were all left out of the sample.
            splits = found.get(g.model, [])
            opened = []
            for node, (column, cut, gain, total_g, total_h, left_g, left_h) in zip(g.active, splits):
                gradients[g.model][node], g.tree.cover[node] = total_g, total_h
                if column < 0 or level >= depth[g.model]:
                    continue
                feature = g.columns[column]
                g.tree.feature[node], g.tree.cut[node], g.tree.gain[node] = feature, cut, gain
                g.tree.threshold[node] = thresholds[g.model][feature][cut]
                for child, g_sum, h_sum in (
                    (2 * node + 1, left_g, left_h), (2 * node + 2, total_g - left_g, total_h - left_h),
                ):
                    gradients[g.model][child], g.tree.cover[child] = g_sum, h_sum
                    # A node that could not be split again is a leaf with known sums.
                    if level + 1 < depth[g.model] and h_sum >= 2 * settings[g.model]["min_child_weight"]:
                        opened.append(child)
            if opened:
                g.active = opened
                following.append(g)
        current, level = following, level + 1
    for g in open_trees:
        finish(g.tree, gradients[g.model], settings[g.model])


def task_number(spark: SparkSession, rows: int) -> int:
    """Tasks of a pass over the rows: one a core, unless they are too few or too many for that."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(cores, -(-8 * rows // BLOCK_ROWS)), -(-rows // (TASK_BLOCKS * BLOCK_ROWS)))


def fit_boosters(table: DataFrame, features, fits: list[Fit]) -> list[Booster]:
    """Fit several boosters to one table (row_id, filing_year, label, features) in step.

    Features hold no gaps. Training rows of a fit are those of years before its `before`; a fit without
    rows, or with one class only, gets no trees: its base is the share of positives, kept off 0 and 1.
    The starting margin is the log-odds of that share. Rows are drawn for a tree by a hash of the row id,
    columns by the seed; rows that repeat an id are drawn together.
    """
    features = tuple(features)
    settings = [fit.settings for fit in fits]
    befores = list(dict.fromkeys(fit.before for fit in fits))
    cut_sets = {b: quantile_cuts(table, features, b) for b in befores}
    # One row a calendar year.
    years = table.groupBy(YEAR).agg(F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("pos")).collect()
    bases, trainable = [], []
    for fit, own in zip(fits, settings):
        rows = [r for r in years if fit.before is None or r[YEAR] < fit.before]
        n, pos = sum(r.n for r in rows), sum(r.pos for r in rows) * own["scale_pos_weight"]
        neg = n - sum(r.pos for r in rows)
        share = min(max(pos / (pos + neg) if n else 0.5, 1e-6), 1 - 1e-6)
        bases.append(math.log(share / (1 - share)))
        trainable.append(pos > 0 and neg > 0)
    parts = task_number(table.sparkSession, sum(r.n for r in years))
    rows = table.select(LABEL, YEAR, F.xxhash64(ROW).alias("_hash"), *features).repartition(parts, "_hash")
    packed = rows.mapInArrow(_pack(features, cut_sets), "label binary, year binary, hash binary, bins binary")
    checkpoint_folder(table.sparkSession)
    models = [(fit.before, base) for fit, base in zip(fits, bases)]
    blocks = _kept(packed.rdd.map(partial(_unpack, befores=befores, width=len(features), models=models)))
    trees: list[list[Tree]] = [[] for _ in fits]
    done: dict[int, tuple] = {}
    try:
        for number in range(max((int(s["n_estimators"]) for s in settings), default=0)):
            open_trees = []
            for m, (fit, own) in enumerate(zip(fits, settings)):
                if not trainable[m] or number >= int(own["n_estimators"]):
                    continue
                draw = random.Random(f"{fit.seed}:{number}")
                size = max(1, int(own["colsample_bytree"] * len(features)))
                columns = sorted(draw.sample(range(len(features)), size))
                widths = [len(cut_sets[fit.before][c]) + 1 for c in columns]
                open_trees.append(
                    _Growing(
                        m, fit.before, draw.getrandbits(60), columns, float(own["subsample"]),
                        float(own["scale_pos_weight"]), _empty_tree(int(own["max_depth"])), [0], widths,
                    )
                )
            before = blocks
            if done:
                # Computed and kept by the first level's job.
                blocks = before.map(partial(_moved, done)).persist(StorageLevel.MEMORY_AND_DISK)
                if number % REBASE == 0:
                    blocks.checkpoint()
            _grow(blocks, open_trees, settings, [cut_sets[f.before] for f in fits])
            if done:
                before.unpersist()
            done = {g.model: (g.before, g.tree) for g in open_trees}
            for g in open_trees:
                trees[g.model].append(g.tree)
    finally:
        blocks.unpersist()
    return [
        Booster(features, tuple(cut_sets[fit.before]), base, tuple(own))
        for fit, base, own in zip(fits, bases, trees)
    ]


# Using


def _scores(boosters: list[Booster], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = feature_matrix(batch, boosters[0].features)
            found = [pa.array(b.margins(values)) for b in boosters]
            rest = [n for n in batch.schema.names if n in (ROW, YEAR, LABEL)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], *found], [*rest, *names])

    return run


def with_margins(table: DataFrame, boosters: dict[str, Booster]) -> DataFrame:
    """row_id, filing_year, label and the log-odds of each booster, in a column of its name."""
    own = list(boosters.values())
    slim = table.select(ROW, YEAR, LABEL, *[f for f in own[0].features])
    kinds = dict(slim.dtypes)
    schema = ", ".join([*[f"{n} {kinds[n]}" for n in (ROW, YEAR, LABEL)], *[f"`{n}` double" for n in boosters]])
    return slim.mapInArrow(_scores(own, list(boosters)), schema)


def scored(table: DataFrame, booster: Booster) -> DataFrame:
    """(row_id, filing_year, label, score) with the probability of the positive class."""
    rows = with_margins(table, {"margin": booster})
    return rows.select(ROW, YEAR, LABEL, (1 / (1 + F.exp(-F.col("margin")))).alias("score"))


def importances(booster: Booster, kind: str = "gain") -> list[tuple[str, float]]:
    """Per feature, largest first: mean gain or mean cover of its splits, or their number ('weight')."""
    if kind not in ("gain", "cover", "weight"):
        raise ValueError(f"no such kind of importance: {kind}")
    total, splits = np.zeros(len(booster.features)), np.zeros(len(booster.features))
    for tree in booster.trees:
        for node in _reached(tree):
            if tree.feature[node] >= 0:
                splits[tree.feature[node]] += 1
                total[tree.feature[node]] += tree.gain[node] if kind == "gain" else tree.cover[node]
    values = splits if kind == "weight" else total / np.maximum(splits, 1)
    return sorted(zip(booster.features, values.tolist()), key=lambda x: (-x[1], x[0]))


def _reached(tree: Tree) -> list[int]:
    nodes = [0]
    for node in nodes:
        if tree.feature[node] >= 0:
            nodes += [2 * node + 1, 2 * node + 2]
    return nodes


# Contributions


def _leaf_tables(tree: Tree) -> list[tuple[list[int], list[list[tuple[int, bool]]], np.ndarray]]:
    """Per leaf: its features, the tests of each feature on the path, and contributions by feature and outcome.

    An outcome says, bit by bit, for which features of the path a row passes all tests. With the outcome
    o and the share z of cover that follows the path at each feature, a set S of known features sends the
    row to the leaf with weight prod(o in S) prod(z outside S), and the Shapley value of a feature is the
    mean of what it adds to that weight over all orders, times the leaf's value.
    """
    leaves = []

    def walk(node: int, path: list[tuple[int, int, bool, float]]) -> None:
        if tree.feature[node] < 0:
            leaves.append((float(tree.value[node]), path))
            return
        for right in (False, True):
            child = 2 * node + 1 + right
            share = float(tree.cover[child] / tree.cover[node]) if tree.cover[node] > 0 else 0.5
            walk(child, [*path, (int(tree.feature[node]), node, right, share)])

    walk(0, [])
    out = []
    for value, path in leaves:
        features = list(dict.fromkeys(f for f, *_ in path))
        tests = [[(node, right) for f, node, right, _ in path if f == own] for own in features]
        out.append((features, tests, value, [math.prod(s for f, _, _, s in path if f == own) for own in features]))
    # Leaves with equally many features are worked on together.
    tables: dict[int, np.ndarray] = {}
    for m in {len(features) for features, *_ in out}:
        same = [k for k, leaf in enumerate(out) if len(leaf[0]) == m]
        made = _outcome_tables(np.array([out[k][2] for k in same]), np.array([out[k][3] for k in same]).reshape(len(same), m))
        tables |= dict(zip(same, made))
    return [(features, tests, tables[k]) for k, (features, tests, *_) in enumerate(out)]


def _outcome_tables(values: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Contributions by leaf, feature of its path and outcome, for leaves of m features each."""
    m = shares.shape[1]
    passed = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(np.float64)
    weights = [math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)]
    table = np.zeros((len(values), m, 1 << m))
    for j in range(m):
        # Coefficients by the number of known features among the others.
        known = np.ones((1, len(values), 1 << m))
        for k in range(m):
            if k != j:
                longer = np.zeros((len(known) + 1, *known.shape[1:]))
                longer[:-1] += known * shares[:, k, None]
                longer[1:] += known * passed[:, k]
                known = longer
        mean = np.tensordot(weights, known, 1)
        table[:, j] = values[:, None] * (passed[:, j] - shares[:, j, None]) * mean
    return table


def expected_margin(booster: Booster) -> float:
    """The margin of a row of which nothing is known: leaves weighted by their cover."""
    total = booster.base
    for tree in booster.trees:
        weight = {0: 1.0}
        for node in _reached(tree):
            if tree.feature[node] < 0:
                total += weight[node] * float(tree.value[node])
                continue
            for child in (2 * node + 1, 2 * node + 2):
                share = tree.cover[child] / tree.cover[node] if tree.cover[node] > 0 else 0.5
                weight[child] = weight[node] * float(share)
    return total


def shapley_values(booster: Booster, tables: list, values: np.ndarray) -> np.ndarray:
    """Contribution of each feature to each row's margin; `tables` are those of the booster's trees."""
    columns = np.ascontiguousarray(values.T)
    out = np.zeros(columns.shape)
    for tree, leaves in zip(booster.trees, tables):
        goes = {}
        for n in _reached(tree):
            if tree.feature[n] >= 0:
                right = columns[tree.feature[n]] > tree.threshold[n]
                goes[n, True], goes[n, False] = right, ~right
        for features, tests, table in leaves:
            # A path may be longer than eight features.
            outcome = np.zeros(len(values), np.uint8 if len(features) <= 8 else np.int64)
            for k, own in enumerate(tests):
                passed = goes[own[0]]
                for test in own[1:]:
                    passed = passed & goes[test]
                outcome |= passed.astype(outcome.dtype) << outcome.dtype.type(k)
            for j, feature in enumerate(features):
                out[feature] += table[j].take(outcome)
    return out.T


def _contributed(booster: Booster, base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_leaf_tables(t) for t in booster.trees]
        for batch in batches:
            found = shapley_values(booster, tables, feature_matrix(batch, booster.features))
            yield pa.RecordBatch.from_arrays(
                [batch.column(ROW), *[pa.array(found[:, k]) for k in range(found.shape[1])], pa.array(np.full(batch.num_rows, base))],
                [ROW, *booster.features, "expected_margin"],
            )

    return run


def tree_contributions(table: DataFrame, booster: Booster) -> DataFrame:
    """Exact path-dependent Shapley values: row_id, a column for each feature, and expected_margin.

    Together they are the margin of the row. Tables of every leaf are made once a task; rows only test
    which of them apply.
    """
    base = expected_margin(booster)
    slim = table.select(ROW, *booster.features)
    schema = ", ".join(
        [f"{ROW} {dict(slim.dtypes)[ROW]}", *[f"`{f}` double" for f in booster.features], "expected_margin double"]
    )
    return slim.mapInArrow(_contributed(booster, base), schema)
