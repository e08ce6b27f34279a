"""Random forests over binned rows.

Numbers become at most 32 bins, names the index of their category. A category's index stands for all of its one-hot
columns: the rows of a column are the rows of one index, the others are all rows less these. Bootstrap draws follow from a
hash of a row's key, so no draw and no tree's node of a row is ever stored; a row costs a byte per number and name.

Trees grow level by level from histograms. While the binned rows fit into ``SHARED`` bytes they are broadcast and every task
grows whole trees. Beyond that the rows stay where they are: a pass routes each block through the trees so far and sums its
histograms of the columns that each node drew, and a second stage adds them up and splits, trees apart. A pass takes as many
trees as ``HELD`` bytes of histograms allow.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32  # of a number, as Spark's forests have
ROWS = 1 << 17  # rows of a block
SHARED = 64 << 20  # bytes of binned rows that are broadcast
HELD = 96 << 20  # bytes of histograms that a task holds
ACCURACY = 10_000


def _poisson() -> np.ndarray:
    """How often a row is drawn, by 16 random bits: Poisson with mean 1."""
    upto = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(12)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


POISSON = _poisson()


def mixed(keys: np.ndarray, four: int, seed: int) -> np.ndarray:
    """Random bits of each row (a 64-bit hash of its key) for four trees."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(((four + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def draws(keys: np.ndarray, trees: list[int], seed: int) -> Iterator[np.ndarray]:
    """For each tree how often each row is in its sample."""
    held = None
    for tree in trees:
        if held is None or held[0] != tree // 4:
            held = tree // 4, mixed(keys, tree // 4, seed)
        yield POISSON.take((held[1] >> np.uint64(16 * (tree % 4))).astype(np.uint16))


@dataclass(frozen=True)
class Plan:
    """What all trees share: bins of each feature, one-hot or not, and the drawing of columns."""

    bins: tuple[int, ...]  # of the numbers, then categories with the one for unknown names
    numbers: int
    trees: int
    depth: int
    seed: int
    classes: bool
    weights: tuple[float, float] = (1.0, 1.0)  # of the classes
    mean: float = 0.0  # of the label, taken off for regression

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.bins)])

    @property
    def column_of_bin(self) -> np.ndarray:
        """The feature column of each bin: one for a number, one for each index of a category."""
        hot = self.numbers + np.arange(sum(self.bins[self.numbers:]))
        return np.concatenate([np.repeat(np.arange(self.numbers), self.bins[: self.numbers]), hot]).astype(np.int64)

    @property
    def columns(self) -> int:
        return self.numbers + sum(self.bins[self.numbers:])

    def drawn(self, tree: int, level: int, nodes: int) -> np.ndarray:
        """The columns that each node may split by: the root of their number for classes, all for regression."""
        if not self.classes:
            return np.ones((nodes, self.columns), bool)
        chances = np.random.default_rng([self.seed, tree, level]).random((nodes, self.columns))
        some = math.ceil(math.sqrt(self.columns))
        out = np.zeros((nodes, self.columns), bool)
        np.put_along_axis(out, np.argpartition(chances, some - 1, axis=1)[:, :some], True, axis=1)
        return out


@dataclass
class Trees:
    """Trees in heap order. A test packs feature, lowest and highest code that go right; below a leaf none goes right."""

    tests: np.ndarray  # trees x inner nodes
    values: np.ndarray  # trees x nodes of the last level
    weights: np.ndarray  # importance of each column

    def route(self, tree: int, codes: np.ndarray, rows: np.ndarray, levels: int) -> np.ndarray:
        """The place in its level that each row reaches."""
        node = np.zeros(len(rows), np.int64)
        for _ in range(levels):
            node = moved(self.tests[tree], codes, node, rows)
        return node - ((1 << levels) - 1)


STAY = (1 << 16) | 0  # no code is both 1 or more and 0 or less


class Growing:
    """One tree between two levels: which nodes still split, and what is known of them."""

    def __init__(self, plan: Plan, tree: int) -> None:
        self.plan, self.tree, self.level = plan, tree, 0
        self.tests = np.full((1 << plan.depth) - 1, STAY, np.int64)
        self.values = np.zeros(1 << plan.depth)
        self.weights = np.zeros(plan.columns)
        self.slots = np.zeros(1, np.int32)  # of each node of the level its row in the histograms, or -1
        self.open = 1
        self._drawn: tuple[int, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_drawn": None}

    @property
    def drawn(self) -> np.ndarray:
        """The columns that each open node may split by."""
        if self._drawn is None or self._drawn[0] != self.level:
            self._drawn = self.level, self.plan.drawn(self.tree, self.level, self.open)
        return self._drawn[1]

    def split(self, totals: np.ndarray, sums: np.ndarray) -> None:
        """From what is in the open nodes and their bins (nodes x bins x 2) their best tests; the level is then done."""
        plan = self.plan
        nodes = np.flatnonzero(self.slots >= 0)
        allowed = self.drawn
        scale = np.array(plan.weights) if plan.classes else np.ones(2)
        whole = totals * scale
        best = np.full(self.open, -np.inf)
        feature, low, high, column = (np.zeros(self.open, np.int64) for _ in range(4))
        right_of = np.zeros((self.open, 2))
        starts = plan.starts
        for f, bins in enumerate(plan.bins):
            part = sums[:, starts[f]: starts[f + 1]]
            if f < plan.numbers:
                if bins < 2:
                    continue
                right = part[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
                at = np.full(bins - 1, f)
            else:
                right = part
                at = plan.numbers + starts[f] - starts[plan.numbers] + np.arange(bins)
            left = totals[:, None] - right
            rows = (right.sum(axis=2), left.sum(axis=2)) if plan.classes else (right[..., 0], left[..., 0])
            gain = _purity(right * scale, plan.classes) + _purity(left * scale, plan.classes)
            gain[(rows[0] <= 0) | (rows[1] <= 0) | ~allowed[:, at]] = -np.inf
            top = gain.argmax(axis=1)
            value = gain[np.arange(self.open), top]
            better = value > best
            best[better] = value[better]
            feature[better], column[better] = f, at[top[better]]
            low[better] = top[better] + (1 if f < plan.numbers else 0)
            high[better] = (bins - 1 if f < plan.numbers else top[better])
            right_of[better] = right[np.arange(self.open), top][better]
        pure = _purity(whole, plan.classes)
        gained = best - pure
        splits = np.isfinite(best) & (gained > 1e-10 * pure)  # less is rounding
        np.add.at(self.weights, column[splits], gained[splits])
        base = (1 << self.level) - 1
        self.tests[base + nodes[splits]] = ((feature << 32) | (low << 16) | high)[splits]
        children = np.stack([totals - right_of, right_of], axis=1)
        below = 1 << (plan.depth - self.level - 1)
        values = _values(children, plan)
        own = _values(totals, plan)
        for s, node in enumerate(nodes):
            at = node * 2 * below
            if splits[s]:
                self.values[at: at + below], self.values[at + below: at + 2 * below] = values[s]
            else:
                self.values[at: at + 2 * below] = own[s]
        self.level += 1
        slots = np.full(1 << self.level, -1, np.int32)
        # pure children and single rows stay leaves
        live = np.repeat(splits, 2) & _mixed(children.reshape(-1, 2), plan)
        again = (2 * nodes[:, None] + np.arange(2)).reshape(-1)[live]
        slots[again] = np.arange(len(again))
        self.slots, self.open = slots, len(again)

    @property
    def done(self) -> bool:
        return self.level >= self.plan.depth or self.open == 0


def _purity(sums: np.ndarray, classes: bool) -> np.ndarray:
    """What a split raises: squares of the class weights over their sum, or the square of the sum over the rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            n = sums[..., 0] + sums[..., 1]
            return np.where(n > 0, (np.square(sums[..., 0]) + np.square(sums[..., 1])) / n, 0.0)
        return np.where(sums[..., 0] > 0, np.square(sums[..., 1]) / sums[..., 0], 0.0)


def _values(sums: np.ndarray, plan: Plan) -> np.ndarray:
    """The share of class 1, or the mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if plan.classes:
            weighed = sums * np.array(plan.weights)
            return np.nan_to_num(weighed[..., 1] / (weighed[..., 0] + weighed[..., 1]))
        return np.nan_to_num(sums[..., 1] / sums[..., 0]) + plan.mean


def _mixed(sums: np.ndarray, plan: Plan) -> np.ndarray:
    return (sums > 0).all(axis=1) if plan.classes else sums[:, 0] > 1


@dataclass
class Sample:
    """The rows of a block that a tree drew, and how often."""

    codes: np.ndarray
    label: np.ndarray
    drawn: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, label: np.ndarray, drawn: np.ndarray) -> Sample:
        rows = np.flatnonzero(drawn)
        return cls(codes.take(rows, axis=1), label.take(rows), drawn.take(rows).astype(np.float64))


def moved(tests: np.ndarray, codes: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The children, in heap order, that rows at inner nodes go to."""
    test = tests.take(node)
    code = codes.reshape(-1).take((test >> 32) * codes.shape[1] + rows)
    return 2 * node + 1 + ((code >= ((test >> 16) & 0xFFFF)) & (code <= (test & 0xFFFF)))


def histograms(plan: Plan, grown: Growing, sample: Sample, place: np.ndarray, totals: np.ndarray, sums: np.ndarray) -> None:
    """Adds the rows, at their places in the level, to what is in the open nodes and their bins."""
    slot, codes, y, weights = grown.slots.take(place).astype(np.int64), sample.codes, sample.label, sample.drawn
    if (slot < 0).any():
        here = np.flatnonzero(slot >= 0)
        slot, codes, y, weights = slot[here], codes.take(here, axis=1), y[here], weights[here]
    sided = None if plan.classes else weights * y

    def add(target: np.ndarray, at: np.ndarray, pick: np.ndarray | None) -> None:
        shape = target.shape[:-1]
        size = math.prod(shape)
        u = weights if pick is None else weights[pick]
        if plan.classes:
            at *= 2
            at += y if pick is None else y[pick]
            target += np.bincount(at, u, 2 * size).reshape(target.shape)
        else:
            target[..., 0] += np.bincount(at, u, size).reshape(shape)
            target[..., 1] += np.bincount(at, sided if pick is None else sided[pick], size).reshape(shape)

    add(totals, slot.copy(), None)
    starts = plan.starts
    for f, bins in enumerate(plan.bins):
        pick = None
        if plan.classes and f < plan.numbers:
            pick = np.flatnonzero(grown.drawn[:, f].take(slot))  # few nodes draw a number
            if len(pick) == 0:
                continue
        at = (slot if pick is None else slot[pick]) * bins
        at += codes[f] if pick is None else codes[f].take(pick)
        add(sums[:, starts[f]: starts[f + 1]], at, pick)


def _arrays(row, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (features x rows), labels and key hashes of a block."""
    keys = np.frombuffer(row["keys"], np.uint64)
    codes = np.frombuffer(row["codes"], np.uint16 if max(plan.bins) > 256 else np.uint8).reshape(len(plan.bins), len(keys))
    label = np.frombuffer(row["label"], np.float64)
    return codes, label.astype(np.int64) if plan.classes else label - plan.mean, keys


def _empty(plan: Plan, grown: Growing) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros((grown.open, 2)), np.zeros((grown.open, sum(plan.bins), 2))


def grow(plan: Plan, tree: int, blocks: list) -> Growing:
    """A whole tree from blocks in memory."""
    out = Growing(plan, tree)
    held = []
    for codes, label, keys in blocks:
        sample = Sample.of(codes, label, next(draws(keys, [tree], plan.seed)))
        held.append((sample, np.zeros(len(sample.label), np.int32)))
    while not out.done:
        totals, sums = _empty(plan, out)
        for sample, place in held:
            histograms(plan, out, sample, place, totals, sums)
        base = (1 << out.level) - 1
        out.split(totals, sums)
        if not out.done:
            for sample, place in held:
                place[:] = moved(out.tests, sample.codes, place + base, np.arange(len(place))) - (2 * base + 1)
    return out


def _shared(blocks: DataFrame, plan: Plan) -> list[Growing]:
    """Tasks grow whole trees from the broadcast rows."""
    sc = blocks.sparkSession.sparkContext
    told = sc.broadcast([(bytes(r.codes), bytes(r.label), bytes(r.keys)) for r in blocks.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_arrays(dict(zip(("codes", "label", "keys"), b)), plan) for b in told.value]
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(grow(plan, tree, rows))], pa.binary())], ["tree"])

    tasks = min(plan.trees, 2 * sc.defaultParallelism)
    try:
        grown = blocks.sparkSession.range(0, plan.trees, 1, tasks).mapInArrow(run, "tree binary").collect()
        return sorted((pickle.loads(r.tree) for r in grown), key=lambda g: g.tree)
    finally:
        told.destroy()


def _level(blocks: DataFrame, plan: Plan, group: list[Growing]) -> list[Growing]:
    """The next level of some trees, from rows that stay where they are."""
    sc = blocks.sparkSession.sparkContext
    told = sc.broadcast(pickle.dumps(group))

    def drawn_bins(g: Growing) -> np.ndarray:
        return g.drawn[:, plan.column_of_bin]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(told.value)
        held = [_empty(plan, g) for g in trees]
        for batch in batches:
            for row in batch.to_pylist():
                codes, label, keys = _arrays(row, plan)
                for g, (totals, sums), w in zip(trees, held, draws(keys, [g.tree for g in trees], plan.seed)):
                    sample = Sample.of(codes, label, w)
                    place = Trees(g.tests[None], g.values[None], g.weights).route(0, sample.codes, np.arange(len(sample.label)), g.level)
                    histograms(plan, g, sample, place, totals, sums)
        for g, (totals, sums) in zip(trees, held):
            data = np.concatenate([totals.reshape(-1), sums[drawn_bins(g)].reshape(-1)])
            yield pa.RecordBatch.from_arrays([pa.array([g.tree], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["tree", "sums"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {g.tree: g for g in pickle.loads(told.value)}
        tree, total = None, None

        def done() -> pa.RecordBatch:
            g = trees[tree]
            totals, sums = _empty(plan, g)
            totals[:] = total[: totals.size].reshape(totals.shape)
            sums[drawn_bins(g)] = total[totals.size:].reshape(-1, 2)
            g.split(totals, sums)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(g)], pa.binary())], ["tree"])

        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_buffer(), np.float64)
                if at == tree:
                    total += part
                    continue
                if tree is not None:
                    yield done()
                tree, total = at, part.copy()
        if tree is not None:
            yield done()

    parts = blocks.mapInArrow(add, "tree int, sums binary").repartition(min(len(group), sc.defaultParallelism), "tree")
    try:
        rows = parts.sortWithinPartitions("tree").mapInArrow(split, "tree binary").collect()
        return [pickle.loads(r.tree) for r in rows]
    finally:
        told.destroy()


def _spread_out(blocks: DataFrame, plan: Plan) -> list[Growing]:
    growing = [Growing(plan, t) for t in range(plan.trees)]
    while todo := [g for g in growing if not g.done]:
        room = max(1, HELD // (16 * sum(plan.bins) * max(g.open for g in todo)))
        for at in range(0, len(todo), room):
            for g in _level(blocks, plan, todo[at: at + room]):
                growing[g.tree] = g
    return growing


def _thresholds(rows: DataFrame, numbers: list[str]) -> list[np.ndarray]:
    """The upper ends of each number's bins but the last: quantiles, or halfway between its values if they are few."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.empty(0) for _ in numbers]
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if len(found[i]) <= BINS:
                    found[i] = np.unique(np.concatenate([found[i], column.to_numpy(zero_copy_only=False)]))[: BINS + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(numbers)), pa.int32()), pa.array([f.tolist() for f in found], pa.list_(pa.float64()))], ["i", "x"]
        )

    values = rows.select(*[F.col(c).cast("double").alias(c) for c in numbers])
    points = F.array(*[F.lit((b + 1) / BINS) for b in range(BINS - 1)])
    quantiles = values.agg(*[F.percentile_approx(c, points, F.lit(ACCURACY)).alias(c) for c in numbers]).first()
    seen = [set() for _ in numbers]
    for r in values.mapInArrow(few, "i int, x array<double>").collect():
        seen[r.i].update(r.x)
    out = []
    for i, c in enumerate(numbers):
        if len(seen[i]) <= BINS:
            x = np.array(sorted(seen[i]))
            out.append((x[1:] + x[:-1]) / 2)
        else:
            out.append(np.unique(quantiles[c]))
    return out


def _coded(columns: list[np.ndarray], ends: list[np.ndarray], kind: type) -> np.ndarray:
    """Features x rows: the bin of a number, the index of a name."""
    coded = [np.searchsorted(e, x, side="left").astype(kind) for x, e in zip(columns, ends)]
    return np.stack(coded + [x.astype(kind) for x in columns[len(ends):]])


@dataclass
class Forest:
    """An encoding and the trees over it; ``transform`` adds prediction, and score for classes."""

    encoding: PipelineModel
    numbers: list[str]
    names: list[str]
    ends: list[np.ndarray]
    plan: Plan
    trees: Trees

    @property
    def featureImportances(self) -> np.ndarray:
        return self.trees.weights

    def transform(self, df: DataFrame) -> DataFrame:
        told = df.sparkSession.sparkContext.broadcast((self.trees.tests, self.trees.values, self.ends))
        plan, depth, kind = self.plan, self.plan.depth, np.uint16 if max(self.plan.bins) > 256 else np.uint8

        def mean(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            tests, values, ends = told.value
            trees = Trees(tests, values, np.empty(0))
            for columns in batches:
                x = [np.asarray(c, np.float64) for c in columns]
                out = np.zeros(len(x[0]))
                for at in range(0, len(out), 8192):
                    codes = _coded([c[at: at + 8192] for c in x], ends, kind)
                    rows = np.arange(codes.shape[1])
                    for t in range(plan.trees):
                        out[at: at + 8192] += values[t].take(trees.route(t, codes, rows, depth))
                yield pd.Series(out / plan.trees)

        # A filter on the score would otherwise be moved below it and compute it once more.
        told_by = F.pandas_udf(mean, "double").asNondeterministic()(*[F.col(c).cast("double") for c in _inputs(self.numbers, self.names)])
        out = self.encoding.transform(df)
        if not plan.classes:
            return out.withColumn("prediction", told_by)
        return out.withColumn("score", told_by).withColumn("prediction", (F.col("score") > 0.5).cast("double"))


def _inputs(numbers: list[str], names: list[str]) -> list[str]:
    return [*numbers, *[f"{c}_ix" for c in names]]


def fit(train: DataFrame, key: str, encoding: PipelineModel, numbers: list[str], names: list[str], trees: int, depth: int,
        seed: int, class_weights: dict[float, float] | None = None) -> Forest:
    """A forest on ``label``; with class weights of two classes, without a regression."""
    rows = encoding.transform(train).select(
        *[F.col(c).cast("double").alias(c) for c in _inputs(numbers, names)], F.col("label").cast("double").alias("label"),
        F.xxhash64(F.col(key).cast("string")).alias("_key"),
    )
    classes = class_weights is not None
    ends = _thresholds(rows, numbers)
    sizes = [len(e) + 1 for e in ends] + [n + 1 for n in encoding.stages[1].categorySizes]  # one more for invalid names
    weights = tuple(class_weights.get(c, 1.0) for c in (0.0, 1.0)) if classes else (1.0, 1.0)
    plan = Plan(tuple(sizes), len(numbers), trees, depth, seed, classes, weights)
    kind = np.uint16 if max(sizes) > 256 else np.uint8

    def block(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        data = [_coded(columns[:-2], ends, kind).tobytes(), columns[-2].astype(np.float64).tobytes(), columns[-1].astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in data], ["codes", "label", "keys"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for at in range(0, batch.num_rows, ROWS):
                held.append([c[at: at + ROWS] for c in columns])
                rows += len(held[-1][0])
                if rows >= ROWS // 2:
                    yield block(held)
                    held, rows = [], 0
        if held:
            yield block(held)

    spark = train.sparkSession
    blocks = rows.mapInArrow(pack, "codes binary, label binary, keys binary").repartition(spark.sparkContext.defaultParallelism).persist()
    try:
        size = blocks.agg(F.sum(F.length("codes") + F.length("label") + F.length("keys"))).first()[0]
        if not size:
            raise ValueError("a forest needs at least one row")
        if not classes:
            plan = replace(plan, mean=rows.agg(F.avg("label")).first()[0])
        grown = (_shared if size <= SHARED else _spread_out)(blocks, plan)
    finally:
        blocks.unpersist()
    each = [g.weights / g.weights.sum() if g.weights.sum() > 0 else g.weights for g in grown]
    total = np.sum(each, axis=0)
    found = Trees(np.stack([g.tests for g in grown]), np.stack([g.values for g in grown]), total / total.sum() if total.sum() > 0 else total)
    return Forest(encoding, numbers, names, ends, plan, found)
