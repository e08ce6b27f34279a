"""K-means for many numbers of clusters and many starts at once.

Rows are packed once into blocks of float64 and kept. Every start begins with k-means|| (two rounds of oversampling, then
weighted k-means++ over the candidates), and a pass over the blocks moves the centres of every start that has not settled.
So there are as many passes as the slowest start needs, not the sum over all of them. A task returns one row of sums,
counts and costs, whose size depends on the centres alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048  # rows whose distances are held at a time
ROUNDS = 2  # of oversampling, as in Spark's own k-means


@dataclass
class Summary:
    trainingCost: float


@dataclass
class Clustering:
    """Centres of one start, and the sum of squares about them."""

    centres: np.ndarray
    summary: Summary

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Adds prediction: the nearest centre, the first of equally near ones."""
        gaps = F.array(*[_square(F.col("_x"), centre) for centre in self.centres])
        nearest = (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
        return vectors.withColumn("_x", vector_to_array("features")).withColumn("prediction", nearest).drop("_x")


def _square(x: Column, centre: np.ndarray) -> Column:
    out = F.lit(0.0)
    for i, v in enumerate(centre):
        out = out + (x[i] - F.lit(float(v))) * (x[i] - F.lit(float(v)))
    return out


def packed(vectors: DataFrame) -> DataFrame:
    """The vectors as blocks of rows, dealt over the cores."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.num_rows
            x = np.ascontiguousarray(flat, np.float64).reshape(n, -1) if n else np.empty((0, 0))
            parts = [x[at: at + BLOCK] for at in range(0, n, BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "x"]
            )

    rows = vectors.select(vector_to_array("features").alias("x"))
    return rows.mapInArrow(pack, "n int, x binary").repartition(vectors.sparkSession.sparkContext.defaultParallelism)


def _pass(blocks: DataFrame, start: Callable, each: Callable, salt: int = 0) -> list:
    """Each task's ``start()`` after ``each(state, x, random)`` for all of its blocks, in the order of the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        random, state, seen = np.random.default_rng([salt, task]), start(), False
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                each(state, np.frombuffer(x.as_buffer(), np.float64).reshape(n, -1), random)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([pickle.dumps(state)], pa.binary())], ["task", "state"])

    rows = blocks.mapInArrow(run, "task int, state binary").collect()
    return [pickle.loads(r.state) for r in sorted(rows, key=lambda r: r.task)]


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """A row for each centre: squares of the distances, without the rows' own squares."""
    return np.einsum("ij,ij->i", centres, centres)[:, None] - 2.0 * (centres @ x.T)


def _held(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """A row for each centre: 1 for the rows that it is the nearest of, the first of equally near ones."""
    gaps = _gaps(x, centres)
    mine = gaps == gaps.min(axis=0)
    if np.count_nonzero(mine) > len(x):
        mine = gaps.argmin(axis=0) == np.arange(len(centres))[:, None]
    return mine.astype(np.float64)


def _costs(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,ij->i", x, x) + _gaps(x, centres).min(axis=0), 0.0)


def _first(blocks: DataFrame, jobs: int, seed: int) -> list[np.ndarray]:
    """A row for every start, each of all rows equally likely."""
    def each(state: dict, x: np.ndarray, random: np.random.Generator) -> None:
        state["n"] += len(x)
        for j in np.flatnonzero(random.random(jobs) < len(x) / state["n"]):
            state["rows"][j] = x[random.integers(len(x))].copy()

    told = _pass(blocks, lambda: {"n": 0, "rows": [None] * jobs}, each, seed)
    if not told:
        raise ValueError("k-means needs at least one row")
    random, sizes = np.random.default_rng(seed), np.array([t["n"] for t in told], np.float64)
    return [told[t]["rows"][j][None, :] for j, t in enumerate(random.choice(len(told), jobs, p=sizes / sizes.sum()))]


def _candidates(blocks: DataFrame, ks: list[int], seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Candidates of every start by k-means||, and how many rows are nearest to each."""
    found = _first(blocks, len(ks), seed)
    for turn in range(ROUNDS):
        held = found

        def add(state: np.ndarray, x: np.ndarray, _: np.random.Generator) -> None:
            state += [_costs(x, c).sum() for c in held]

        totals = sum(_pass(blocks, lambda: np.zeros(len(ks)), add))

        def draw(state: list, x: np.ndarray, random: np.random.Generator) -> None:
            for j, (k, c) in enumerate(zip(ks, held)):
                if totals[j] > 0:
                    state[j].extend(x[random.random(len(x)) < 2.0 * k * _costs(x, c) / totals[j]].copy())

        drawn = _pass(blocks, lambda: [[] for _ in ks], draw, seed + 1 + turn)
        found = [np.unique(np.vstack([c, *[row for task in drawn for row in task[j]]]), axis=0) for j, c in enumerate(held)]

    def weigh(state: list, x: np.ndarray, _: np.random.Generator) -> None:
        for j, c in enumerate(found):
            state[j] += _held(x, c).sum(axis=1)

    weighed = _pass(blocks, lambda: [np.zeros(len(c)) for c in found], weigh)
    return found, [sum(task[j] for task in weighed) for j in range(len(ks))]


def _settle(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ over the candidates, then at most thirty moves."""
    if len(points) <= k:
        return points
    random, chosen = np.random.default_rng(seed), []
    chances = weights
    while len(chosen) < k and chances.sum() > 0:
        chosen.append(random.choice(len(points), p=chances / chances.sum()))
        chances = weights * _costs(points, points[chosen])
        chances[chosen] = 0.0
    centres = points[chosen]
    for _ in range(30):
        mine = _held(points, centres) * weights
        n = mine.sum(axis=1, keepdims=True)
        moved = np.where(n > 0, (mine @ points) / np.maximum(n, 1.0), centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def fits(blocks: DataFrame, jobs: list[tuple[int, int]], seed: int, moves: int, tol: float) -> list[Clustering]:
    """A clustering for each (k, start). Centres settle once none moves by more than ``tol``; rows in fewer than k
    places get as many centres as places."""
    points, weights = _candidates(blocks, [k for k, _ in jobs], seed)
    centres = [_settle(p, w, k, seed + start) for p, w, (k, start) in zip(points, weights, jobs)]
    active = list(range(len(jobs)))
    for _ in range(moves):
        held = {j: centres[j] for j in active}

        def move(state: dict, x: np.ndarray, _: np.random.Generator) -> None:
            wide = np.column_stack([x, np.ones(len(x))])
            for j, c in held.items():
                state[j] += _held(x, c) @ wide

        told = _pass(blocks, lambda: {j: np.zeros((len(c), c.shape[1] + 1)) for j, c in held.items()}, move)
        still = []
        for j in active:
            sums = sum(t[j] for t in told)
            n = sums[:, -1:]
            centres[j] = np.where(n > 0, sums[:, :-1] / np.maximum(n, 1.0), held[j])
            if (np.square(centres[j] - held[j]).sum(axis=1) > tol * tol).any():
                still.append(j)
        active = still
        if not active:
            break

    def add(state: np.ndarray, x: np.ndarray, _: np.random.Generator) -> None:
        state += [_costs(x, c).sum() for c in centres]

    costs = sum(_pass(blocks, lambda: np.zeros(len(jobs)), add))
    return [Clustering(c, Summary(float(cost))) for c, cost in zip(centres, costs)]
