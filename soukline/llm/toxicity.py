"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours and pairs with one or two words between them (A-Z lower-cased, punctuation
dropped), hashed into 2 ** BITS coordinates and counted once per text. The model learns in one stream over a bounded
sample of labelled rows, at most PER_CLASS texts of each class in EPOCHS passes; the stream's memory is its state, not
its rows. Each coordinate has its own rate and L1 sets most weights to zero, so the model is at most MAX_WEIGHTS
weights; it is sent to every task. Every whole text is then scored.

Defined results: a null or empty text has no features and scores like the model's bias. Labels that are null are not
learned; of several labels of one document the highest counts. Without labels of both classes every score is 0.
Repeated rows are scored one by one. An empty table gives an empty result. Only doc_id, text and the label are read, so
other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from soukline.llm.common import first_by_hash, one_each
from soukline.llm.words import BREAK, LOWER, Texts, hashes, mix, slices, with_columns

BITS = 22
PER_CLASS = 4000
EPOCHS = 2
RATE, SMOOTH, L1, L2 = 0.3, 1.0, 10.0, 1.0
# A rare class weighs at most so much a row, or a handful of rows would drive the rates.
MOST_WEIGHT = 4.0
GAPS = (1, 2, 3)
FOLDS, HELD_OUT = 5, 0


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, text number) of every n-gram and skip-gram."""
    data = LOWER[texts.data]
    starts, ends, of = texts.words(BREAK)
    h = hashes(data, starts, ends)
    shift = np.uint64(64 - BITS)
    ids, at = [h >> shift], [of]
    for gap in GAPS:
        same = of[gap:] == of[:-gap]
        pair = mix(h[:-gap][same] * np.uint64(2 * gap + 1) + h[gap:][same])
        ids.append(pair >> shift)
        at.append(of[gap:][same])
    return np.concatenate(ids).astype(np.int32), np.concatenate(at)


class Ftrl:
    """The learner's state: one coordinate per feature and one, without L1, for the bias."""

    def __init__(self, rate=RATE, smooth=SMOOTH, l1=L1, l2=L2):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        l1 = np.where(ids == 1 << BITS, 0.0, self.l1)
        live = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -live / ((self.smooth + np.sqrt(n)) / self.rate + self.l2)

    def learn(self, ids: np.ndarray, label: int, weight: float) -> None:
        """One example; ``ids`` are its coordinates, each once."""
        ids = np.append(ids, 1 << BITS)
        w = self.weights(ids)
        slope = (_sigmoid(w.sum()) - label) * weight
        n = self.n[ids]
        self.z[ids] += slope - (np.sqrt(n + slope * slope) - np.sqrt(n)) / self.rate * w
        self.n[ids] = n + slope * slope

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and weights that are not zero; a few MB, and 50 MB if none of the 2 ** BITS were zero."""
        ids = np.flatnonzero(np.abs(self.z) > np.where(np.arange(len(self.z)) == 1 << BITS, 0, self.l1))
        return ids, self.weights(ids)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(label, weight, pick, doc_id, ids): the learning rows, at most per_class of each label; ``pick`` orders the stream.

    A chosen document that occurs several times is one row. Classes weigh the same in all, but for MOST_WEIGHT.
    """
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out())
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = first_by_hash(marked, "label", "doc_id", per_class)
    every = Window.partitionBy("label")
    chosen = chosen.withColumn("weight", F.lit(per_class / 2) / F.count("*").over(every))
    chosen = chosen.withColumn("weight", F.least("weight", F.lit(MOST_WEIGHT)))
    # at most per_class rows of each class
    rows = docs.select("doc_id", "text").join(
        F.broadcast(chosen.select(F.col("doc_id").alias("l_id"), "label", "weight", "pick")), F.col("doc_id") == F.col("l_id")
    )
    rows = one_each(rows, ["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            ids, of = features(texts)
            cuts = np.searchsorted(of_sorted := np.sort(of, kind="stable"), np.arange(len(texts) + 1))
            ids = ids[np.argsort(of, kind="stable")]
            lists = [np.unique(ids[cuts[k]: cuts[k + 1]]) for k in range(len(texts))]
            del of_sorted
            yield with_columns(
                batch, ["label", "weight", "pick", "doc_id"], ids=pa.array(lists, pa.list_(pa.int32()))
            )

    schema = "label int, weight double, pick double, doc_id long, ids array<int>"
    return rows.select("label", "weight", "pick", F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """The model's coordinates and weights; both empty without rows of both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Ftrl(), set()
        for batch in batches:
            ids = batch.column(2)
            for k, (label, weight) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                learner.learn(ids[k].values.to_numpy(), label, weight)
                seen.add(label)
        at, w = learner.model() if len(seen) == 2 else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w, pa.float64())], names=["id", "w"])

    turns = F.explode(F.array(*[F.lit(k) for k in range(epochs)]))
    # a stream of bounded length, in the same order in every run
    stream = (
        sample(docs, labels, per_class).withColumn("turn", turns).repartition(1)
        .sortWithinPartitions("turn", F.xxhash64("pick", "turn"), "doc_id", "ids").select("label", "weight", "ids")
    )
    model = stream.mapInArrow(run, "id int, w double").toArrow()
    return model.column("id").to_numpy(), model.column("w").to_numpy()


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], carry: list[str]) -> DataFrame:
    """``carry`` and the score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        weights = np.zeros((1 << BITS) + 1, dtype=np.float32)
        weights[at] = w
        for batch, texts in slices(batches, "text"):
            ids, of = features(texts)
            live = np.flatnonzero(weights[ids])
            # each coordinate counts once per text
            cells = np.unique((of[live].astype(np.int64) << BITS) | ids[live])
            total = np.bincount(cells >> BITS, weights[cells & ((1 << BITS) - 1)], minlength=len(texts))
            score = _sigmoid(total + weights[1 << BITS]) if len(at) else np.zeros(len(texts))
            yield with_columns(batch, carry, score=score)

    return docs.mapInArrow(run, docs.select(*carry).schema.add("score", "double"))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = docs.select("doc_id", "text")
    rows = scored(docs, train(docs, labels.select("doc_id", "toxic")), ["doc_id"])
    return rows.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
