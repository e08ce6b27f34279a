"""Language of code-switched text by a linear-chain conditional random field over words.

A sequence is a sentence. A word's features are the byte n-grams of ``^word$`` (so also its affixes), hashed, and whether
a lexicon learned from the sample lists the word for a language; transitions between the labels of neighbours are
learned as well. Forward-backward gives each word's label probabilities; a text's language is the label with the largest
sum over its words, its score that label's share.

The model is fitted by AdaGrad on a bounded sample, at most PER_LABEL whole texts of each language, whose sentences are
chained across texts so that switches occur. It is sent to every task, and every whole text is labelled there, sentences
of a slice side by side.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text when no language
could be learned. A tie goes to the label first by code point. Rows with null lang are labelled but not learned.
Repeated rows are labelled one by one. An empty table gives an empty result. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.llm.common import first_by_hash, one_each
from soukline.llm.words import BREAK, LOWER, Texts, hashes, mix, slices, with_columns

BITS = 18
GRAMS = (2, 3, 4)
PER_LABEL = 200
EPOCHS = 6
BATCH = 1000
RATE, DECAY = 0.3, 1e-6
LEX_COUNT, LEX_SHARE = 5, 0.9
CHAIN = 3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[list(b".!?\n")] = True


class Words:
    """The words of some texts: text number, sequence number and the number of the distinct word of each."""

    def __init__(self, texts: Texts):
        data = LOWER[texts.data]
        starts, ends, self.of = texts.words(BREAK)
        n = len(starts)
        stops = np.concatenate([[0], np.cumsum(SENTENCE_END[texts.data])])
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (self.of[1:] != self.of[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
        self.sequence = np.cumsum(fresh) - 1
        self.keys, at, self.word = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.ids, self.owner = _grams(data, starts[at], ends[at])


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, word) of the given words, marked at both ends."""
    size = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(starts)), size)
    place = np.arange(first[-1]) - first[owner]
    source = np.minimum(starts[owner] + np.maximum(place - 1, 0), max(len(data) - 1, 0))
    marked = np.where(place == 0, 94, np.where(place == size[owner] - 1, 36, data[source] if len(data) else 0)).astype(np.uint64)
    ids, of = [], []
    for n in GRAMS:
        if len(marked) < n:
            break
        value = np.zeros(len(marked) - n + 1, dtype=np.uint64)
        for k in range(n):
            value = value * np.uint64(257) + marked[k: len(marked) - n + 1 + k]
        inside = owner[: len(value)] == owner[n - 1:]
        ids.append(mix(value[inside] * np.uint64(8) + np.uint64(n)) >> np.uint64(64 - BITS))
        of.append(owner[: len(value)][inside])
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(ids).astype(np.int64), np.concatenate(of)


class Crf:
    """Weights of n-grams and lexicon entries by label, transitions and starts."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.grams = np.zeros((1 << BITS, k), dtype=np.float32)
        self.lexicon = np.zeros(0, np.uint64)
        self.listed = np.zeros(0, np.int64)
        self.entry = np.zeros((k + 1, k))
        self.step = np.zeros((k, k))
        self.start = np.zeros(k)

    def entries(self, keys: np.ndarray) -> np.ndarray:
        """Number of the language that lists a word, or the number of labels."""
        out = np.full(len(keys), len(self.labels))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
            out = np.where(self.lexicon[at] == keys, self.listed[at], out)
        return out

    def emissions(self, words: Words) -> np.ndarray:
        """Label scores of each distinct word."""
        n = len(words.keys)
        columns = [np.bincount(words.owner, self.grams[words.ids, k], minlength=n) for k in range(len(self.labels))]
        scores = np.stack(columns, axis=1) / np.sqrt(np.maximum(np.bincount(words.owner, minlength=n), 1))[:, None]
        return scores + self.entry[self.entries(words.keys)]


def by_step(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): words ordered by their place in the sequence, longer sequences first; places' bounds.

    The words of place t are order[bounds[t]: bounds[t + 1]], and the k-th of them follows the k-th of place t - 1.
    """
    n = len(sequence)
    first = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
    length = np.diff(np.append(first, n))
    ranked = np.argsort(-length, kind="stable")
    rank = np.empty(len(first), dtype=np.int64)
    rank[ranked] = np.arange(len(first))
    alive = np.searchsorted(-length[ranked], -np.arange(1, length.max() + 1), side="right")
    bounds = np.concatenate([[0], np.cumsum(alive)])
    of = np.repeat(np.arange(len(first)), length)
    order = np.empty(n, dtype=np.int64)
    order[bounds[np.arange(n) - first[of]] + rank[of]] = np.arange(n)
    return order, bounds


def forward_backward(emit, bounds, step, start, pairs=None):
    """Label probabilities of words in the order of ``by_step``; ``emit`` are exponentiated scores.

    Sequences advance together, one place at a time. ``pairs`` gathers the expected pairs of neighbours' labels.
    """
    move = np.exp(step).astype(emit.dtype)
    a, b = np.empty_like(emit), np.ones_like(emit)
    last = len(bounds) - 2
    now = emit[: bounds[1]] * np.exp(start).astype(emit.dtype)
    a[: bounds[1]] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, last + 1):
        lo, hi = bounds[t], bounds[t + 1]
        now = (a[bounds[t - 1]: bounds[t - 1] + hi - lo] @ move) * emit[lo:hi]
        now /= now.sum(axis=1, keepdims=True)
        a[lo:hi] = now
    for t in range(last, 0, -1):
        lo, hi = bounds[t], bounds[t + 1]
        prior = slice(bounds[t - 1], bounds[t - 1] + hi - lo)
        ahead = emit[lo:hi] * b[lo:hi]
        back = ahead @ move.T
        if pairs is not None:
            total = (a[prior] * back).sum(axis=1, keepdims=True)
            pairs += ((a[prior] / total).T @ ahead) * move
        back /= back.sum(axis=1, keepdims=True)
        b[prior] = back
    a *= b
    return a / a.sum(axis=1, keepdims=True)


def _exponents(scores: np.ndarray) -> np.ndarray:
    """Scores as factors, each word's largest 1; differences beyond 60 no longer count."""
    return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60)).astype(np.float32)


def fit(texts: list[str], langs: list[str]) -> Crf:
    """A model of the languages of some texts; the order of the rows decides the order of learning."""
    labels = sorted(set(langs), key=lambda x: x.encode())
    crf, k = Crf(labels), len(labels)
    if not labels:
        return crf
    words = Words(Texts(pa.array(texts, pa.string())))
    gold = np.array([labels.index(x) for x in langs])[words.of]
    seen = np.stack([np.bincount(words.word[gold == y], minlength=len(words.keys)) for y in range(k)], axis=1)
    total = seen.sum(axis=1)
    sure = (total >= LEX_COUNT) & (seen.max(axis=1) >= LEX_SHARE * total)
    crf.lexicon, crf.listed = words.keys[sure], seen[sure].argmax(axis=1)
    entry = crf.entries(words.keys)
    share = 1 / np.sqrt(np.maximum(np.bincount(words.owner, minlength=len(words.keys)), 1))
    # a random order of sentences, CHAIN of them in a row: labels change within a sequence
    sentences = int(words.sequence[-1]) + 1 if len(words.sequence) else 0
    rng = np.random.default_rng(7)
    first = np.searchsorted(words.sequence, np.arange(sentences + 1))
    used = {name: np.full(np.shape(getattr(crf, name)), 1e-8) for name in ("grams", "entry", "step", "start")}

    def climb(name, slope):
        used[name] += slope * slope
        value = getattr(crf, name)
        value += RATE * (slope - DECAY * value) / np.sqrt(used[name])

    by_word = np.argsort(words.owner, kind="stable")
    gram_first = np.searchsorted(words.owner[by_word], np.arange(len(words.keys) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(sentences)
        for begin in range(0, sentences, BATCH):
            picked = order[begin: begin + BATCH]
            size = first[picked + 1] - first[picked]
            at = np.concatenate([np.arange(first[s], first[s + 1]) for s in picked])
            sequence = np.repeat(np.arange(len(picked)) // CHAIN, size)
            used_words, inverse = np.unique(words.word[at], return_inverse=True)
            counts = gram_first[used_words + 1] - gram_first[used_words]
            spans = np.repeat(gram_first[used_words] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            rows = by_word[spans + np.arange(counts.sum())]
            owner = np.repeat(np.arange(len(used_words)), counts)
            ids, scale = words.ids[rows], share[used_words]
            scores = np.stack(
                [np.bincount(owner, crf.grams[ids, y], minlength=len(used_words)) for y in range(k)], axis=1
            ) * scale[:, None] + crf.entry[entry[used_words]]
            pairs = np.zeros((k, k))
            order_in, bounds = by_step(sequence)
            slope = np.empty((len(at), k))
            slope[order_in] = -forward_backward(_exponents(scores)[inverse[order_in]], bounds, crf.step, crf.start, pairs)
            slope[np.arange(len(at)), gold[at]] += 1
            word_slope = np.stack([np.bincount(inverse, slope[:, y], minlength=len(used_words)) for y in range(k)], axis=1)
            climb("entry", np.stack([np.bincount(entry[used_words], word_slope[:, y], minlength=k + 1) for y in range(k)], axis=1))
            word_slope *= scale[:, None]
            climb("grams", np.stack(
                [np.bincount(ids, word_slope[owner, y], minlength=1 << BITS) for y in range(k)], axis=1
            ).astype(np.float32))
            joint = sequence[1:] == sequence[:-1]
            true = np.bincount(gold[at][:-1][joint] * k + gold[at][1:][joint], minlength=k * k).reshape(k, k)
            climb("step", true - pairs)
            heads = np.concatenate([[True], ~joint])
            climb("start", slope[heads].sum(axis=0))
    return crf


def label(crf: Crf, texts: Texts) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n, k = len(texts), len(crf.labels)
    out, score = [UNKNOWN] * n, np.zeros(n)
    if not k:
        return out, score
    words = Words(texts)
    mass = np.zeros((n, k))
    if len(words.of):
        order, bounds = by_step(words.sequence)
        emit = _exponents(crf.emissions(words))[words.word[order]]
        found, of = forward_backward(emit, bounds, crf.step, crf.start), words.of[order]
        mass = np.stack([np.bincount(of, found[:, y], minlength=n) for y in range(k)], axis=1)
    for t in range(n):
        total = mass[t].sum()
        if total > 0 and any(map(str.isalpha, texts.raw(t).decode("utf-8", "replace"))):
            best = int(mass[t].argmax())
            out[t], score[t] = crf.labels[best], min(1.0, mass[t, best] / total)
    return out, score


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, per_label: int = PER_LABEL) -> Crf:
    """The model of a bounded sample: of each language the rows that come first by a hash of doc_id."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(~held_out())
    chosen = first_by_hash(known.select("doc_id", "lang").distinct(), "lang", "doc_id", per_label)
    # per_label rows of each language
    sample = known.join(
        F.broadcast(chosen.select(F.col("doc_id").alias("c_id"), F.col("lang").alias("c_lang"), "pick")),
        (F.col("doc_id") == F.col("c_id")) & (F.col("lang") == F.col("c_lang")),
    )
    # a document that occurs several times is one row
    sample = one_each(sample, ["doc_id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, langs))], pa.binary())], names=["model"])

    ordered = sample.select("text", "lang", "pick", "doc_id").repartition(1).sortWithinPartitions("pick", "doc_id", "text")
    row = ordered.select("text", "lang").mapInArrow(run, "model binary").first()
    return pickle.loads(row.model) if row else Crf([])


def labelled(docs: DataFrame, crf: Crf, carry: list[str]) -> DataFrame:
    """``carry``, lang_pred and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            lang, score = label(sent.value, texts)
            yield with_columns(batch, carry, lang_pred=pa.array(lang, pa.string()), score=score)

    return docs.mapInArrow(run, docs.select(*carry).schema.add("lang_pred", "string").add("score", "double"))


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = docs.select("doc_id", "text", "lang")
    rows = labelled(docs.select("doc_id", "text"), train(docs), ["doc_id"])
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
