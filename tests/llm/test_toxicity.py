import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from soukline.llm import toxicity
from soukline.llm.words import Texts

from .conftest import clean


def held(k):
    return zlib.crc32(str(k).encode()) % 5 == 0


def corpus(spark, documents, n=600):
    rows = [(k, f"{clean(k, words=60)} {'you vile grub' if k % 4 == 0 else ''} {clean(k + 1, words=20)}") for k in range(n)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(0, n, 1)], "doc_id long, quality int, toxic int")
    return documents(rows), labels


def test_held_out_documents_are_told_apart(spark, documents):
    docs, labels = corpus(spark, documents)
    out = toxicity.op1(docs, labels).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    test = [r for r in out if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in test) >= 0.97 * len(test)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(tuple, toxicity.op1(docs, flipped).collect())) == sorted(map(tuple, out))


def test_l1_leaves_few_weights(spark, documents):
    docs, labels = corpus(spark, documents)
    at, w = toxicity.train(docs, labels)
    assert 0 < len(at) < 2000 and np.all(w != 0)


def test_features_are_words_and_pairs_with_gaps():
    ids, of = toxicity.features(Texts(pa.array(["a b, c d", "A-B", "", None, "b c"])))
    assert np.bincount(of, minlength=5).tolist() == [4 + 3 + 2 + 1, 3, 0, 0, 3]
    assert set(ids[of == 1]) <= set(ids[of == 0]) and set(ids[of == 4]) <= set(ids[of == 0])


def test_one_step_follows_the_update_rule():
    learner = toxicity.Ftrl(rate=0.5, smooth=1.0, l1=0.1, l2=1.0)
    learner.learn(np.array([3]), 1, 1.0)
    assert learner.z[3] == -0.5 and learner.n[3] == 0.25
    assert np.isclose(learner.weights(np.array([3]))[0], 0.4 / ((1 + 0.5) / 0.5 + 1))


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(30)] + [(None, 1, 1), (4, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.op1(odd, labels).collect()
    assert len(out) == odd.count() and len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.op1(empty, labels).collect() == []
    assert {r.score for r in toxicity.op1(odd, labels.filter("toxic = 1")).collect()} == {0.0}


def test_a_repeated_document_is_one_learning_row(spark, documents):
    rows = [(k, clean(k)) for k in range(30)]
    docs = documents(rows + [(3, clean(3))] * 3000 + [(3, "other text")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, per_class=4).collect()
    assert len(got) <= 8 and len({r.doc_id for r in got}) == len(got)


M64 = (1 << 64) - 1


def brute_mix(x):
    x ^= x >> 32
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 29
    x = x * 0xA3B195354A39B70D & M64
    return x ^ x >> 32


def brute_ids(text):
    """Coordinates of a text, word by word."""
    words, now = [], b""
    for byte in (text or "").encode() + b" ":
        if byte < 128 and not chr(byte).isalnum():
            words += [now] * bool(now)
            now = b""
        else:
            now += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    base = 0x9E3779B97F4A7C15
    h = [brute_mix((sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(w)) + len(w)) & M64) for w in words]
    out = {x >> 64 - toxicity.BITS for x in h}
    for gap in toxicity.GAPS:
        out |= {brute_mix((a * (2 * gap + 1) + b) & M64) >> 64 - toxicity.BITS for a, b in zip(h, h[gap:])}
    return out


def brute_learn(stream):
    """Weights by coordinate after the stream of (ids, label, weight), one coordinate at a time."""
    z, n = {}, {}
    bias = 1 << toxicity.BITS

    def weight(i):
        l1 = 0.0 if i == bias else toxicity.L1
        live = math.copysign(max(abs(z.get(i, 0.0)) - l1, 0.0), z.get(i, 0.0))
        return -live / ((toxicity.SMOOTH + math.sqrt(n.get(i, 0.0))) / toxicity.RATE + toxicity.L2)

    for ids, label, importance in stream:
        w = {i: weight(i) for i in [*ids, bias]}
        slope = (1 / (1 + math.exp(-sum(w.values()))) - label) * importance
        for i in w:
            before = n.get(i, 0.0)
            n[i] = before + slope * slope
            z[i] = z.get(i, 0.0) + slope - (math.sqrt(n[i]) - math.sqrt(before)) / toxicity.RATE * w[i]
    return {i: weight(i) for i in z}


def test_query_equals_a_loop_in_plain_python(spark, documents):
    bad, fine = "hate ugly stupid kill trash".split(), "river bread house bridge walk".split()
    rows = []
    for k in range(200):
        words = [(bad if k % 3 == 0 else fine)[(k * 7 + j * j) % 5] + str((k + j) % 4) for j in range(25 + k % 9)]
        rows.append((k, " ".join(words).title() + ("!? ünïcode" if k % 5 else "")))
    rows += [(200, None), (201, ""), (202, "Une phrase, neuve: sans mots connus.")]
    docs = documents(rows)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    picked = toxicity.sample(docs, labels)
    orders = [F.xxhash64("pick", F.lit(turn)).alias(f"o{turn}") for turn in range(toxicity.EPOCHS)]
    learning = picked.select("doc_id", "label", "weight", *orders).collect()
    text = dict(rows)
    assert {r.doc_id for r in learning} == {k for k in range(200) if not held(k)}
    stream = [
        (brute_ids(text[r.doc_id]), r.label, r.weight)
        for turn in range(toxicity.EPOCHS) for r in sorted(learning, key=lambda r: (r[f"o{turn}"], r.doc_id))
    ]
    weights = brute_learn(stream)
    bias = weights.get(1 << toxicity.BITS, 0.0)
    for r in toxicity.op1(docs, labels).collect():
        want = 1 / (1 + math.exp(-sum(weights.get(i, 0.0) for i in brute_ids(text[r.doc_id])) - bias))
        assert abs(r.score - want) < 1e-4 and r.predicted == int(r.score >= 0.5) and r.held_out == held(r.doc_id)
