import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from soukline.llm import copies, simhash
from soukline.llm.words import Texts

from .conftest import clean


def shingle_set(text):
    words = (text or "").lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k: k + 5]) for k in range(len(words) - 4)}


def brute_groups(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])) and root[a] != root[b]:
                old = root[a]
                root = [root[b] if r == old else r for r in root]
    return [root.index(r) for r in root]


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    out = ["", None, " \t", "a b c", "A b C", "a b c d e", "a b c d", "d c b a"]
    for k in range(40):
        base = clean(k, seed, words=rng.choice([60, 150, 300]))
        out.append(base)
        for _ in range(rng.randrange(4)):
            base = edited(rng, rng.choice([base, out[-1]]), rng.randrange(1, 8))
            out.append(base)
    return out


def test_sets_and_similarity_are_those_of_the_words():
    texts = corpus(1)
    got, want = copies._sets(Texts(pa.array(texts))), [shingle_set(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    full = [k for k, s in enumerate(got) if len(s)]
    for a in full:
        hit = copies.near(got[a], [got[b] for b in full])
        assert hit.tolist() == [5 * len(want[a] & want[b]) >= 4 * len(want[a] | want[b]) for b in full]


def test_near_copies_with_a_few_words_changed_go(documents):
    rng = random.Random(5)
    texts = [clean(1, words=200)] + [edited(rng, clean(1, words=200), 3) for _ in range(12)] + [clean(2, words=200)]
    prints = np.array([simhash.fingerprint(t.encode()) for t in texts[:13]], dtype=np.uint64)
    assert (np.bitwise_count(prints[1:] ^ prints[0]) > simhash.MAX_BITS).any()  # op2 does not link all of them
    kept = simhash.keep_first(documents(list(enumerate(texts)))).collect()
    assert sorted(r.doc_id for r in kept) == [0, 13]


def test_kept_rows_are_the_first_of_brute_force_groups(documents):
    texts = corpus(2)
    kept = simhash.keep_first(documents(list(enumerate(texts)))).collect()
    groups = brute_groups(texts)
    assert sorted(r.doc_id for r in kept) == sorted(set(groups)) and len(set(groups)) < len(texts) - 20


def roots_of(df, texts, bucket_rows):
    rows = df.selectExpr("doc_id", "xxhash64(doc_id) AS h", "text")
    signed = copies.signed(rows, ["doc_id", "h"]).cache()
    classes = signed.groupBy("cls").agg(F.first("bands").alias("bands"), F.min("h").alias("h"))
    linked = simhash.connected(copies.links(rows.select("h", "text"), classes, bucket_rows))
    root = {r.node: r.root for r in linked.collect()}
    found = {r.doc_id: root.get(r.cls, r.cls) for r in signed.collect()}
    first = {}
    return [first.setdefault(found[k], k) for k in range(len(texts))]


def test_large_buckets_give_the_same_links(documents):
    rng = random.Random(11)
    # a group of copies of one text and, in the same buckets, texts that share three quarters and mostly do not link
    base = clean(3, words=120)
    texts = [edited(rng, base, rng.randrange(0, 3)) for _ in range(40)]
    common = clean(4, words=300)
    texts += [common + " " + clean(100 + k, 7, words=95) for k in range(40)]
    texts += [edited(rng, texts[40 + k], 4) for k in range(0, 40, 5)]
    texts += [edited(rng, base, 9) for _ in range(20)] + corpus(12)
    want = brute_groups(texts)
    df = documents([(k, t) for k, t in enumerate(texts)])
    for bucket_rows in (3, 8, 512):
        assert roots_of(df, texts, bucket_rows) == want


def test_many_texts_of_one_template_are_no_quadratic_work(spark):
    # 6,000 texts that share 300 of 400 words meet in most buckets and link with nothing
    template = clean(1, words=300)
    rows = spark.range(6000).selectExpr(
        "id AS doc_id", f"concat('{template} ', array_join(transform(sequence(0, 99), k -> concat('u', id, '_', k)), ' ')) AS text"
    )
    start = time.perf_counter()
    signed = rows.selectExpr("doc_id", "xxhash64(doc_id) AS h", "text")
    classes = copies.signed(signed, ["doc_id", "h"]).groupBy("cls").agg(F.first("bands").alias("bands"), F.min("h").alias("h"))
    assert copies.links(signed.select("h", "text"), copies.cut(classes), 512).count() == 0
    assert time.perf_counter() - start < 150
