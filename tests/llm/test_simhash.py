import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from soukline.llm import copies, simhash
from soukline.llm.common import connected, cut

from .conftest import clean, odd_rows


def brute_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k: k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashed = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_components(values):
    values = list(values)
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_fingerprints_on_odd_rows(odd):
    got = sorted((str(r.doc_id), r.fingerprint) for r in simhash.op2(odd).collect())
    assert got == sorted((str(i), f"{brute_fingerprint(t):016x}") for i, t, *_ in odd_rows())


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def cloud(seed, n):
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(40)}
    centre = rng.getrandbits(64)
    while len(values) < n:
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
        values.add(centre ^ flips)
    return values


def test_links_have_the_components_of_all_pairs(spark):
    for seed, bound in ((1, 2048), (2, 8)):
        values = cloud(seed, 160)
        df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
        got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in connected(simhash.links(df, bound)).collect()}
        want = brute_components(values)
        groups = {}
        for v in values:
            groups.setdefault(want[v], set()).add(v)
        found = {}
        for v in values:
            found.setdefault(got.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_forest_links_are_true_links():
    values = np.array(sorted(cloud(3, 300)), dtype=np.uint64)
    a, b = simhash.forest(values)
    want = brute_components(values.tolist())
    assert all(want[x] == want[y] for x, y in zip(a.tolist(), b.tolist()))


def test_components_on_chains_stars_and_repeats(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (1, 0), (-5, 200)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 140), 100), -5: -5, 200: -5}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_row_of_each_group_stays(odd, empty, documents):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(20) == 1 and 21 not in ids and 22 not in ids and 6 in ids and None in ids
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids
    assert simhash.keep_first(empty).collect() == [] and simhash.op2(empty).collect() == []
    copies = documents([(k, clean(1)) for k in range(60)] + [(100 + k, clean(k + 2)) for k in range(20)])
    assert sorted(r.doc_id for r in simhash.keep_first(copies).collect()) == [0, *range(100, 120)]


def shingle_set(text):
    words = text.split()
    return {tuple(words[k: k + 5]) for k in range(len(words) - 4)}


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_links_by_fingerprints_are_near_and_miss_few(documents):
    rng = random.Random(3)
    texts = [clean(k, 5, words=200) for k in range(60)]
    texts += [edited(rng, t, 1 + k // 50) for k, t in enumerate(texts)] + ["", "a b", "a c"]
    docs = documents(list(enumerate(texts))).selectExpr("doc_id", "doc_id AS h", "text")
    signed = cut(simhash.signed(docs, ["doc_id", "h"]))
    classes = cut(signed.groupBy("cls").agg(F.first("bands").alias("bands"), F.first("prints").alias("prints"), F.min("h").alias("h")))
    number = {r.cls: r.doc_id for r in signed.collect()}
    got = {tuple(sorted((number[r.a], number[r.b]))) for r in simhash.near_links(docs, classes).collect()}
    sets = [shingle_set(t) for t in texts]
    want = {
        (a, b) for b in range(len(texts)) for a in range(b)
        if sets[a] | sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    }
    assert got <= want and len(want) > 40 and len(got) >= 0.9 * len(want)


def test_near_copies_go_by_fingerprints_alone(documents, monkeypatch):
    # no buckets of minimum hashes: what goes is found by SimHash
    monkeypatch.setattr(copies, "buckets", lambda classes: classes.selectExpr("cls AS key", "cls", "true AS open").limit(0))
    rng = random.Random(4)
    texts = [clean(1, 5, words=300)] + [edited(rng, clean(1, 5, words=300), 1) for _ in range(100)]
    texts += [clean(k, 5, words=300) for k in range(2, 22)]
    kept = simhash.keep_first(documents(list(enumerate(texts)))).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(101, len(texts))]


def test_components_are_those_of_a_search_on_random_edges(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)]
        edges += [(500, k) for k in range(300, 340)] + edges[:20]  # a hub that is greater than its neighbours
        root = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in range(len(root)):
            for a, b in edges:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        rows = connected(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.root for r in rows} == root and len(rows) == len(root)


def stages(spark, group, work):
    """The number of stages of ``work``'s jobs."""
    spark.sparkContext.setJobGroup(group, group)
    work()
    tracker = spark.sparkContext.statusTracker()
    found = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("other", "other")
    return len(found)


def test_the_work_takes_few_stages(spark, documents):
    # each shuffle costs files of every task however few its rows are; these took most of the disk on check_h
    rng = random.Random(6)
    base = clean(1, 5, words=200)
    texts = [base] + [edited(rng, base, rng.randrange(1, 4)) for _ in range(60)] + [clean(k, 5, words=200) for k in range(2, 42)]
    chain = cut(spark.range(1, 64).selectExpr("id AS a", "id - 1 AS b"))
    # 99 and 178 when this was written, 138 and 308 before
    assert stages(spark, "chain", lambda: connected(chain).collect()) <= 115
    docs = cut(documents(list(enumerate(texts))))
    assert stages(spark, "stage", lambda: simhash.keep_first(docs).collect()) <= 220
