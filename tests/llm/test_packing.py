from collections import defaultdict

from soukline.llm import packing

from .conftest import clean, odd_rows


def brute(rows, capacity):
    """Best-fit by looking at every bin."""
    bins, out = [], {}
    rest = sorted((-(n % capacity), k) for k, (_, _, n, _) in enumerate(rows) if n % capacity)
    for size, k in rest:
        _, source, _, cluster = rows[k]
        fits = [
            (capacity - b["used"], at) for at, b in enumerate(bins)
            if capacity - b["used"] >= -size and (source is None or source not in b["sources"]) and cluster not in b["clusters"]
        ]
        if fits:
            at = min(fits)[1]
        else:
            bins.append({"used": 0, "sources": set(), "clusters": set()})
            at = len(bins) - 1
        out[k] = (at, bins[at]["used"])
        bins[at]["used"] -= size
        bins[at]["sources"].add(source)
        bins[at]["clusters"].add(cluster)
    return out, bins


def test_shard_equals_brute_force():
    rows = [(k, [None, "a", "b", "c", "d"][k * k % 5], 1 + k * 37 % 64, k % 90) for k in range(300)]
    want, bins = brute(rows, 64)
    got = packing.pack_shard(rows, 64)
    used = defaultdict(list)
    for doc_id, _, _, _, n, b, offset in got:
        used[b].append((offset, n))
    assert sorted(sum(n for _, n in v) for v in used.values() if v[0][1] < 64) == sorted(b["used"] for b in bins if b["used"])
    place = {r[0]: r[6] for r in got}
    assert all(place[k] == offset for k, (_, offset) in want.items())


def check(rows, capacity, sources, clusters, sizes):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.bin_id is not None:
            by_bin[r.bin_id].append(r)
    for doc_id, size in sizes.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert sum(r.n_words for r in pieces) == size
        at = 0
        for r in pieces:
            assert r.start_word == at
            at += r.n_words
    for held in by_bin.values():
        held.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in held:
            assert r.bin_offset == at
            at += r.n_words
        assert at <= capacity
        named = [sources[r.doc_id] for r in held if sources[r.doc_id] is not None]
        assert len(named) == len(set(named))
        assert len({clusters[r.doc_id] for r in held}) == len(held)


def test_bins_hold_no_conflicts(documents):
    rows = [(k, clean(k % 150, words=20 + k % 130), "en", None if k % 11 == 0 else f"s{k % 4}") for k in range(400)]
    out = packing.packed(documents(rows), capacity=100, shard_rows=64).collect()
    check(out, 100, {r[0]: r[3] for r in rows}, {r[0]: r[1] for r in rows}, {r[0]: len(r[1].split()) for r in rows})
    again = packing.packed(documents(rows), capacity=100, shard_rows=64).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_odd_rows(odd, empty):
    out = packing.packed(odd).collect()
    assert sum(r.n_words for r in out) == sum(len((t or "").encode().split()) for _, t, *_ in odd_rows())
    assert {r.doc_id for r in out if r.bin_id is None} == {1, 2, 3}
    twins = [r.bin_id for r in out if r.doc_id in (20, 21, 22)]
    assert len(twins) == 5 == len(set(twins))
    assert len([r for r in out if r.doc_id == 6 and r.n_words == packing.CAPACITY]) == 120_000 // packing.CAPACITY
    assert packing.packed(empty).collect() == []


def test_shards_do_not_depend_on_shuffle_partitions(spark, documents):
    docs = documents([(k, clean(k, words=20 + k % 130), "en", f"s{k % 7}") for k in range(400)])
    key, found = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    try:
        for n in (3, 50):
            spark.conf.set(key, str(n))
            found.append(sorted(map(tuple, packing.packed(docs, capacity=200).collect()), key=str))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] and {r[5].rsplit("-", 1)[0] for r in found[0]} == {"0-0"}


def test_equal_rows_are_packed_in_parts(documents):
    out = packing.packed(documents([(1, clean(1, words=30), "en", None)] * 100), capacity=100, shard_rows=16).collect()
    parts = [r.bin_id.rsplit("-", 1)[0] for r in out]
    assert len(out) == len({r.bin_id for r in out}) == 100 and max(map(parts.count, set(parts))) < 32


def test_near_copies_go_to_different_bins(documents):
    words = clean(1, words=60).split()
    rows = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1:]]), "en", f"s{k}") for k in range(1, 5)]
    rows += [(k, clean(k, words=60), "en", f"t{k}") for k in range(5, 9)]
    out = {r.doc_id: r.bin_id for r in packing.packed(documents([(0, " ".join(words), "en", "s0"), *rows])).collect()}
    assert len({out[k] for k in range(5)}) == 5 and len(set(out.values())) == 5
