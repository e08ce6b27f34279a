from collections import defaultdict

import pytest

from soukline.llm import mixing

from .conftest import clean, odd_rows


def brute_targets(sizes):
    """Shares by weight; the excess over twice a source is shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, left, open_ = {}, 1.5 * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            goal.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            open_.remove(s)
    return goal


def rows_for(n):
    return [(k, clean(k, words=1 + k * 13 % 90), "en", ["big", "big", "a", "é", None, f"t{k % 5}"][k % 6]) for k in range(n)]


def test_targets_and_taken(documents):
    rows = rows_for(900)
    out = mixing.op9(documents(rows)).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    goal = brute_targets(sizes)
    source = {r[0]: r[3] for r in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
    for s in goal:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.op9(documents(rows)).collect()))


def test_ranges_do_not_change_the_sample(documents):
    docs = mixing.keyed(documents(rows_for(500)).select("doc_id", "source", "text")).selectExpr("doc_id", "source", "size", "key", "0L AS h").cache()
    taken = [
        sorted(map(tuple, mixing.placed(docs, docs, mixing.plan(docs, n), n).select("doc_id", "copies").collect()))
        for n in (1, 7, 1024)
    ]
    assert taken[0] == taken[1] == taken[2] and {n for _, n in taken[0]} == {0, 1, 2}


@pytest.mark.parametrize("words", [1, 400])
def test_no_range_of_a_source_is_large(documents, words):
    docs = documents([(k, " ".join(["x"] * words), "en", "a") for k in range(4000)])
    parts = mixing.keyed(docs).select(mixing.range_of(64).alias("part")).groupBy("part").count().collect()
    assert max(r["count"] for r in parts) < 4000 / 64


def test_better_documents_are_taken_more_often(documents):
    whole = [(1, clean(1, words=90_000), "en", "a"), (2, clean(2, words=90_000), "en", "b")]
    mixed = [(10 + k, clean(k, words=200) if k % 2 else " ".join(["x"] * 200), "en", "c") for k in range(600)]
    out = {r.doc_id: r.taken // r.size for r in mixing.op9(documents(whole + mixed)).collect()}
    taken = [out[10 + k] for k in range(600)]
    assert sum(taken[1::2]) > 1.3 * sum(taken[::2])


def test_odd_rows(odd, empty):
    out = mixing.op9(odd).collect()
    assert len(out) == len(odd_rows())
    assert all(r.size == 0 and r.taken == 0 for r in out if r.doc_id in (1, 2, 3))
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns
    times = defaultdict(int)
    for r in mix.collect():
        times[r.doc_id] += 1
    taken = defaultdict(int)
    for r in out:
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    assert dict(times) == {k: v for k, v in taken.items() if v}
    assert mixing.op9(empty).collect() == [] and mixing.mixed(empty).collect() == []


@pytest.mark.parametrize("few", [1 << 16, 0])
def test_repeated_rows_are_taken_as_far_as_they_fit(documents, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    docs = documents([(1, "two words", "en", "a")] * 1000 + [(2, "word", "en", "a")] + [(3, "x y z", k, None) for k in ("en", "de", "fr")] * 5)
    out = mixing.op9(docs).collect()
    for source, ids in (("a", (1, 2)), (None, (3,))):
        rows = [r for r in out if r.doc_id in ids]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 3
        assert all(r.taken <= 2 * r.size for r in rows)
    taken = sorted((r.doc_id, r.taken // r.size) for r in out)
    mix = mixing.mixed(docs).collect()
    assert len(mix) == sum(n for _, n in taken)
    # rows of one document that differ elsewhere: the same ones are taken in every run
    assert sorted(map(str, mix)) == sorted(map(str, mixing.mixed(docs.repartition(7)).collect()))
