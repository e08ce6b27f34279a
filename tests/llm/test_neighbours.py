import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from soukline.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, cid string, code string, rep string, q string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "x", "x", "x", 0) for r in rows], SCHEMA).repartition(3)


def usable(e):
    return e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e)


def brute(rows, every=20, top=20):
    """(query_id, rank, vec_id, score) of every query row, exactly."""
    good = [(i, np.array(e, dtype=np.float32).astype(float)) for i, e in rows if usable(e)]
    out = []
    for k, (i, v) in enumerate(good):
        if i is None or i % every:
            continue
        all_ = [(-float(np.einsum("i,i->", v, w)), math.inf if j is None else j) for n, (j, w) in enumerate(good) if n != k and len(w) == len(v)]
        out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(sorted(all_)[:top])]
    return out


def told(df):
    return [(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()]


def same(got, want):
    key = lambda r: (r[0], r[1], r[3], math.inf if r[2] is None else r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(a[3], b[3], rel_tol=1e-12, abs_tol=1e-12) for a, b in zip(got, want))


def recall(got, want):
    found = {(q, v) for q, _, v, _ in got}
    return sum((q, v) in found for q, _, v, _ in want) / max(1, len(want))


def cloud(seed, n, dim, spread=0.3, unit=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    points = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    points = points / np.linalg.norm(points, axis=1, keepdims=True) if unit else points * rng.uniform(0.2, 3, (n, 1))
    return [(k, [float(x) for x in p]) for k, p in enumerate(points)]


@pytest.mark.parametrize("seed, dim, spread, unit", [(1, 16, 0.3, True), (2, 64, 5.0, True), (3, 80, 0.5, False)])
def test_recall_against_brute_force(spark, seed, dim, spread, unit):
    rows = cloud(seed, 1500, dim, spread, unit)
    got, want = told(neighbours.op11(frame(spark, rows))), brute(rows)
    assert recall(got, want) >= 0.9
    scores = {(i, j): None for i, _, j, _ in got}
    assert len(scores) == len(got)
    points = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows}
    assert all(math.isclose(s, points[i] @ points[j], rel_tol=1e-12, abs_tol=1e-12) for i, _, j, s in got)
    ranks = {}
    for i, r, j, s in sorted(got):
        ranks.setdefault(i, []).append((-s, j))
    assert all(v == sorted(v) for v in ranks.values())


@pytest.mark.parametrize("reach, block", [(64, 4096), (20, 60), (9, 40), (3, 4096)])
def test_every_code_within_the_radius_is_retrieved(spark, reach, block, monkeypatch):
    rows = cloud(5, 500, 12, 0.4)
    df = frame(spark, rows)
    found = neighbours.cut(neighbours.classes(df))
    model = neighbours.fit(found)
    ids = df.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    table = neighbours.cut(neighbours.coded(found.join(ids, "embedding").withColumnRenamed("vec_id", "rep"), model))
    asked = table.filter("rep % 20 = 0").drop("rep")
    held = {r.cid: (r.code, np.array(r.embedding), r.rep) for r in table.collect()}
    want = set()
    for q in asked.collect():
        near = [
            (-float(np.einsum("i,i->", np.array(q.embedding), v)), rep, c) for c, (code, v, rep) in held.items()
            if ((code ^ q.code) % (1 << 64)).bit_count() <= reach
        ]
        want |= {(q.cid, c) for *_, c in sorted(near)[:7]}
    for s in (4, 8, 16):
        if neighbours._ball(s, reach // (64 // s)) > neighbours.PROBES:
            continue
        monkeypatch.setattr(neighbours, "substring_bits", lambda n, r, s=s: s)
        for some in (asked, neighbours.floored(asked, table.limit(200), reach, model.width, 7)):
            got = neighbours.nearest(table, some, 500, reach, model.width, 7, block)
            assert {(r.q, r.c) for r in got.collect()} == want


def test_substrings_follow_the_radius_and_the_rows():
    assert neighbours.substring_bits(50_000, 29) == 8 and neighbours.substring_bits(10**9, 5) in (16, 32)
    assert neighbours.substring_bits(10, 64) == 4


def test_odd_rows_are_exact(spark):
    v = [1.0, 0.0, 0.0]
    rows = [
        (0, v), (0, v), (20, v), (21, v), (20, [0.5, 0.5, 0.0]), (None, v), (3, None), (40, []), (60, [0.0, 0.0, 0.0]),
        (80, [1.0, None, 0.0]), (100, [1.0, math.nan, 0.0]), (120, [math.inf, 0.0, 0.0]), (140, [1.0, 2.0]), (5, [3.0, 1.0]),
        (6, [2.0, -0.0, 0.0]), (160, [1e30, 1.0, 1.0]), (7, [-1.0, 0.0, 0.0]), (180, [7.0]), (None, None),
    ]
    same(told(neighbours.op11(frame(spark, rows))), brute(rows))
    assert told(neighbours.op11(frame(spark, []))) == []
    assert told(neighbours.op11(frame(spark, [(1, v), (2, v)]))) == []


def test_hot_vectors_and_ties(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(120)] + [(200 + k, [float(k % 3), 1.0, 0.0]) for k in range(90)]
    same(told(neighbours.op11(frame(spark, rows))), brute(rows))
