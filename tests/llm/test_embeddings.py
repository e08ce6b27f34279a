import math

import numpy as np
import pytest

from soukline.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n long, cid string, node string, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def brute(rows, cosine=0.98):
    """n_links, component, kept of each row, in the rows' order."""
    def usable(r):
        e = r[1]
        return r[2] is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    units = [np.array(r[1], dtype=np.float32).astype(float) if usable(r) else None for r in rows]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    link = [[
        a != b and units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2]
        and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= cosine for b in range(len(rows))
    ] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for b in range(len(rows)):
                if link[x][b] and b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[a][0], sum(link[a]), component, rows[a][0] is not None and rows[a][0] == component))
    return out


def cloud(seed, n, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for k in range(n):
        v = centres[k % 6] + spread * (k % 7) * rng.normal(size=8)
        rows.append((k, [float(x) for x in v], [0, 1, 0][k % 3]))
    rows += [(n + k, rows[3 * k][1], rows[3 * k][2]) for k in range(20)]  # copies
    rows += [(2 * n + k, [2 * x for x in rows[k][1]], rows[k][2]) for k in range(10)]  # same direction
    return rows


@pytest.mark.parametrize("spread, leaf_rows, fanout", [(0.05, 16, 4), (0.0001, 12, 3)])
def test_links_equal_brute_force(spark, spread, leaf_rows, fanout):
    rows = cloud(int(spread * 1000), 150, spread)
    got = embeddings.linked(frame(spark, rows).select("vec_id", "embedding", "label"), leaf_rows=leaf_rows, fanout=fanout)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_odd_rows(spark):
    v = [1.0, 0.0, 0.0]
    rows = [
        (1, v, 0), (2, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 0.0], 0),
        (7, [1.0, math.nan, 0.0], 0), (8, [1.0, math.inf, 0.0], 0), (9, [], 0), (10, [1.0, 0.0], 0), (11, [5.0, 0.0, -0.0], 0),
        (None, [0.0, 1.0, 0.0], 0), (12, [1e-30, 0.0, 0.0], 0), (13, [1e30, 1e28, 0.0], 0), (14, [-1.0, 0.0, 0.0], 0),
    ]
    got = embeddings.op5(frame(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))
    assert embeddings.op5(frame(spark, [])).collect() == []


@pytest.mark.parametrize("spread, fanout", [(0.05, 8), (0.1, 64)])
def test_levels_are_nested_halving_covering_and_apart(spark, spread, fanout):
    rows = cloud(4, 200, spread)
    found = embeddings.classes(frame(spark, rows)).cache()
    members, nodes = embeddings.grow(found, 4, fanout)
    held, tree = members.collect(), {r.node: r for r in nodes.collect()}
    assert len(held) == found.count() == len({m.cid for m in held})
    below = {}
    for m in held:
        unit = np.array(m.unit)
        name = m.node
        while name:  # covering, on every level above a class
            r = tree[name]
            assert np.linalg.norm(unit - np.array(r.centre)) <= (r.radius if name == m.node else 2 * r.radius) + 1e-9
            below.setdefault(name, []).append(unit)
            name = r.parent
    for r in tree.values():
        children = [c for c in tree.values() if c.parent == r.node]
        assert bool(children) != r.leaf
        if children:
            half = 2.0 ** math.ceil(math.log2(r.radius) - 1e-9) / 2
            assert all(c.radius <= half + 1e-9 for c in children)
            centres = [np.array(c.centre) for c in children]
            assert any(np.allclose(c, r.centre) for c in centres)  # nested
            gaps = [np.linalg.norm(a - b) for k, a in enumerate(centres) for b in centres[:k]]
            assert all(g > half - 1e-9 for g in gaps)  # apart
    assert any(not r.leaf for r in tree.values())


def test_a_node_without_structure_stays_a_leaf(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=32)], 0) for k in range(120)]
    _, nodes = embeddings.grow(embeddings.classes(frame(spark, rows)), 10, 16)
    assert [(r.size, r.leaf) for r in nodes.collect()] == [(120, True)]
    got = embeddings.linked(frame(spark, rows).select("vec_id", "embedding", "label"), leaf_rows=10, fanout=16)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))
