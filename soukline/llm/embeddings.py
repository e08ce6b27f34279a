"""Embedding near-duplicates by a distributed cover tree and its dual traversal.

Cosine >= 0.98 of unit vectors is a chord of at most REACH. Equal vectors (same label) are one class first, so copies
cost nothing. Per label and dimension the classes form a cover tree over the radii 2, 1, 1/2, 1/4, ...: a node of
radius r, the least of these that covers its classes, has children of radius r / 2. The levels are nested (the first child
has the node's own centre), children's centres are more than r / 2 apart, and every class of a child is within r / 2 of its
centre. Centres are found farthest first in a bounded sample of the node; classes that these leave uncovered give further
centres in ROUNDS rounds. A node that FANOUT centres do not cover has no structure at this scale, and stays a leaf, like
one of at most LEAF_ROWS classes. Every node keeps its true covering radius. The dual traversal starts with each
root paired with itself and, level by level, drops pairs of nodes whose covering balls are more than REACH apart, takes
pairs that lie within REACH as a whole (counts only, no distances), and replaces the rest by the pairs of their
children. Pairs of leaves are compared vector by vector in one matrix product per pair of blocks, which leaves counts
and a spanning forest of the links, never the links themselves. All of it is exact.

Vectors without structure (nearly orthogonal, all within one radius) cannot be pruned by any covering bound; then every
pair of leaves of a label is compared, as the exact answer asks for.

Defined results: null labels, null or empty or zero vectors and those with null or non-finite components have no links.
Vectors of different length never link. Repeated rows link with each other. Without a vec_id in a component its id is
null and its rows are not kept. An empty table gives an empty result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukline.llm.common import connected, cut

COSINE = 0.98
REACH = math.sqrt(2 - 2 * COSINE)
SLACK = 1e-9
LEAF_ROWS = 2048
FANOUT = 256
SAMPLE = 4096
ROUNDS = 3
LEVELS = 12
# Rows of a node that meet its centres in one task.
TASK_ROWS = 8192

NODE = "node string, parent string, centre array<double>, radius double, size long, weight long, leaf boolean"


def classes(vectors: DataFrame) -> DataFrame:
    """(label, embedding, cid, rep, weight): one row per different usable vector of a label."""
    return (
        vectors.filter(_usable()).select("vec_id", "label", _plain().alias("embedding"))
        .groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        .withColumn("cid", _class_id(F.col("embedding")))
    )


def _usable() -> Column:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0)
    return F.coalesce(usable, F.lit(False))


def _plain() -> Column:
    """Components as doubles, without a negative zero."""
    return F.transform("embedding", lambda x: x.cast("double") + 0.0)


def _class_id(plain: Column) -> Column:
    return F.xxhash64("label", F.size(plain), plain)


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.array(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(values), -1)
    flat /= np.abs(flat).max(axis=1, keepdims=True, initial=1e-300)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _net(centre: np.ndarray, points: np.ndarray, goal: float, fanout: int, first: bool) -> np.ndarray | None:
    """Centres, more than ``goal`` apart, that leave no point farther than ``goal``: farthest first; None if over ``fanout``.

    The node's own centre is the first of them in the first round; later rounds have points that no centre covers.
    """
    picked = [centre if first else points[0]]
    gap = np.linalg.norm(points - picked[0], axis=1)
    while len(gap) and gap.max() > goal:
        if len(picked) == fanout:
            return None
        picked.append(points[int(gap.argmax())])
        gap = np.minimum(gap, np.linalg.norm(points - picked[-1], axis=1))
    return np.array(picked)


def _nets(pending: DataFrame, fanout: int, turn: int) -> DataFrame:
    """(node, size, centres) of each node of ``pending`` (node, cid, unit, goal, centre) that a net covers as far as a sample shows."""
    sizes = pending.groupBy("node").agg(F.count("*").alias("size"))
    # about SAMPLE classes of each node, by their digest; the digest spreads evenly
    share = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    some = pending.join(sizes, "node").filter(share * F.col("size") <= SAMPLE)

    def choose(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("cid")
        head = sample.slice(0, 1).to_pylist()[0]
        net = _net(np.array(head["centre"]), _unit(sample.column("unit")), head["goal"], fanout, turn == 0)
        schema = pa.schema([("node", pa.string()), ("size", pa.int64()), ("centres", pa.list_(pa.list_(pa.float64())))])
        found = [(head["node"], head["size"], net.tolist())] if net is not None else []
        return pa.Table.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema=schema)

    return some.groupBy("node").applyInArrow(choose, "node string, size long, centres array<array<double>>")


ASSIGNED = "cid long, node string, unit array<double>, weight long, goal double, centre array<double>, child int, away double"


def _assigned(pending: DataFrame, nets: DataFrame) -> DataFrame:
    """ASSIGNED: each class with its nearest centre's number and distance; child is null where that is over the goal.

    A node's centres come once before its classes in a sorted stream, per task; large nodes are dealt over several tasks.
    """
    salts = F.greatest(F.lit(1), F.ceil(F.col("size") / TASK_ROWS)).cast("int")
    none = F.lit(None)
    rows = pending.join(nets.select("node", "size"), "node").select(
        "node", F.pmod(F.xxhash64("cid", F.lit(2)), salts).cast("int").alias("salt"), F.lit(1).alias("side"), "cid", "unit", "weight",
        "goal", "centre", none.cast("array<array<double>>").alias("centres"),
    )
    heads = nets.select(
        "node", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("side"), none.cast("long").alias("cid"),
        none.cast("array<double>").alias("unit"), none.cast("long").alias("weight"), none.cast("double").alias("goal"),
        none.cast("array<double>").alias("centre"), "centres",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.zeros((0, 0))
        for batch in batches:
            side = batch.column(2).to_numpy()
            # a run ends before each head
            ends = [*np.flatnonzero(side == 0).tolist(), batch.num_rows]
            begin = 0
            for end in ends:
                piece = batch.slice(begin, end - begin)
                begin = end + 1
                if piece.num_rows:
                    unit = _unit(piece.column(4))
                    gaps = np.sqrt(np.maximum(0, 2 - 2 * unit @ points.T))
                    near = gaps.argmin(axis=1)
                    away = np.linalg.norm(unit - points[near], axis=1)
                    child = pa.array(near.astype(np.int32), mask=away > piece.column(6).to_numpy())
                    yield pa.RecordBatch.from_arrays(
                        [*(piece.column(k) for k in (3, 0, 4, 5, 6, 7)), child, pa.array(away)],
                        names=["cid", "node", "unit", "weight", "goal", "centre", "child", "away"],
                    )
                if end < batch.num_rows:
                    points = np.array(batch.column(8)[end].as_py(), dtype=np.float64)

    dealt = rows.union(heads).repartition("node", "salt").sortWithinPartitions("node", "salt", "side")
    return dealt.mapInArrow(run, ASSIGNED)


def _split(rows: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """(children, centres): the classes of each node of ``rows`` that is covered whole, in its children, and these' centres.

    ``rows`` has cid, node, unit, weight, goal and centre. Nodes that are not covered have no rows here.
    """
    pending, found, nets = rows, None, None
    for turn in range(ROUNDS):
        net = cut(_nets(pending, fanout, turn))
        told = cut(_assigned(pending, net))
        number = F.col("child") + turn * fanout
        near = told.filter("child IS NOT NULL").withColumn("child", number)
        points = net.select("node", F.posexplode("centres").alias("child", "point")).withColumn("child", number)
        found = near if found is None else found.union(near)
        nets = points if nets is None else nets.union(points)
        pending = told.filter("child IS NULL").select("cid", "node", "unit", "weight", "goal", "centre")
        if pending.isEmpty():
            break
    name = F.concat_ws(".", "node", "child")
    # nodes of which some class has no centre: left over in the end, or dropped without a net
    counts = found.groupBy("node").agg(F.count("*").alias("covered"))
    whole = rows.groupBy("node").agg(F.count("*").alias("all")).join(counts, "node").filter("covered = all").select("node")
    whole = cut(whole)
    children = found.join(whole, "node", "left_semi").select("cid", name.alias("node"), "unit", "away", "weight")
    centres = nets.join(whole, "node", "left_semi").select(name.alias("node"), F.col("point").alias("centre"))
    return cut(children), centres


def grow(found: DataFrame, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(members, nodes) of the trees: (cid, node, unit, weight) with each class's leaf, and one row per node."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x / np.abs(x).max() for x in (np.array(v, dtype=np.float64) for v in batch.column(2).to_pylist())]
            unit = pa.array([x / np.linalg.norm(x) for x in lists], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), unit, batch.column(3)], names=["cid", "node", "unit", "weight"]
            )

    root = F.concat_ws("/", "label", F.size("embedding"))
    schema = "cid long, node string, unit array<double>, weight long"
    rows = found.select("cid", root.alias("node"), "embedding", "weight").mapInArrow(units, schema)
    rows = cut(rows.withColumn("away", F.lit(2.0)))
    centres = rows.groupBy("node").agg(F.min_by("unit", "cid").alias("centre"))
    nodes, members = None, None
    for level in range(LEVELS + 1):
        stats = rows.groupBy("node").agg(
            F.max("away").alias("radius"), F.count("*").alias("size"), F.sum("weight").alias("weight")
        )
        large = (F.col("size") > leaf_rows) & (F.col("radius") > REACH / 4) & F.lit(level < LEVELS)
        parent = F.regexp_extract("node", r"^(.*)\.\d+$", 1)
        here = cut(
            stats.join(centres, "node").select("node", parent.alias("parent"), "centre", "radius", "size", "weight", large.alias("large"))
        )
        open_nodes = here.filter("large")
        if open_nodes.isEmpty():
            split = None
        else:
            # half of the least of 2, 1, 1/2, ... that is no less than the true radius
            goal = F.pow(F.lit(2.0), F.ceil(F.log2("radius") - SLACK)) / 2
            split, next_centres = _split(
                rows.join(open_nodes.select("node", "centre", goal.alias("goal")), "node")
                .select("cid", "node", "unit", "weight", "goal", "centre"), fanout,
            )
        if split is not None:
            inner = cut(split.select(F.regexp_extract("node", r"^(.*)\.\d+$", 1).alias("node")).distinct())
            here = cut(here.join(inner.withColumn("split", F.lit(True)), "node", "left"))
            leaf = F.col("split").isNull()
        else:
            leaf = F.lit(True)
        here = here.select("node", "parent", "centre", "radius", "size", "weight", leaf.alias("leaf"))
        nodes = here if nodes is None else nodes.union(here)
        done = rows.join(here.filter("leaf").select("node"), "node", "left_semi").select("cid", "node", "unit", "weight")
        members = done if members is None else members.union(done)
        if split is None or split.isEmpty():
            break
        rows, centres = split, next_centres
    return members, cut(nodes)


def traverse(nodes: DataFrame, reach: float = REACH) -> tuple[DataFrame, DataFrame]:
    """(whole, near): node pairs (a, b), a <= b, all of whose classes link, and pairs of leaves left to compare."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ra, rb, ca, cb, la, lb = (c.to_pylist() for c in batch.columns)
            gap = np.array([np.linalg.norm(np.subtract(x, y)) for x, y in zip(ca, cb, strict=True)])
            both = np.array(ra, dtype=float) + np.array(rb, dtype=float)
            same = np.array(a) == np.array(b)
            says = np.where(
                gap - both > reach + SLACK, "apart",
                np.where(np.where(same, 2 * np.array(ra, dtype=float), gap + both) < reach - SLACK, "whole",
                         np.where(np.array(la) & np.array(lb), "near", "open")),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), pa.array(says.tolist(), pa.string())], names=["a", "b", "says"]
            )

    kept = ["node", "centre", "radius", "leaf"]
    pairs = nodes.filter("parent = ''").select(F.col("node").alias("a"), F.col("node").alias("b"))
    out = None
    # an open node's children; a leaf stands for itself
    children = nodes.filter("parent <> ''").select("parent", "node").union(
        nodes.filter("leaf").select(F.col("node").alias("parent"), "node")
    )
    for _ in range(2 * LEVELS + 2):
        left = nodes.select(*[F.col(c).alias(f"a_{c}") for c in kept])
        right = nodes.select(*[F.col(c).alias(f"b_{c}") for c in kept])
        full = pairs.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node"))
        told = cut(
            full.select("a", "b", "a_radius", "b_radius", "a_centre", "b_centre", "a_leaf", "b_leaf")
            .mapInArrow(judge, "a string, b string, says string")
        )
        ends = told.filter("says IN ('whole', 'near')")
        out = ends if out is None else out.union(ends)
        wide = told.filter("says = 'open'")
        if wide.isEmpty():
            break
        x = children.select(F.col("parent").alias("a"), F.col("node").alias("x"))
        y = children.select(F.col("parent").alias("b"), F.col("node").alias("y"))
        pairs = wide.join(x, "a").join(y, "b").filter("a <> b OR x <= y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")
        )
    out = cut(out)
    return out.filter("says = 'whole'").select("a", "b"), out.filter("says = 'near'").select("a", "b")


def _ancestors(members: DataFrame) -> DataFrame:
    """(cid, weight, up): each class with every node above it, its leaf included."""
    steps = F.size(F.split("node", r"\."))
    ups = F.transform(F.sequence(F.lit(1), steps), lambda k: F.concat_ws(".", F.slice(F.split("node", r"\."), F.lit(1), k)))
    return members.select("cid", "weight", F.explode(ups).alias("up"))


def _of_whole(members: DataFrame, nodes: DataFrame, whole: DataFrame) -> DataFrame:
    """(cid, n, other): links of classes in node pairs that link as a whole, and one class to be connected with."""
    above = _ancestors(members)
    first = above.join(whole.select(F.col("a").alias("up")).union(whole.select(F.col("b").alias("up"))).distinct(), "up")
    first = first.groupBy("up").agg(F.min("cid").alias("other"), F.sum("weight").alias("n"))
    sides = whole.select(F.col("a").alias("up"), F.col("b").alias("across")).union(
        whole.filter("a <> b").select(F.col("b").alias("up"), F.col("a").alias("across"))
    )
    told = sides.join(first.withColumnRenamed("up", "across"), "across")
    rows = above.join(told, "up")
    # a class does not link with itself; its copies are counted with the class
    own = F.when(F.col("up") == F.col("across"), F.col("weight")).otherwise(0)
    return rows.select("cid", (F.col("n") - own).alias("n"), "other")


def _of_leaves(members: DataFrame, nodes: DataFrame, near: DataFrame, cosine: float, block: int) -> DataFrame:
    """(cid, n, other) for pairs of leaves, compared vector by vector in blocks of at most ``block`` classes."""
    sizes = nodes.filter("leaf").select("node", "size")
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / block))
    dealt = members.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), parts)).drop("size")
    dealt = cut(dealt)
    parts = dealt.select("node", "part").distinct()
    a = parts.select(F.col("node").alias("a"), F.col("part").alias("pa"))
    b = parts.select(F.col("node").alias("b"), F.col("part").alias("pb"))
    pairs = near.join(a, "a").join(b, "b").filter("a <> b OR pa <= pb")
    pairs = cut(pairs.withColumn("pair", F.concat_ws("|", "a", "pa", "b", "pb")))
    same = (F.col("a") == F.col("b")) & (F.col("pa") == F.col("pb"))
    left = pairs.select("pair", F.col("a").alias("node"), F.col("pa").alias("part"), F.when(same, 2).otherwise(0).alias("side"))
    right = pairs.filter(~same).select("pair", F.col("b").alias("node"), F.col("pb").alias("part"), F.lit(1).alias("side"))
    rows = dealt.join(left.union(right), ["node", "part"]).select("pair", "side", "cid", "unit", "weight")

    def work(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        cid, weight, unit = table.column("cid").to_numpy(), table.column("weight").to_numpy(), _unit(table.column("unit"))
        x = np.flatnonzero(side != 1)
        y = x if side.max() == 2 else np.flatnonzero(side == 1)
        links = unit[x] @ unit[y].T >= cosine
        if y is x:
            np.fill_diagonal(links, False)
        n = np.zeros(len(cid), dtype=np.int64)
        n[x] = links @ weight[y]
        if y is not x:
            n[y] = weight[x] @ links
        other = _forest(len(cid), x, y, links)
        hit = n > 0
        return pa.table({"cid": cid[hit], "n": n[hit], "other": cid[other[hit]]})

    return rows.groupBy("pair").applyInArrow(work, "cid long, n long, other long")


def _forest(n: int, x: np.ndarray, y: np.ndarray, links: np.ndarray) -> np.ndarray:
    """For each of n points one point of its component, the same for all of it."""
    root = np.arange(n)
    while True:
        low = root.copy()
        for near, far, m in ((x, y, links), (y, x, links.T)):
            some = m.any(axis=1)
            best = np.where(m[some], root[far][None, :], n).min(axis=1)
            np.minimum.at(low, near[some], best)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def linked(vectors: DataFrame, cosine: float = COSINE, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    found = cut(classes(vectors))
    members, nodes = grow(found, leaf_rows, fanout)
    whole, near = traverse(nodes, math.sqrt(2 - 2 * cosine))
    hits = cut(_of_whole(members, nodes, whole).union(_of_leaves(members, nodes, near, cosine, leaf_rows)))
    roots = connected(hits.select(F.col("cid").alias("a"), F.col("other").alias("b")))
    counts = hits.groupBy("cid").agg(F.sum("n").alias("n"))
    each = found.select("cid", "rep", "weight").join(counts, "cid", "left").join(
        roots.select(F.col("node").alias("cid"), "root"), "cid", "left"
    ).withColumn("root", F.coalesce("root", "cid"))
    least = each.groupBy("root").agg(F.min("rep").alias("least"))
    each = each.join(least, "root").select("cid", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "least")
    rows = vectors.withColumn("cid", F.when(_usable(), _class_id(_plain()))).join(each, "cid", "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return rows.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op5(vectors: DataFrame) -> DataFrame:
    return linked(vectors.select("vec_id", "embedding", "label"))


ORACLE = """
WITH RECURSIVE usable AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM usable),
pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM unit x JOIN unit y ON x.label = y.label AND x.r <> y.r AND len(x.e) = len(y.e)
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
  vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN links ON links.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
