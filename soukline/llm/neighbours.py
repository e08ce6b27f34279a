"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

Largest inner product becomes smallest angle by one more component, sqrt(M^2 - |x|^2), M being the longest vector's length
(zero for queries). A principal-component basis and rotations that are fitted to it by iterative quantization turn a
vector into a code of BITS signs; they are learned from at most SAMPLE vectors, everything else covers all rows.

The radius is learned, too: the neighbours of at most PILOTS query vectors are found by a full comparison (one pass over the
rows, in blocks), and RADIUS_SHARE of them lie within the radius in code bits. It follows the density of the rows.

A code has BITS / s substrings of s bits. Two codes within the radius agree in one of them but for t = radius // substrings
bits (pigeonhole), so a query probes, in each substring's index, the ball of radius t around its own value. Index entries
of neighbouring values are one cell, cells are split in blocks of BLOCK rows by a hash, and each block compares its
queries and rows by array operations: whole codes first, floats of what lies within the radius then. Of each query and
block the best TOP + 1 leave, never pairs, and none below a floor that a look at SAMPLE rows gives each query. A pair met in several substrings is taken in the first that has it. s follows
from the number of rows; any s gives the same result. Vectors without structure (nearly orthogonal) have a large radius,
and a query then meets a large part of the rows, as an exact answer would ask for.

Equal vectors are one class (rows of a class need no comparison); of its rows the TOP + 1 with the least ids can be among a
query's nearest, and only these are carried. Queries with equal vectors are searched for once. Scores are dot products of
the vectors themselves, summed in double precision in one fixed order, so equal vectors tie exactly.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of
different length have no inner product: each length is searched by itself. Repeated query rows give their rows each; a
query's own row is left out once, so its repeats are candidates. A null vec_id is no query, and as a candidate comes after
others of its score. An empty table, or one without queries, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from soukline.llm.common import cut

TOP = 20
EVERY = 20
BITS = 64
SAMPLE = 8192
PILOTS = 256
# Components sent to every task for the floors, 8 MB; wide vectors are fewer.
LOOK_VALUES = 1 << 20
RADIUS_SHARE = 0.97
BLOCK = 4096
# Most probes per query and substring.
PROBES = 4096
ROUNDS = 30
SLACK = 1e-9


def _usable() -> Column:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def classes(vectors: DataFrame) -> DataFrame:
    """(cid, dim, embedding): each different usable vector of ``vectors`` (vec_id, embedding) once, as doubles."""
    return _plain(vectors).groupBy("embedding").agg(F.first("dim").alias("dim")).withColumn("cid", F.monotonically_increasing_id())


def _plain(vectors: DataFrame) -> DataFrame:
    plain = F.transform("embedding", lambda x: x.cast("double") + 0.0)  # no negative zero
    return vectors.filter(_usable()).select("vec_id", plain.alias("embedding"), F.size("embedding").alias("dim"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Model:
    """A basis and rotations: signs of the turned vectors are the code."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray, longest: float):
        self.mean, self.turn, self.longest = mean, turn, longest

    @property
    def width(self) -> int:
        return len(self.mean) - 1

    def codes(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            scaled = rows / self.longest
            rest = np.zeros(len(rows)) if query else np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
            # a query's length changes no order
            size = np.linalg.norm(scaled, axis=1) if query else np.ones(len(rows))
        turned = (np.column_stack([scaled / np.maximum(size, 1e-300)[:, None], rest]) - self.mean) @ self.turn
        return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def learned(sample: np.ndarray, longest: float) -> Model:
    """Iterative quantization of the sample's principal components; more than they are take further rotations."""
    scaled = sample / longest
    full = np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))])
    mean = full.mean(axis=0)
    values, basis = np.linalg.eigh((full - mean).T @ (full - mean))
    basis = basis[:, np.argsort(-values, kind="stable")[:BITS]]
    shape, turns, rng = (full - mean) @ basis, [], np.random.default_rng(7)
    while sum(t.shape[1] for t in turns) < BITS:
        turn = np.linalg.qr(rng.normal(size=(basis.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.sign(shape @ turn).T @ shape)
            turn = (left @ right).T
        turns.append(basis @ turn)
    return Model(mean, np.column_stack(turns)[:, :BITS], longest)


def fit(found: DataFrame) -> Model | None:
    """The model of the classes; None without any. Only the fitted matrix comes to the driver, as wide as the vectors."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    size = found.agg(F.count("*").alias("n"), F.max("dim").alias("width"), F.max(length).alias("longest")).first()
    if not size.n:
        return None
    width, longest = size.width, max(size.longest, 1e-300)
    pick = F.pmod(F.xxhash64("embedding"), F.lit(1 << 40))
    near = found.select("embedding", pick.alias("pick")).filter(F.col("pick") * float(size.n) <= 2.0 * SAMPLE * (1 << 40))
    sample = near.orderBy("pick", "embedding").limit(SAMPLE)

    def work(table: pa.Table) -> pa.Table:
        model = learned(_matrix(table.column("embedding"), width), longest)
        return pa.table({"mean": [model.mean.tolist()], "turn": [model.turn.ravel().tolist()]})

    told = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(work, "mean array<double>, turn array<double>").first()
    return Model(np.array(told.mean), np.array(told.turn).reshape(width + 1, BITS), longest)


def coded(found: DataFrame, model: Model, query: bool = False) -> DataFrame:
    """``found`` and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = model.codes(_matrix(batch.column(batch.schema.names.index("embedding")), model.width), query)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], names=[*batch.schema.names, "code"])

    return found.mapInArrow(run, found.select("*").schema.add("code", "long"))


def _scores(queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the allowed pairs with the n largest inner products of each query, ties at the end kept."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = np.where(allowed, queries @ rows.T, -np.inf)
        # a matrix product's last bits depend on its blocks: near the end more are taken, and scored one by one
        reach = SLACK * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0)
    if rough.shape[1] > n:
        last = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
        allowed = allowed & (rough >= (last - reach)[:, None])
    q, r = np.nonzero(allowed)
    return q, r, np.einsum("ij,ij->i", queries[q], rows[r])


def _best(q: np.ndarray, order: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each q, by score and then order."""
    at = np.lexsort((order, -score, q))
    first = np.flatnonzero(np.concatenate([[True], q[at][1:] != q[at][:-1]])) if len(at) else at
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return at[place < n]


def _collected(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, codes and lengths of a few rows, for all tasks; what they need follows from the limit set on them."""
    held = rows.select("dim", "embedding", "code").toArrow()
    return _matrix(held.column("embedding"), width), held.column("code").to_numpy().view(np.uint64), held.column("dim").to_numpy()


def radius(table: DataFrame, queries: DataFrame, model: Model) -> int:
    """Code bits within which RADIUS_SHARE of the true neighbours of at most PILOTS queries lie.

    ``table`` and ``queries`` have cid, dim, embedding and code.
    """
    width = model.width
    points, codes, dims = _collected(queries.orderBy(F.xxhash64("embedding"), "cid").limit(PILOTS), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for batch in batches:
            rows, dim = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            q, r, score = _scores(points, rows, dims[:, None] == dim[None, :], TOP)
            apart = np.bitwise_count(codes[q] ^ batch.column(2).to_numpy().view(np.uint64)[r]).astype(np.int64)
            kept = tuple(np.concatenate(x) for x in zip(kept, (q, score, apart), strict=True))
            at = _best(kept[0], kept[2], kept[1], TOP)
            kept = tuple(x[at] for x in kept)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["q", "score", "apart"])

    told = table.select("dim", "embedding", "code").mapInArrow(run, "q long, score double, apart long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "apart"))
    near = told.withColumn("place", place).filter(F.col("place") <= TOP)
    share = near.groupBy("apart").agg(F.count("*").alias("n")).collect()  # at most BITS + 1 rows
    wanted, held = RADIUS_SHARE * sum(r.n for r in share), 0
    for r in sorted(share, key=lambda r: r.apart):
        held += r.n
        if held >= wanted:
            return int(r.apart)
    return 0


def floored(asked: DataFrame, table: DataFrame, reach: int, width: int, top: int) -> DataFrame:
    """``asked`` and floor: the ``top``-th best score among a few rows (at most SAMPLE) within ``reach``; no result lies below it.

    Null where so few lie within ``reach``. What blocks would tell in vain, they then leave out.
    """
    few = min(SAMPLE, max(PILOTS, LOOK_VALUES // width))
    points, codes, dims = _collected(table.orderBy(F.xxhash64("embedding"), "cid").limit(few), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, vectors, code = (batch.column(batch.schema.names.index(c)) for c in ("dim", "embedding", "code"))
            floors: list[float | None] = []
            for at in range(0, batch.num_rows, 256):
                rows = _matrix(vectors.slice(at, 256), width)
                allowed = dim.to_numpy()[at: at + 256, None] == dims[None, :]
                allowed &= np.bitwise_count(code.to_numpy().view(np.uint64)[at: at + 256, None] ^ codes[None, :]) <= reach
                q, _, score = _scores(rows, points, allowed, top)
                best = _best(q, np.arange(len(q)), score, top)
                last = {int(k): float(x) for k, x in zip(q[best], score[best], strict=True)}
                full = np.bincount(q[best], minlength=len(rows)) >= top
                floors += [last[k] if full[k] else None for k in range(len(rows))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.float64())], names=[*batch.schema.names, "floor"])

    return asked.mapInArrow(run, asked.select("*").schema.add("floor", "double"))


def _ball(bits: int, t: int) -> int:
    return sum(math.comb(bits, k) for k in range(min(t, bits) + 1))


def substring_bits(n: int, reach: int) -> int:
    """Bits of a substring that let a query meet the fewest rows and probes, by expectation over even codes."""
    def cost(s: int) -> float:
        ball = _ball(s, reach // (BITS // s))
        return BITS // s * ball * max(1.0, n / 2**s)

    small = [s for s in (4, 8, 16, 32) if _ball(s, reach // (BITS // s)) <= PROBES and 2**s <= max(16, n)]
    return min(small, key=cost)


def _cells(found: DataFrame, s: int, prefix: int, t: int) -> DataFrame:
    """``found`` once per substring and cell within t bits of its own: adds seg and cell."""
    masks = np.array([m for m in range(1 << prefix) if m.bit_count() <= t], dtype=np.int64)
    count = BITS // s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(batch.schema.names.index("code")).to_numpy().view(np.uint64)
            for seg in range(count):
                own = (code >> np.uint64(seg * s) & np.uint64((1 << s) - 1)) >> np.uint64(s - prefix)
                for mask in np.array_split(masks, max(1, len(masks) // 64)):
                    row = np.repeat(np.arange(len(code)), len(mask))
                    cell = own.astype(np.int64)[row] ^ np.tile(mask, len(code))
                    piece = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*piece.columns, pa.array(np.full(len(row), seg, np.int32)), pa.array(cell)],
                        names=[*batch.schema.names, "seg", "cell"],
                    )

    return found.mapInArrow(run, found.select("*").schema.add("seg", "integer").add("cell", "long"))


def nearest(table: DataFrame, queries: DataFrame, n: int, reach: int, width: int, top: int, block: int = BLOCK) -> DataFrame:
    """(q, c, score): for each query class the ``top`` classes of the largest inner products among those within ``reach`` bits.

    ``table`` and ``queries`` have cid, dim, embedding and code; ``table`` also rep, by which ties are settled; n is its
    size. ``queries`` may have floor.
    """
    s = substring_bits(n, reach)
    count = BITS // s
    t = reach // count
    prefix = min(s, max(0, math.ceil(math.log2(max(1, n / block)))))
    key = ["dim", "seg", "cell"]
    rows, asked = _cells(table, s, prefix, 0), _cells(queries, s, prefix, t)
    parts = _parts(rows, key, "parts", block).join(_parts(asked, key, "asks", block), key)
    one, other = (F.pmod(F.xxhash64("cid", F.lit(3)), F.col(x)) for x in ("parts", "asks"))
    every = [F.explode(F.sequence(F.lit(0), F.col(x) - 1)) for x in ("asks", "parts")]
    held = ["cid", "embedding", "code", "rep", "floor", *key, "part", "ask", "side"]
    if "floor" not in queries.columns:
        asked = asked.withColumn("floor", F.lit(None).cast("double"))
    rows = rows.withColumn("floor", F.lit(None).cast("double"))
    left = rows.join(parts, key).withColumn("part", one).withColumn("ask", every[0]).withColumn("side", F.lit(0))
    right = asked.withColumn("rep", F.lit(None).cast("long")).join(parts, key)
    right = right.withColumn("ask", other).withColumn("part", every[1]).withColumn("side", F.lit(1))

    def work(both: pa.Table) -> pa.Table:
        side, seg = both.column("side").to_numpy(), both.column("seg")[0].as_py()
        a, b = both.filter(pa.array(side == 1)), both.filter(pa.array(side == 0))
        codes = [x.column("code").to_numpy().view(np.uint64) for x in (a, b)]
        points = [_matrix(x.column("embedding"), width) for x in (a, b)]
        rep = np.array([np.iinfo(np.int64).max if x is None else x for x in b.column("rep").to_pylist()], dtype=np.int64)
        floor = np.array([-np.inf if x is None else x for x in a.column("floor").to_pylist()])
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(a), 256) if len(b) else ():
            apart = codes[0][at: at + 256, None] ^ codes[1][None, :]
            allowed = np.bitwise_count(apart) <= reach
            mask = np.uint64((1 << s) - 1)
            for k in range(seg + 1):
                close = np.bitwise_count(apart >> np.uint64(k * s) & mask) <= t
                allowed &= close if k == seg else ~close
            q, r, score = _scores(points[0][at: at + 256], points[1], allowed, top)
            best = _best(q, rep[r], score, top)
            best = best[score[best] >= floor[q[best] + at]]
            out.append((q[best] + at, r[best], score[best]))
        q, r, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({
            "q": a.column("cid").take(pa.array(q)), "c": b.column("cid").take(pa.array(r)), "rep": b.column("rep").take(pa.array(r)),
            "score": score,
        })

    told = (
        left.select(*held).union(right.select(*held)).groupBy(*key, "part", "ask")
        .applyInArrow(work, "q long, c long, rep long, score double")
    )
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("rep"), "c"))
    return told.withColumn("place", place).filter(F.col("place") <= top).select("q", "c", "score")


def _parts(rows: DataFrame, key: list[str], name: str, block: int) -> DataFrame:
    return rows.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias(name))


def search(vectors: DataFrame, queries: Column, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of every row of ``vectors`` that ``queries`` selects."""
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = cut(classes(vectors))
    model = fit(found)
    if model is None:
        return none
    # the rows of each class with the least ids; a rank limit is met before rows are dealt out
    rows = cut(_plain(vectors).withColumn("asks", F.coalesce(queries, F.lit(False)) & F.col("vec_id").isNotNull())
               .join(found.select("cid", "embedding"), "embedding").select("vec_id", "cid", "asks"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy(F.asc_nulls_last("vec_id")))
    first = rows.withColumn("place", place).filter(F.col("place") <= top + 1)
    members = first.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id"))).alias("held"))
    table = cut(coded(found.join(members, "cid"), model).withColumn("rep", F.element_at("held", 1)["vec_id"]))
    asking = rows.filter("asks").select("cid").distinct()
    asked = cut(coded(found.join(asking, "cid", "left_semi"), model, query=True))
    if asked.isEmpty():
        return none
    reach = radius(table, asked, model)
    asked = cut(floored(asked, table, reach, model.width, top + 1))
    near = nearest(table.drop("held"), asked, table.count(), reach, model.width, top + 1)
    # one list of rows per query class; the query's own row is left out of it once
    listed = near.join(table.select(F.col("cid").alias("c"), F.explode("held").alias("m")), "c").select("q", "score", F.col("m.vec_id").alias("vec_id"), "c")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "c"))
    best = listed.withColumn("place", place).filter(F.col("place") <= top + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "c"))).alias("list"))
    each = rows.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("q")).join(lists, "q")
    own = F.array_position(F.transform("list", lambda x: (x["c"] == F.col("q")) & x["vec_id"].eqNullSafe(F.col("query_id"))), True)
    others = F.slice(F.filter("list", lambda x, k: k + 1 != F.col("own")), 1, top)
    return each.withColumn("own", own).select("query_id", F.posexplode(others).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def op11(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
