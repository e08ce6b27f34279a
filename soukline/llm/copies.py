"""Near copies by word shingles: MinHash bands propose, exact Jaccard similarity of the shingle sets decides.

Words are as in ``words``, A-Z lower-cased; a text's set holds its SHINGLE-word shingles. Texts with equal sets are one
class. BANDS bands of ROWS minimum hashes each deal a class to buckets: two sets with similarity 0.8 miss each other in
all of them with probability (1 - 0.8 ** ROWS) ** BANDS, below 1e-7, more similar ones less often. Buckets with the same
members are one. A bucket of at most BUCKET_ROWS classes is worked off with its members' sets: a growing frontier is compared
with what is left, so only a spanning forest of the true links leaves it, never its pairs.

Larger buckets are either groups of copies or texts with a common part. First each member is compared with PIVOTS members of
its bucket, by a join, which connects a group of copies. Members outside a bucket's largest connected part are open: they
still have to meet the others. All classes of buckets with open ones are dealt out anew by prefixes: with its shingles ordered from
the rarest (among these classes) to the most frequent, a set of n shingles that is similar to another shares one of its
first n - ceil(0.8 n) + 1 shingles with it, so these are its buckets, and a common part that is in many texts makes none.
Buckets without an open class go. (Both steps may be repeated, ONCE_MORE times in all.) What is large then is compared in pairs of
a block of open classes and a block of all, of BLOCK_ROWS each. All of this is exact, and no task holds more than
BUCKET_ROWS sets. (Splitting costs shuffles of sets; a bucket within the bound is less work whole.)

Links that are known beforehand (``known``, the pipeline's by SimHash) count from the start: only buckets that they leave
unconnected are looked at, and only their open members are compared with pivots.

Defined results: a null or empty text has the empty set, and all empty sets are one class, linked to no other; a text of
fewer words than SHINGLE has one shingle, all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from soukline.llm.common import connected, cut
from soukline.llm.words import LOWER, Texts, hashes, mix, slices, with_columns

SHINGLE = 5
# The least similarity as a fraction, so that comparisons are exact.
NEAR = (4, 5)
BANDS = 32
ROWS = 4
BUCKET_ROWS = 4096
BLOCK_ROWS = 512
ONCE_MORE = 1
PIVOTS = 8
# Rows of two longs that are sent to every task, 16 MB; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))


def shingles(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, repeats included, in order of the texts."""
    starts, ends, of = texts.words()
    h = hashes(LOWER[texts.data], starts, ends)
    n = np.bincount(of, minlength=len(texts))
    out = h.copy()
    last = np.concatenate([[0], np.cumsum(n)])[of + 1] - 1 if len(of) else of
    here = np.arange(len(h))
    for k in range(1, SHINGLE):
        more = here + k <= last
        out[more] = mix(out[more]) + h[here[more] + k]
    # a short text's only shingle begins with its first word
    begins = here + SHINGLE - 1 <= last
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    begins[first[(n > 0) & (n < SHINGLE)]] = True
    return out[begins], of[begins]


def _sets(texts: Texts) -> list[np.ndarray]:
    values, of = shingles(texts)
    ends = np.cumsum(np.bincount(of, minlength=len(texts)))
    return [np.unique(x) for x in np.split(values, ends[:-1])]


def _classes(sets: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], dtype=np.uint64)


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys per set; sets are not empty."""
    values = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for k in range(BANDS):
        key = np.full(len(sets), k, dtype=np.uint64)
        for r in range(k * ROWS, (k + 1) * ROWS):
            least = np.minimum.reduceat((values ^ _SEEDS[2 * r]) * (_SEEDS[2 * r + 1] | np.uint64(1)), first)
            key = mix(key + least)
        out[:, k] = key
    return out


def keys(texts: Texts) -> dict[str, np.ndarray | pa.Array]:
    """cls (the class of each text's set) and bands (its keys; none for an empty set)."""
    return keys_of(_sets(texts))


def keys_of(sets: list[np.ndarray]) -> dict[str, np.ndarray | pa.Array]:
    some = [k for k, s in enumerate(sets) if len(s)]
    found = _bands([sets[k] for k in some]).view(np.int64) if some else np.zeros((0, BANDS), np.int64)
    sizes = np.zeros(len(sets) + 1, dtype=np.int32)
    sizes[np.array(some, dtype=np.int64) + 1] = BANDS
    bands = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(found.reshape(-1)))
    return {"cls": _classes(sets).view(np.int64), "bands": bands}


def with_keys(schema: T.StructType) -> T.StructType:
    return schema.add("cls", "long").add("bands", T.ArrayType(T.LongType()))


def signed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, cls and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield with_columns(batch, carry, **keys(texts))

    return docs.mapInArrow(run, with_keys(docs.select(*carry).schema))


def buckets(classes: DataFrame) -> DataFrame:
    """(key, cls, open): the members of every bucket of ``classes`` (cls, bands) with two or more, each set of members once."""
    return _once(classes.select("cls", F.explode("bands").alias("key"), F.lit(True).alias("open")))


def near(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are similar enough to a; sets are sorted, without repeats, not empty."""
    up, down = NEAR
    n = np.array([len(s) for s in others])
    out = np.zeros(len(others), dtype=bool)
    todo = np.flatnonzero((down * np.minimum(n, len(a)) >= up * np.maximum(n, len(a))))
    if len(todo):
        values = np.concatenate([others[k] for k in todo])
        at = np.minimum(np.searchsorted(a, values), len(a) - 1)
        first = np.concatenate([[0], np.cumsum(n[todo])[:-1]])
        both = np.add.reduceat((a[at] == values).astype(np.int64), first)
        out[todo] = down * both >= up * (len(a) + n[todo] - both)
    return out


def forest(ids: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (a, b) of ids that join exactly the sets connected by steps of NEAR similarity."""
    left, a, b = list(range(len(ids))), [], []
    while left:
        root, *left = left
        frontier = [root]
        while frontier and left:
            k = frontier.pop()
            hit = near(sets[k], [sets[x] for x in left])
            found = [x for x, y in zip(left, hit, strict=True) if y]
            left = [x for x, y in zip(left, hit, strict=True) if not y]
            frontier += found
            a += [ids[x] for x in found]
            b += [ids[root]] * len(found)
    return a, b


def _once(rows: DataFrame) -> DataFrame:
    """The rows (key, cls, open) of buckets with two members or more of which one is open, each set of members once."""
    shared = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.max("open").alias("some")
    ).filter("n > 1 AND some")
    once = cut(shared.groupBy("n", "x").agg(F.min("key").alias("key")).select("key"))
    return rows.join(once, "key", "left_semi")


def _pivots(members: DataFrame) -> DataFrame:
    """(cls, centre): each open member of a bucket with each of its pivots, its PIVOTS least members (a class is a hash)."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("cls"))
    some = members.withColumn("place", place).filter(F.col("place") <= PIVOTS).select("key", F.col("cls").alias("centre"))
    return members.filter("open").join(some, "key").filter("cls <> centre").select("cls", "centre").distinct()


def _unsettled(members: DataFrame, together: DataFrame) -> DataFrame:
    """(key, cls, open): buckets whose members are not all connected; open are those outside the largest connected part."""
    placed = members.select("key", "cls").join(together.select(F.col("node").alias("cls"), "root"), "cls", "left")
    placed = cut(placed.select("key", "cls", F.coalesce("root", "cls").alias("root")))
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    return placed.join(main, "key").select("key", "cls", (F.col("root") != F.col("main")).alias("open"))


def _stars(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b): the pairs (cls, centre) that are near."""
    sets = pairs.join(held, "cls").join(held.toDF("centre", "centre_held"), "centre")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # names are not looked up: cls, held, centre, centre_held
            mine, centres = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            hit = [
                bool(near(np.frombuffer(c, dtype=np.uint64), [np.frombuffer(x, dtype=np.uint64)])[0])
                for x, c in zip(mine, centres, strict=True)
            ]
            found = batch.filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(2)], names=["a", "b"])

    return sets.select("cls", "held", "centre", "centre_held").mapInArrow(judge, "a long, b long")


def _by_prefix(left: DataFrame, held: DataFrame) -> DataFrame:
    """(key, cls, open): buckets of the classes ``left`` (cls, open) by the rarest shingles of their sets."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, dtype=np.int64)
                n = np.full(len(values), len(values))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), cls)), pa.array(values), pa.array(n)], names=["cls", "key", "size"]
                )

    spelled = cut(held.join(left, "cls", "left_semi").select("cls", "held").mapInArrow(spell, "cls long, key long, size long"))
    often = spelled.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # shingles that no other set has come first of all, and take their places without making a bucket
    of_class = Window.partitionBy("cls")
    place = F.row_number().over(of_class.orderBy("n", "key")) + F.col("size") - F.count("*").over(of_class)
    up, down = NEAR
    prefix = F.col("size") - F.ceil(F.col("size") * up / down) + 1
    dealt = spelled.join(often, "key").withColumn("place", place).filter(F.col("place") <= prefix).select("key", "cls")
    return _once(cut(dealt.join(left, "cls")))


def _in_blocks(members: DataFrame, bucket_rows: int) -> DataFrame:
    """(key, cls): large buckets as one for each pair of a block of open classes and a block of all."""
    sizes = members.groupBy("key").agg(
        F.ceil(F.count("*") / bucket_rows).cast("int").alias("parts"), F.ceil(F.count_if("open") / bucket_rows).cast("int").alias("opens")
    )
    dealt = cut(members.join(sizes, "key"))

    def own(count: str) -> Column:
        return F.pmod(F.xxhash64("cls"), F.col(count)).cast("int")

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    every = dealt.select("key", "cls", own("parts").alias("block"), each("opens").alias("open_block"))
    opened = dealt.filter("open").select("key", "cls", each("parts").alias("block"), own("opens").alias("open_block"))
    return every.union(opened).select(F.xxhash64("key", "block", "open_block").alias("key"), "cls").distinct()


def _held(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, held): the sets of the classes ``wanted`` (cls, h); ``docs`` has h and text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            held = pa.array([s.tobytes() for s in _sets(texts)], pa.binary())
            yield with_columns(batch, ["cls"], held=held)

    # the planner does not see how few rows these are, and would deal out every text
    near_few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.join(near_few, "h").select("cls", "text").mapInArrow(read, "cls long, held binary")
    # rows that are equal in every column have one hash
    return cut(texts.groupBy("cls").agg(F.first("held").alias("held")))


def checked(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): those of the ``pairs`` (cls, centre) of classes that are near. The other tables are as for ``links``."""
    some = pairs.select("cls").union(pairs.select("centre")).distinct()
    return _stars(pairs, _held(docs, cut(classes.join(some, "cls", "left_semi").select("cls", "h"))))


def links(
    docs: DataFrame, classes: DataFrame, bucket_rows: int = BUCKET_ROWS, known: DataFrame | None = None
) -> DataFrame:
    """(a, b): edges between near classes, ``known`` (a, b) among them.

    ``docs`` has h and text, ``classes`` cls, bands and h of one of its rows.
    """

    def work(bucket: pa.Table) -> pa.Table:
        # a link's centre is its lesser class, here as elsewhere, so that a class has few lesser ones
        bucket = bucket.sort_by("cls")
        sets = [np.frombuffer(x, dtype=np.uint64) for x in bucket.column("held").to_pylist()]
        a, b = forest(bucket.column("cls").to_pylist(), sets)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    members = cut(buckets(classes))
    if known is not None:
        members = cut(_unsettled(members, connected(known)))
    held = _held(docs, cut(classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "h")))
    ready, edges = None, known
    together = None
    for turn in range(ONCE_MORE + 1):
        if together is not None:
            members = cut(_unsettled(members, together))
        large = cut(members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows).select("key"))
        if large.isEmpty():
            break
        small = members.join(large, "key", "left_anti").select("key", "cls")
        ready = small if ready is None else ready.union(small)
        big = cut(members.join(large, "key"))
        if turn == ONCE_MORE:
            members = _in_blocks(big, min(bucket_rows, BLOCK_ROWS))
            break
        star = cut(_stars(_pivots(big), held))
        edges = star if edges is None else edges.union(star)
        together = connected(edges)
        left = cut(_unsettled(big, together).groupBy("cls").agg(F.max("open").alias("open")))
        if left.isEmpty():
            members = big.limit(0)
            break
        members = cut(_by_prefix(left, held))
    members = members.select("key", "cls")
    rows = members if ready is None else ready.union(members)
    found = rows.join(held, "cls").groupBy("key").applyInArrow(work, "a long, b long")
    return found if edges is None else found.union(edges)


def roots(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(cls, root) of every class that is near another. ``docs`` has h and text, ``rows`` h, cls and bands of the same."""
    classes = cut(rows.groupBy("cls").agg(F.first("bands").alias("bands"), F.min("h").alias("h")))
    return connected(links(docs.select("h", "text"), classes)).select(F.col("node").alias("cls"), "root")

