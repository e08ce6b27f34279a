"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two 32-bit segments. Two fingerprints within 3 bits differ in one bit at most in one of them, so each
fingerprint looks up, per segment, the segment itself and the ball of radius 1 around it (only the neighbours with one
bit less: the other half of the ball finds the pair from the other side). Looked-up rows that meet no table entry are
dropped by a semi-join, which makes no pairs. The few buckets that remain are worked off one by one: distances to a
growing frontier, over all 64 bits, give a spanning forest of the bucket's links, never its pairs. A bucket over
BUCKET_ROWS rows is split by blocks of the other bits (again, one of four blocks must agree), until few bits are left.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a text of one or two words is
one shingle. Repeated rows have equal fingerprints. A null doc_id takes part; a component's id is its least doc_id that
is not null. An empty table gives an empty result.

SHINGLE and MAX_BITS are op2's contract. ``keep_first``, the pipeline's stage, goes by the general rule instead: near are
texts whose sets of five-word shingles have a Jaccard similarity of 0.8 (``copies``). A set has PRINTS fingerprints of 64
bits, each searched as above: two segments, balls of radius 1, the semi-join, then distances over all 64 bits. A bucket's
member of the least class proposes those within REACH bits of it, and the exact similarity decides. A pair at 0.8 differs in 10 of 64
bits on average, so some pairs have no segment within 1 bit; for these ``copies`` works off what the links found leave
unconnected, and no link is lost. ``keep_first`` returns its input's columns only, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from soukline.llm import copies
from soukline.llm.common import connected, cut
from soukline.llm.words import mix, slices, with_columns

SEED = 42
SHINGLE = 3
MAX_BITS = 3
BUCKET_ROWS = 2048
SPLITS = 4
PRINTS = 4
# Two sets of similarity 0.8 differ in a bit with probability arccos(8 / 9) / pi = 0.15; unrelated ones in half of them.
REACH = 13
_CHUNK = 1 << 15
_SEEDS = mix(np.arange(1, PRINTS + 1, dtype=np.uint64))


def fingerprint(raw: bytes) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles, A-Z lower-cased."""
    words = raw.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashed = [digest(b" ".join(words), SEED)]
    else:
        hashed = [digest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    return int(_majority(np.array(hashed, dtype="<u8").reshape(-1, 1))[0])


def _majority(values: np.ndarray) -> np.ndarray:
    """Per column of 64-bit values, the bits that are set in over half of them."""
    ones = np.zeros(64 * values.shape[1], dtype=np.int64)
    for at in range(0, len(values), _CHUNK):
        part = values[at: at + _CHUNK].view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(values), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            values = np.array([fingerprint(texts.raw(k)) for k in range(len(texts))], dtype=np.uint64)
            yield with_columns(batch, carry, fp=values.view(np.int64))

    return docs.mapInArrow(run, docs.select(*carry).schema.add("fp", "long"))


def _segment(n: int):
    """Segment n of fp as a long from 0 to 2 ** 32 - 1."""
    return F.shiftrightunsigned("fp", 32 * n).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _hits(table: DataFrame, width: int) -> DataFrame:
    """The balls around the values of ``table`` (seg, val and more), ``width`` bits wide, where they meet an entry of it."""
    bits = F.sequence(F.lit(0), F.lit(width - 1))
    one = F.lit(1).cast("long")
    probes = (
        table.select("*", F.explode(bits).alias("bit"))
        .withColumn("flip", F.call_function("shiftleft", one, F.col("bit")))
        .filter(F.col("val").bitwiseAND(F.col("flip")) != 0)
        .withColumn("val", F.col("val").bitwiseXOR(F.col("flip"))).select(*table.columns)
    )
    return cut(probes.join(table.select("seg", "val"), ["seg", "val"], "left_semi").select(*table.columns))


def _meeting(table: DataFrame, width: int) -> DataFrame:
    """(seg, val, fp): ``table`` and the balls around its values, ``width`` bits wide, where an entry meets another row."""
    hits = _hits(table, width)
    shared = table.groupBy("seg", "val").count().filter("count > 1").select("seg", "val")
    alive = hits.select("seg", "val").union(shared).distinct()
    return hits.union(table.join(alive, ["seg", "val"], "left_semi"))


def buckets(distinct: DataFrame) -> DataFrame:
    """(key, rest, fp): the rows of every bucket with a table entry and at least one other row.

    ``rest`` has the bits that the key does not fix.
    """
    table = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(n).alias("seg"), _segment(n).alias("val")) for n in (0, 1)
    ])).alias("x")).select("x.seg", "x.val", "fp")
    rows = _meeting(table, 32)
    rest = F.when(F.col("seg") == 0, F.lit(-1 << 32)).otherwise(F.lit((1 << 32) - 1)).cast("long")
    return rows.select(F.concat_ws(":", "seg", "val").alias("key"), rest.alias("rest"), "fp")


def _blocks(rest: int) -> list[int]:
    """The free bits, dealt into SPLITS blocks; as masks."""
    bits = [b for b in range(64) if rest >> b & 1]
    return [sum(1 << b for b in bits[k::SPLITS]) for k in range(SPLITS)]


def split_large(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Buckets over the bound give way to one bucket per block of free bits and value of that block.

    At most MAX_BITS of the free bits of a pair differ, so one of SPLITS blocks agrees. The rounds end when no bucket
    is over the bound or few bits are left: a bucket then has at most that many different fingerprints.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, rest, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                free = rest % (1 << 64)
                for block in _blocks(free):
                    left = free & ~block
                    out.append((f"{key}/{block & fp:x}:{block:x}", left - (left >> 63 << 64), fp))
            keys, rests, fps = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(rests, pa.int64()), pa.array(fps, pa.int64())],
                names=["key", "rest", "fp"],
            )

    done = None
    for _ in range(3):
        large = rows.groupBy("key").count().filter(F.col("count") > bucket_rows).select("key")
        large = cut(large)
        if large.isEmpty():
            break
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.union(small)
        rows = cut(rows.join(large, "key", "left_semi").mapInArrow(deal, rows.schema))
    return rows if done is None else done.union(rows)


def forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join exactly the fingerprints connected by steps of MAX_BITS bits or fewer."""
    left = np.unique(values)
    a, b = [], []
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(frontier), 64):
                todo = np.flatnonzero(~near)
                apart = np.bitwise_count(frontier[at: at + 64, None] ^ left[None, todo])
                near[todo[(apart <= MAX_BITS).any(axis=0)]] = True
            frontier, left = left[near], left[~near]
            a.append(frontier)
            b.append(np.full(len(frontier), root))
    none = np.zeros(0, np.uint64)
    return np.concatenate([*a, none]), np.concatenate([*b, none])


def links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): edges with the same components as all pairs of ``distinct`` (column fp) within MAX_BITS."""

    def work(bucket: pa.Table) -> pa.Table:
        a, b = forest(np.array(bucket.column("fp").to_numpy(), dtype=np.int64).view(np.uint64))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = split_large(cut(buckets(distinct)), bucket_rows)
    return rows.groupBy("key").applyInArrow(work, "a long, b long")


def clustered(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for every fingerprint of ``prints`` (doc_id, fp)."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(classes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document."""
    prints = cut(fingerprints(docs.select("doc_id", "text"), ["doc_id"]))
    return prints.join(clustered(prints), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def set_prints(values: np.ndarray) -> np.ndarray:
    """The PRINTS fingerprints of a set of shingle hashes."""
    return _majority(mix(values[:, None] ^ _SEEDS))


def signed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, cls and bands as in ``copies``, and prints (none for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            sets = copies._sets(texts)
            prints = pa.array([set_prints(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield with_columns(batch, carry, **copies.keys_of(sets), prints=prints)

    schema = copies.with_keys(docs.select(*carry).schema)
    return docs.mapInArrow(run, schema.add("prints", T.ArrayType(T.LongType())))


def _near_prints(prints: DataFrame) -> DataFrame:
    """(cls, centre): fingerprints of one ``word`` (columns word, fp, cls) that meet in a bucket and are within REACH bits.

    In a bucket the member of the least class meets all others, and of those that it meets in all its buckets a fingerprint
    keeps the least (a class is a hash), so there are never more rows than fingerprints.
    """
    table = prints.select("fp", "cls", F.explode(F.array(*[
        F.struct((2 * F.col("word") + n).alias("seg"), _segment(n).alias("val")) for n in (0, 1)
    ])).alias("x")).select("x.seg", "x.val", "fp", "cls")
    rows = _hits(table, 32).union(table)
    centres = rows.groupBy("seg", "val").agg(F.min(F.struct("cls", "fp")).alias("x"), F.count("*").alias("n")).filter("n > 1")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("x.fp")))
    met = rows.join(centres.drop("n"), ["seg", "val"]).filter(apart.between(1, REACH))
    return met.groupBy(F.floor(F.col("seg") / 2), "cls").agg(F.min("x.cls").alias("centre")).select("cls", "centre")


def candidates(classes: DataFrame) -> DataFrame:
    """(cls, centre): the pairs of ``classes`` (cls, prints) that some fingerprint proposes; the centre is the lesser class."""
    marked = classes.select("cls", F.posexplode("prints").alias("word", "fp"))
    least = cut(marked.groupBy("word", "fp").agg(F.min("cls").alias("cls"), F.count("*").alias("n")))
    several = least.filter("n > 1").select("word", "fp", F.col("cls").alias("centre"))
    equal = marked.join(several, ["word", "fp"]).select("cls", "centre").filter("cls <> centre")
    return equal.union(_near_prints(least.drop("n"))).distinct()


def near_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between near classes by their fingerprints. ``docs`` has h and text, ``classes`` cls, prints and h."""
    return copies.checked(docs, classes, cut(candidates(classes)))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that of the least doc_id (nulls last), ties by the row's hash."""
    mine = F.xxhash64(*docs.columns)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", mine.alias("h"))
    texts = docs.select("doc_id", "text", mine.alias("h"))
    marked = cut(signed(texts, ["doc_id", "h"]))
    classes = cut(marked.groupBy("cls").agg(
        F.first("bands").alias("bands"), F.first("prints").alias("prints"), F.min("h").alias("h")
    ))
    held = texts.select("h", "text")
    roots = connected(copies.links(held, classes, known=cut(near_links(held, classes))))
    sizes = marked.groupBy("cls", "doc_id", "h").agg(F.count("*").alias("n"))
    of_class = sizes.groupBy("cls").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "n")).alias("x")
    )
    rooted = of_class.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    first = cut(
        rooted.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("x").alias("x"))
        .select(F.col("x.doc_id").alias("k_id"), F.col("x.h").alias("k_h"), F.col("x.n").alias("k_n"))
    )
    few = F.broadcast if first.count() <= copies.BROADCAST_ROWS else lambda df: df
    here = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))
    once = rows.join(few(first.filter("k_n = 1")), here)
    # rows that are equal in every column are one row; only these are dealt out
    again = rows.join(few(first.filter("k_n > 1")), here).groupBy("k_id", "k_h").agg(F.first("row").alias("row"))
    return once.select("row.*").union(again.select("row.*"))
