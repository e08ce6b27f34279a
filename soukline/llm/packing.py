"""Conflict-constrained best-fit packing.

Documents (in words) go into bins of CAPACITY words. A document over the capacity gives full bins and a remainder.
Remainders are placed longest first: the open bins stand in order of residual space, each with a bitmap of the sources
and a bitmap of the duplicate clusters it holds, and the search walks up from the tightest bin that is large enough to
the first one that holds neither the document's source nor its cluster. So no bin has two documents of one source, or
two copies of one text. A cluster is a group of near copies (``copies``: five-word shingles, Jaccard similarity 0.8).

The rows (ids and sizes, no texts) are dealt by a hash to shards of about SHARD_ROWS, whose number follows from the row
count alone; a shard of twice that or more (equal rows) is packed in parts. Bins do not cross shards, so every bin is
exact best-fit within its shard and memory is bounded whatever a source or cluster holds. Bin ids are the same in every
run over the same rows, whatever the session's partition settings.

Defined results: a null or empty text has no words and gets one row with no bin. A null source conflicts with nothing.
Ties are placed by the hash, then doc_id. Repeated rows are packed as often as they occur, in different bins. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.llm import copies
from soukline.llm.common import cut
from soukline.llm.words import slices, with_columns

CAPACITY = 1024
SHARD_ROWS = 4096
SHARDS_A_TASK = 64
SCHEMA = (
    "doc_id long, source string, piece long, start_word long, n_words long, bin_id string, bin_offset long"
)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, cluster) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            n = np.bincount(texts.words()[2], minlength=len(texts)).astype(np.int64)
            yield with_columns(batch, ["doc_id", "source", "h"], n_words=n, **copies.keys(texts))

    texts = docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("h"), "text")
    rows = cut(texts.mapInArrow(run, copies.with_keys(texts.drop("text").schema.add("n_words", "long"))))
    near = rows.join(copies.roots(texts, rows), "cls", "left")
    return near.select("doc_id", "source", "n_words", F.coalesce("root", "cls").alias("cluster"))


class Bins:
    """Open bins of one shard, ordered by residual space."""

    def __init__(self):
        self.open: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def new(self, size: int) -> int:
        self.sources.append(0)
        self.clusters.append(0)
        self.filled.append(size)
        return len(self.filled) - 1

    def place(self, size: int, source: int, cluster: int, capacity: int) -> tuple[int, int]:
        """The tightest compatible bin and the offset in it; ``source`` and ``cluster`` are bits, or 0."""
        rows, sources, clusters = self.open, self.sources, self.clusters
        k = bisect_left(rows, (size, -1))
        while k < len(rows) and (sources[rows[k][1]] & source or clusters[rows[k][1]] & cluster):
            k += 1
        if k < len(rows):
            at = rows.pop(k)[1]
            offset = self.filled[at]
            self.filled[at] += size
        else:
            at, offset = self.new(size), 0
        sources[at] |= source
        clusters[at] |= cluster
        if capacity > self.filled[at]:
            insort(rows, (capacity - self.filled[at], at))
        return at, offset


def pack_shard(rows: list[tuple], capacity: int) -> list[tuple]:
    """(doc_id, source, piece, start_word, n_words, bin, offset) for rows (doc_id, source, n_words, cluster)."""
    bins, out = Bins(), []
    source_bit: dict = {None: 0}
    seen: dict = {}
    for _, source, _, cluster in rows:
        source_bit.setdefault(source, 1 << (len(source_bit) - 1))
        seen[cluster] = seen.get(cluster, 0) + 1
    shared = [c for c, n in seen.items() if n > 1]
    cluster_bit = {c: 1 << k for k, c in enumerate(shared)}
    rest = []
    for k, (doc_id, source, n, cluster) in enumerate(rows):
        whole = n // capacity
        for piece in range(whole):
            out.append((doc_id, source, piece, piece * capacity, capacity, bins.new(capacity), 0))
        if n == 0:
            out.append((doc_id, source, 0, 0, 0, None, None))
        elif n % capacity:
            rest.append((-(n % capacity), k))
    for size, k in sorted(rest):
        doc_id, source, n, cluster = rows[k]
        at, offset = bins.place(-size, source_bit[source], cluster_bit.get(cluster, 0), capacity)
        out.append((doc_id, source, n // capacity, n + size, -size, at, offset))
    return out


def packed(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece of a document: which words go to which bin, and where in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, held = None, 0, []

        def emit(rows):
            placed = pack_shard(rows, capacity)
            placed = [(*r[:5], None if r[5] is None else f"{shard}-{part}-{r[5]}", r[6]) for r in placed]
            columns = list(zip(*placed, strict=True))
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

        for batch in batches:
            numbers, *columns = (c.to_pylist() for c in batch.columns)
            for number, *row in zip(numbers, *columns, strict=True):
                if number != shard:
                    if held:
                        yield emit(held)
                    shard, part, held = number, 0, []
                held.append(tuple(row))
                if len(held) == 2 * shard_rows:
                    yield emit(held[:shard_rows])
                    part, held = part + 1, held[shard_rows:]
        if held:
            yield emit(held)

    rows = cut(sized(docs))
    shards = max(1, round(rows.count() / shard_rows))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS_A_TASK + 1)
    dealt = F.xxhash64("doc_id", "cluster", "n_words")
    # the session's setting spreads shards over tasks, no more; equal rows may fill one task, never one part of a shard
    ordered = (
        rows.withColumn("h", dealt).withColumn("shard", F.pmod("h", F.lit(shards)))
        .repartition(tasks, "shard").sortWithinPartitions("shard", "h", "doc_id", "source", "n_words")
    )
    return ordered.select(
        "shard", F.col("doc_id").cast("long"), F.col("source").cast("string"), "n_words", "cluster"
    ).mapInArrow(run, SCHEMA)


def op3(docs: DataFrame) -> DataFrame:
    return packed(docs.select("doc_id", "source", "text"))
