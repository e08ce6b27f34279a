"""Streams with state of their own: keyed upserts by bucket, duplicates, overdue deliveries, the win-back band.

Each job runs to the end of the available input. What it delivers depends on the rows and the clock only, not on how the
rows are cut into micro-batches, and a batch that is replayed delivers the same again. A clock row (no order, but a time) moves
the watermark where no business event does.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from soukline.session import shared_dir
from soukline.streaming.jobs import BATCH, event_time, latest_rows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000


# Upserts ---------------------------------------------------------------------------------------------------------


class KeyedTable:
    """The newest row of every key, in hash buckets; a batch rewrites the buckets that it touches, no others.

    ``manifest/N`` names, for batch N, the version (batch) that holds each bucket. It is written after the bucket files,
    so readers see either batch whole. Merging is idempotent (the newest version of a key wins), so a replayed batch gives
    what it gave before. Versions that neither the last nor the one before it names are removed. The number of buckets
    is fixed for a table's life: choose it so that a bucket's keys fit a few tasks.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str, order: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path, schema, key, order, buckets

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        place, files = self._files(path)
        return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def batches(self) -> list[int]:
        """Batches with a whole manifest, in order."""
        whole = []
        for name in self._names(f"{self.path}/manifest"):
            place, files = self._files(f"{self.path}/manifest/{name}/_SUCCESS")
            if name.isdigit() and files.exists(place):
                whole.append(int(name))
        return sorted(whole)

    def versions(self, batch: int | None) -> dict[int, int]:
        """Version of each bucket that has rows; at most one entry a bucket."""
        if batch is None:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/{batch}").collect()
        return {r.bucket: r.version for r in rows}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The table after the last whole batch."""
        return self._read(self.versions(max(self.batches(), default=None)))

    def upsert(self, rows: DataFrame, batch: int) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        rows = rows.select(*self.schema.names).persist()
        try:
            touched = sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())  # at most one row a bucket
            before = max((b for b in self.batches() if b < batch), default=None)
            now = self.versions(before)
            merged = latest_rows(rows.unionByName(self._read({b: now[b] for b in touched if b in now})), self.key, self.order)
            (
                merged.select(*self.schema.names, bucket.alias("bucket")).hint("rebalance", F.col("bucket"))
                .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={batch}")
            )
        finally:
            rows.unpersist()
        told = now | dict.fromkeys(touched, batch)
        manifest = self.spark.createDataFrame(sorted(told.items()), "bucket int, version long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")
        self._sweep()

    def _sweep(self) -> None:
        """Removes bucket files and manifests that the last two batches do not need."""
        old = self.batches()[:-2]
        held = {(v, b) for batch in self.batches()[-2:] for b, v in self.versions(batch).items()}
        for name in self._names(f"{self.path}/data"):
            version = int(name.partition("=")[2])
            left = [x for x in self._names(f"{self.path}/data/{name}") if x.startswith("bucket=")]
            gone = [x for x in left if (version, int(x.partition("=")[2])) not in held]
            for path in [f"{self.path}/data/{name}"] if len(gone) == len(left) else [f"{self.path}/data/{name}/{x}" for x in gone]:
                place, files = self._files(path)
                files.delete(place, True)
        for batch in old:
            place, files = self._files(f"{self.path}/manifest/{batch}")
            files.delete(place, True)


def merge_buckets(stream: DataFrame, path: str, key: str, order: list[str], buckets: int = 64) -> DataFrame:
    """Upserts the stream into a keyed table below ``path``; returns the newest row of every key."""
    spark = stream.sparkSession
    shared_dir(spark)
    table = KeyedTable(spark, path, stream.schema, key, order, buckets)
    run(stream, f"{path}/progress", table.upsert)
    return table.rows()


def run(stream: DataFrame, progress: str, each, mode: str = "append") -> list[dict]:
    """Runs ``each`` on every micro-batch until the input is used up; returns the batches' progress reports."""
    query = (
        stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return [p if isinstance(p, dict) else dict(p) for p in query.recentProgress]


# Duplicates ------------------------------------------------------------------------------------------------------


def first_seen(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first row seen of each key; repeats within ``delay`` of it go.

    A row older than the watermark (the newest time so far less ``delay``) is late and goes, too, whether it is a repeat or
    not. The state holds the keys of the last ``delay``, whatever the stream's length.
    """
    return event_time(stream, ts, delay).dropDuplicatesWithinWatermark(keys).drop("event_time")


def state_report(reports: list[dict]) -> dict[str, int]:
    """Rows held by the state after the last batch, at most after any batch, and rows dropped as late."""
    ops = [op for r in reports for op in r["stateOperators"]]
    return {
        "held": ops[-1]["numRowsTotal"] if ops else 0, "most": max((op["numRowsTotal"] for op in ops), default=0),
        "late": sum(op["numRowsDroppedByWatermark"] for op in ops),
    }


# Overdue deliveries ----------------------------------------------------------------------------------------------


def overdue(orders: DataFrame, deliveries: DataFrame, order: str, promised: str, arrived: str, delay: str) -> DataFrame:
    """Orders whose promise has passed without a delivery: a stream-stream join, left outer.

    Both sides are streams with ``order``. An order waits in the state until no delivery up to its promise can come any
    more (the clock is the later bound of both streams less ``delay``), then leaves, once; a delivery waits until no order
    can need it. Rows with an empty order id are clock rows. A delivery after the promise does not take an alert back. An
    order that comes first when the clock has passed its promise is late and dropped.
    """
    asked = orders.withColumn("due", F.col(promised).cast("timestamp")).withWatermark("due", delay)
    came = deliveries.select(F.col(order).alias("of"), F.col(arrived).cast("timestamp").alias("came")).withWatermark("came", delay)
    met = asked.join(came, (F.col(order) == F.col("of")) & (F.col("came") <= F.col("due")), "left_outer")
    # both sides are named, or the filter would be applied before the clock rows have moved the watermark
    named = F.coalesce(F.col("of"), F.col(order)) != ""
    return met.filter(F.col("of").isNull() & named).drop("of", "came", "due")


# The win-back band -----------------------------------------------------------------------------------------------


class Band(StatefulProcessor):
    """Per customer: orders wait until the watermark has passed them, then move the customer in order of time.

    The state is the last order, whether the customer is in the band, and orders that still wait. The only timer that
    matters is the next moment at which something is due. A customer who has lapsed leaves no state.
    """

    def __init__(self, after: int, until: int):
        self.after, self.until = after, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("customer", "last bigint, inside boolean, waiting array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [r["at_us"] for r in rows if r["counts"]]
        if key[0] is not None and came:
            last, inside, waiting = self._held()
            yield from self._moved(key, last, inside, sorted(waiting + came), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            yield from self._moved(key, *self._held(), timerValues.getCurrentWatermarkInMs() * 1000)

    def _held(self) -> tuple:
        if not self.state.exists():
            return None, False, []
        last, inside, waiting = self.state.get()
        return last, inside, list(waiting)

    def _moved(self, key, last, inside, waiting, now) -> Iterator[Row]:
        """All that is due up to ``now``, in order; keeps the rest and sets the timer for the next of it."""
        while True:
            entry = last + self.after if last is not None and not inside else None
            lapse = last + self.until if last is not None else None
            order = waiting[0] if waiting else None
            at = min((x for x in (entry, lapse, order) if x is not None), default=None)
            if at is None or at > now:
                break
            # at one moment an order comes last: who orders on the last day has been in the band
            if at == entry:
                inside = True
                yield Row(customer=key[0], at_us=at, change="entered", last_us=last)
            elif at == lapse:
                yield Row(customer=key[0], at_us=at, change="lapsed", last_us=last)
                last, inside = None, False
            else:
                if inside:
                    yield Row(customer=key[0], at_us=at, change="ordered", last_us=last)
                last, inside, waiting = at, False, waiting[1:]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is None:
            self.state.clear()
        else:
            self.state.update((last, inside, waiting))
            self.handle.registerTimer(-(-at // 1000))

    def close(self) -> None:
        pass


def band_changes(orders: DataFrame, customer: str, ts: str, counts: Column, after: int = 91, until: int = 181, delay: str = "1 day") -> DataFrame:
    """customer, at, change, last_order: when customers enter the band and when they leave it, by order or by lapsing.

    A customer is in the band from ``after`` days after the last order until ``until`` days after it. Rows that do not
    count (``counts`` false) and rows without a customer only move the clock. A change leaves once the watermark has
    passed it; orders older than the watermark are late and dropped.
    """
    rows = event_time(orders, ts, delay).select(
        F.col(customer).cast("string").alias("customer"), F.unix_micros("event_time").alias("at_us"),
        F.coalesce(counts, F.lit(False)).alias("counts"), "event_time",
    )
    changes = rows.groupBy("customer").transformWithState(
        statefulProcessor=Band(after * DAY_US, until * DAY_US),
        outputStructType="customer string, at_us long, change string, last_us long", outputMode="Append", timeMode="EventTime",
    )
    moment = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return changes.select("customer", moment("at_us").alias("at"), "change", moment("last_us").alias("last_order"))


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers needs the RocksDB store; other queries keep the session's."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_band(changes: DataFrame) -> DataFrame:
    """Customers whose last change is an entry, with their last order; ``changes`` may hold rows of replayed batches."""
    rows = changes.drop(BATCH) if BATCH in changes.columns else changes
    # where an entry and the order that ends it fall on one moment, the order came after
    last = rows.groupBy("customer").agg(F.max_by(F.struct("change", "last_order"), F.struct("at", F.col("change") != "entered")).alias("x"))
    return last.filter(F.col("x.change") == "entered").select("customer", F.col("x.last_order").alias("last_order"))
