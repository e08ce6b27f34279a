"""What the operators share: session settings, cut lineage, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from soukline.session import cut, scratch_path, tune

# Applied unless the session has a value of its own: a batch of whole texts must fit a Python worker.
BATCH_ROWS = 1000


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the library, with Arrow batches small enough for whole texts."""
    tune(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written as Parquet to a fresh shared folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of type long); root is the least node of the component.

    Alternating large-star and small-star rounds. Each round keeps at most one row per edge, and holds no node's
    neighbours as one group (minimum, then join); the edges to a node's lesser neighbours meet in one task, as rows of
    two longs. Both tables of a round are cut in the shared folder. The rounds end when each node has one neighbour, a
    lesser one, or only greater ones: these are stars around least nodes. Self-loops and repeated edges do no harm; no
    edges, no rows.
    """
    now = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        nodes = cut(
            now.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))").groupBy("a")
            .agg(F.min("b").alias("m"), F.max("b").alias("most"))
            .select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.expr("m > a OR m = most").alias("done"))
        )
        if nodes.filter("NOT done").isEmpty():
            return nodes.select("node", "root")
        large = now.join(nodes, now.b == nodes.node).select("a", F.col("root").alias("b")).repartition("a").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(large.join(small, "a").select(F.expr("if(b = m, a, b)").alias("a"), F.col("m").alias("b")))


def first_by_hash(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """About the n rows of each group of ``by`` that come first by a hash of ``key``, and never more; adds pick.

    A first cut at twice the share wanted leaves few rows to rank, whatever a group holds. ``by`` is a model's label, for
    which the model itself has a column, so one row per value is few rows.
    """
    sizes = rows.groupBy(by).agg(F.count("*").alias("_all"))
    pick = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = rows.join(F.broadcast(sizes), by).withColumn("pick", pick).filter(F.col("pick") * F.col("_all") <= 2 * n)
    place = F.row_number().over(Window.partitionBy(by).orderBy("pick", key))
    return near.withColumn("_place", place).filter(F.col("_place") <= n).drop("_all", "_place")


def one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: that of the least hash of its text, ties by the text; the limit is met before rows are dealt out."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text"), "text"))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
