"""Writers: staged tables, metric documents, named tables and views, landings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soukline.session import shuffles_freed
from soukline.sources.tables import TIMESTAMP_FORMAT


def write_stage(frames: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        with shuffles_freed(df.sparkSession):
            if fmt == "csv":
                writer.option("header", True).option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(f"{root}/{name}")
            else:
                writer.parquet(f"{root}/{name}")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A metrics frame has one row, so one output file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def register_views(frames: dict[str, DataFrame], prefix: str = "") -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def refresh_months(df: DataFrame, path: str, month: str = "purchase_month") -> None:
    """Rewrite only the months present in ``df``; other partitions stay.

    Rows are clustered by month, and a month is split into as many tasks as its size asks for.
    """
    (
        df.hint("rebalance", F.col(month))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(month)
        .parquet(path)
    )


def land_daily(df: DataFrame, path: str, ts: Column, mode: str = "append") -> None:
    (
        df.withColumn("year", F.year(ts))
        .withColumn("month", F.month(ts))
        .withColumn("day", F.dayofmonth(ts))
        .hint("rebalance", F.col("year"), F.col("month"), F.col("day"))
        .write.mode(mode)
        .partitionBy("year", "month", "day")
        .parquet(path)
    )


def day_series(spark: SparkSession, first: Column, last: Column, bounds: DataFrame | None = None) -> DataFrame:
    """One row per calendar day between two date expressions, both included."""
    source = bounds if bounds is not None else spark.range(1)
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return source.select(F.explode(days).alias("date"))
