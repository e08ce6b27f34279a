"""Typed scans: raw CSV files, staged Parquet, partitioned landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from soukline.sources.tables import SCHEMAS, TIMESTAMP_FORMAT, Tables


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Schema is given, never inferred, so zip prefixes keep leading zeros."""
    return (
        spark.read.schema(SCHEMAS[table])
        .option("header", True)
        .option("timestampNTZFormat", TIMESTAMP_FORMAT)
        .option("multiLine", table == "reviews")
        .option("escape", '"')
        .csv(path)
    )


def read_csv_tables(spark: SparkSession, paths: dict[str, str]) -> Tables:
    return Tables(**{name: read_csv(spark, paths[name], name) for name in SCHEMAS})


def read_stage(spark: SparkSession, root: str) -> Tables:
    return Tables(**{name: spark.read.parquet(f"{root}/{name}") for name in SCHEMAS})
