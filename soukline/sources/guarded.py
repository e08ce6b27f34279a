"""Writes that part and test what they write, tables that are joined without a shuffle, and months rewritten only where they changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soukline.sources.sinks import refresh_months

FAULT = "quarantined"


@dataclass(frozen=True)
class Rules:
    """What a row must satisfy: columns that are not null, foreign keys (column to the table and key it points to), tests."""

    required: tuple[str, ...] = ()
    keys: tuple[tuple[str, DataFrame, str], ...] = ()
    tests: tuple[tuple[str, Column], ...] = ()
    unique: tuple[str, ...] = ()


def write_checked(df: DataFrame, path: str, rules: Rules) -> dict[str, int]:
    """Writes the rows once, tested and with good and faulty ones apart, and tells what was written.

    Counted from the marks and the ``unique`` columns of what was written, no others, so the input and its joins run once:
    ``rows``, rows per broken rule, ``quarantined``, and for ``unique`` columns an estimate of their different values
    (relative error about 1 %). A row goes to quarantine with the names of all rules it breaks. (An observation on the
    write would save this narrow scan, but its listener cannot be serialized with later streams of the session.)
    Foreign keys are looked up by a left join with the keys of their table, as any mart that uses them would.
    """
    looked = df
    missing = []
    for n, (column, table, key) in enumerate(rules.keys):
        known = table.select(F.col(key).alias(f"_k{n}")).distinct()
        looked = looked.join(known, F.col(column) == F.col(f"_k{n}"), "left")
        missing.append((f"{column} in {key}", F.col(column).isNotNull() & F.col(f"_k{n}").isNull()))
    broken = [(f"{c} not null", F.col(c).isNull()) for c in rules.required] + missing
    broken += [(name, ~F.coalesce(test, F.lit(False))) for name, test in rules.tests]
    faults = F.array_compact(F.array(*[F.when(is_bad, F.lit(name)) for name, is_bad in broken]))
    marked = looked.withColumn("faults", faults).withColumn(FAULT, F.size("faults") > 0)
    marked.select(*df.columns, "faults", FAULT).write.mode("overwrite").partitionBy(FAULT).parquet(path)
    written = df.sparkSession.read.parquet(path)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size("faults") > 0).alias(FAULT)]
    counts += [F.count_if(F.array_contains("faults", name)).alias(name) for name, _ in broken]
    counts += [F.approx_count_distinct(c, 0.01).alias(f"{c} different") for c in rules.unique]
    return written.agg(*counts).first().asDict()


def good_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.filter(F.col(FAULT).cast("string") == "false").drop(FAULT, "faults")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Faulty rows with the rules they break."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col(FAULT).cast("string") == "true").drop(FAULT)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table dealt into buckets by ``key`` and sorted in them: tables with the same number join without a shuffle.

    Rows are dealt out by the key before they are written, so each bucket is one file however many tasks there are.
    """
    (
        df.repartition(buckets, key).write.mode("overwrite").format("parquet")
        .bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    )


def changed_months(log: DataFrame, since: int, month: Column, batch: str = "batch") -> DataFrame:
    """The months with rows in batches after ``since`` of a change log."""
    return log.filter(F.col(batch) > since).select(month.alias("month")).distinct()


def refresh_changed(rows: DataFrame, months: DataFrame, path: str, month: str = "purchase_month") -> None:
    """Rebuilds the stored months that ``months`` names, no others.

    ``rows`` is the mart over all of its input; the semi-join's few months reach its scans as a runtime filter where the
    month is stored. Files of other months stay as they are.
    """
    refresh_months(rows.join(F.broadcast(months), F.col(month) == F.col("month"), "left_semi"), path, month)
