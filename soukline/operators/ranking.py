"""Whole-relation ranks, tiles, running totals and percentiles without a
single-partition window.

The rows are range-partitioned on the sort keys, numbered inside each partition
and checkpointed. Only one summary row per partition (never more than the
shuffle partition count) is then windowed to get the offset of every partition.
The checkpoint matters: range boundaries are sampled, so a recomputed partition
could otherwise disagree with offsets taken from the first computation.

Sort keys must end in a unique column, or be distinct already, so that a value
shared by many rows can still be split over partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from soukline.session import shared_dir, stored

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low bits


def range_blocks(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds __block (ordered partition number) and __pos (row number inside it)."""
    shared_dir(df.sparkSession)
    at = F.monotonically_increasing_id()
    return stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__at", at)
        .withColumn("__block", F.shiftright("__at", _ROW_BITS))
        .withColumn("__pos", F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("__at")
    )


def _before(totals: DataFrame, column: str) -> Column:
    """Sum of ``column`` over the earlier blocks; totals has one row per block."""
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


def _numbered(blocks: DataFrame) -> DataFrame:
    """Adds __row (1-based position in the whole order) and __rows (row count)."""
    totals = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    offsets = totals.select(
        "__block",
        _before(totals, "__n").alias("__start"),
        F.sum("__n").over(Window.partitionBy()).alias("__rows"),
    )
    # Bound: one row per shuffle partition.
    return (
        blocks.join(F.broadcast(offsets), "__block")
        .withColumn("__row", F.col("__start") + F.col("__pos") + 1)
        .drop("__start")
    )


def row_numbers(df: DataFrame, order: list, out: str) -> DataFrame:
    numbered = _numbered(range_blocks(df, *order))
    return numbered.withColumn(out, F.col("__row")).drop("__block", "__pos", "__row", "__rows")


def ntile(df: DataFrame, tiles: int, order: list, out: str) -> DataFrame:
    """NTILE over the whole relation: the first rows % tiles tiles get one more row."""
    numbered = _numbered(range_blocks(df, *order))
    size = F.floor(F.col("__rows") / tiles)
    larger = F.col("__rows") % tiles
    edge = larger * (size + 1)
    in_larger = F.floor((F.col("__row") - 1) / (size + 1)) + 1
    in_rest = larger + F.floor(F.try_divide(F.col("__row") - edge - 1, size)) + 1
    tile = F.when(F.col("__row") <= edge, in_larger).otherwise(in_rest)
    return numbered.withColumn(out, tile.cast("int")).drop("__block", "__pos", "__row", "__rows")


def running_totals(df: DataFrame, order: list, sums: dict[str, str], ranks: dict[str, str] | None = None) -> DataFrame:
    """Running ROWS sums and dense ranks in one pass.

    ``sums`` maps an output name to the column it accumulates; ``<name>_total``
    holds the grand total. ``ranks`` maps an output name to the leading sort
    column whose distinct values are counted.
    """
    blocks = range_blocks(df, *order)
    inside = Window.partitionBy("__block").orderBy("__pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = ranks or {}

    step = blocks
    for out, column in ranks.items():
        changed = F.when(F.lag(column).over(inside).isNull(), 0).otherwise(
            (F.lag(column).over(inside) != F.col(column)).cast("int")
        )
        step = step.withColumn(f"__new_{out}", changed)

    per_block = [F.sum(column).alias(f"__s_{out}") for out, column in sums.items()]
    for out, column in ranks.items():
        per_block += [
            F.sum(f"__new_{out}").alias(f"__s_{out}"),
            F.min_by(column, "__pos").alias(f"__first_{out}"),
            F.max_by(column, "__pos").alias(f"__last_{out}"),
        ]
    totals = step.groupBy("__block").agg(*per_block)
    by_block = Window.orderBy("__block")
    for out in ranks:
        previous = F.lag(f"__last_{out}").over(by_block)
        starts_new = F.when(previous.isNull(), 1).otherwise(
            (previous != F.col(f"__first_{out}")).cast("int")
        )
        totals = totals.withColumn(f"__edge_{out}", starts_new)
    for out in ranks:
        totals = totals.withColumn(f"__s_{out}", F.col(f"__s_{out}") + F.col(f"__edge_{out}"))
    offsets = totals.select(
        "__block",
        *[_before(totals, f"__s_{out}").alias(f"__b_{out}") for out in [*sums, *ranks]],
        *[F.sum(f"__s_{out}").over(Window.partitionBy()).alias(f"{out}_total") for out in sums],
        *[f"__edge_{out}" for out in ranks],
    )
    # Bound: one row per shuffle partition.
    joined = step.join(F.broadcast(offsets), "__block")
    for out, column in sums.items():
        joined = joined.withColumn(out, F.sum(column).over(upto) + F.col(f"__b_{out}"))
    for out in ranks:
        joined = joined.withColumn(
            out,
            (F.sum(f"__new_{out}").over(upto) + F.col(f"__b_{out}") + F.col(f"__edge_{out}")).cast("int"),
        )
    return joined.select(*df.columns, *sums, *[f"{out}_total" for out in sums], *ranks)


def percentiles(
    df: DataFrame, value: str, points: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group.

    Equal values are first collapsed to a count, so a value held by most rows
    is one row here, and the ranks come from a distributed running total.
    Nulls are ignored. A group without values gives no row.
    """
    by = by or []
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = running_totals(counts, [*by, "_v"], {"_upto": "_c"})
    if by:
        groups = ranked.groupBy(*by).agg(
            F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_start")
        )
        ranked = ranked.join(groups, by)
    else:
        ranked = ranked.withColumn("_n", F.col("_upto_total")).withColumn("_start", F.lit(0))
    high = F.col("_upto") - F.col("_start")
    low = high - F.col("_c")
    aggregates, outputs = [], []
    for out, p in points.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (low <= k) & (k < high)
            aggregates.append(F.max(F.when(holds, F.col("_v").cast("double"))).alias(f"_{side}_{out}"))
        share = (F.col("_n") - 1) * F.lit(float(p))
        fraction = share - F.floor(share)
        outputs.append(
            (F.col(f"_lo_{out}") + (F.col(f"_hi_{out}") - F.col(f"_lo_{out}")) * fraction).alias(out)
        )
    picked = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *aggregates)
    return picked.select(*by, *outputs)


def leading_share(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """One row about the top ``fraction`` of rows by value.

    The member count is max(1, round(rows * fraction)); rows equal to the last
    member all belong, so ties are kept. ``cutoff`` is the last member's value.
    """
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_totals(counts, [F.col("_v").desc()], {"_upto": "_c"})
    wanted = F.greatest(F.lit(1), F.floor(F.col("_upto_total") * F.lit(fraction) + F.lit(0.5)))
    inside = (F.col("_upto") - F.col("_c")) < wanted
    return ranked.agg(
        F.sum("_c").alias("members"),
        F.sum(F.when(inside, F.col("_c"))).alias("leading"),
        F.sum(F.when(inside, F.col("_v") * F.col("_c"))).alias("leading_value"),
        F.sum(F.col("_v") * F.col("_c")).alias("whole_value"),
        F.min(F.when(inside, F.col("_v"))).alias("cutoff"),
    )


def share_of_total(df: DataFrame, column: str) -> Column:
    """Percent of the grand total; only for results of bounded size."""
    whole = F.sum(column).over(Window.partitionBy())
    return F.try_divide(F.col(column).cast("double") * F.lit(100.0), whole.cast("double"))
