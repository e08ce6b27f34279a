"""Mixing sources to target weights by weighted sampling without replacement.

Sources, ordered by code point, weigh 5, 2, 1 in turn and share 150 % of all words; no target exceeds twice its source,
and what that leaves over is shared again by weight (the level is found by one ordered pass over the sources). Whole
epochs are taken first. The rest of a target is a sample: each document has the exponential key -ln(u) / w, with u from
a digest of its id and w its quality weight, and a source's documents are taken in key order up to the budget; the last
is taken if at least half of it fits. The prefix sums are split by ranges of the key, so no source is one group.

Defined results: a null or empty text has size 0 and is never taken. Null source is a source of its own, the last. Ties
in the key are ordered by doc_id, then size; of rows equal in all three as many are taken as fit, those of the least hash
of their other columns first. An empty table gives an empty result. ``mixed`` returns its input's columns only, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from soukline.llm.common import cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
RANGES = 1024
SALTS = 64
# Plans of so many sources, some 100 bytes each, are sent to every task; more are joined by salted shuffles.
FEW_SOURCES = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(text: str = "text", size: str = "size") -> Column:
    """Quality: longer texts (up to 200 words) and usual word lengths weigh more; from 0.125 to 1."""
    mean = F.length(text) / F.greatest(F.col(size), F.lit(1))
    length = F.when((mean >= 4) & (mean <= 11), 1.0).otherwise(0.5)
    return (F.lit(0.25) + F.lit(0.75) * F.least(F.col(size), F.lit(200)) / F.lit(200)) * length


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text and any others) with size and the sampling key."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    sized = docs.withColumn("size", size_of())
    return sized.withColumn("key", -F.ln(u) / F.coalesce(weight_of(), F.lit(1.0)))


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): one row per source; ``sized`` needs source and size."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row per source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), (place - 1) % 3 + 1))
    order = Window.orderBy(F.col("source_size") * MOST / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    ranked = weighed.withColumn("level", level).withColumn("pos", F.row_number().over(order))
    ranked = ranked.withColumn("capped", F.col("source_size") * MOST <= F.col("w") * F.col("level"))
    shared = F.min_by("level", F.when(~F.col("capped"), F.col("pos"))).over(every)
    return ranked.withColumn("shared", shared).select(
        "source", "source_size",
        F.when(F.col("capped"), (F.col("source_size") * MOST).cast("double")).otherwise(F.col("w") * F.col("shared")).alias("target"),
    )


def plan(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(source, source_size, target, epochs, last): per source, what is taken; ``last`` is the sample's last document.

    ``rows`` needs doc_id, source, size and key.
    """
    goal = targets(rows).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    ranged = rows.filter("size > 0").select("doc_id", "source", "size", "key", range_of(ranges).alias("part"))
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    edges = starts.join(goal.select("source", "rest"), starts["source"].eqNullSafe(goal["source"]))
    # each source has one range in which its budget ends, and the documents before it only count
    edges = edges.filter("before <= rest AND rest < before + n").select(
        starts["source"].alias("s"), F.col("part").alias("p"), "before", "rest"
    )
    # equal rows are one row with a number, so a document that fills a range is no large group
    inside = ranged.join(edges, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    inside = inside.groupBy("s", "p", "key", "doc_id", "size").agg(F.count("*").alias("k"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = Window.partitionBy("s", "p").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    ahead = F.coalesce(F.sum(F.col("k") * F.col("size")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the last one counts if half of it fits
    fit = F.floor((2 * F.col("rest") + F.col("size") - 2 * (F.col("before") + ahead)) / (2 * F.col("size")))
    taken = inside.withColumn("held", F.least("k", fit)).filter("held > 0")
    lasts = taken.groupBy("s").agg(F.max(F.struct(order_of().alias("last"), "held")).alias("x")).select("s", "x.last", "x.held")
    goal = goal.join(edges.select("s", F.col("p").alias("part")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return goal.join(lasts, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "epochs", "part", "last", "held"
    )


def range_of(ranges: int = RANGES) -> Column:
    """The key's range, on a logarithmic scale.

    A weight only shifts the logarithm of an exponential key, whose density is at most 1 / e. So a range holds about
    1 / (e * ranges) of a source's documents at most, whatever their weights.
    """
    return F.floor(F.ln("key") * ranges)


def order_of() -> Column:
    return F.struct("key", F.col("doc_id").isNull().alias("last"), "doc_id", "size")


def _tied() -> Column:
    """Whether a row equals the sample's last document, of whose rows only some may be taken."""
    return F.coalesce(order_of() == F.col("g.last"), F.lit(False))


def copies_of(ranges: int = RANGES) -> Column:
    """How often a document is taken, after the join with ``plan`` as struct ``g``; tied rows need ``nth``."""
    part = range_of(ranges)
    last = (order_of() < F.col("g.last")) | (_tied() & (F.col("nth") <= F.col("g.held")))
    sampled = (part < F.col("g.part")) | ((part == F.col("g.part")) & last)
    return F.when(F.col("size") == 0, 0).otherwise(
        F.col("g.epochs") + F.when(F.coalesce(sampled, F.lit(False)), 1).otherwise(0)
    ).cast("long")


def _with_plan(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """``rows`` with their source's plan as struct ``g``."""
    g = plans.select(F.col("source").alias("g_source"), F.struct("source_size", "target", "epochs", "part", "last", "held").alias("g"))
    mine = F.col("source").eqNullSafe(F.col("g_source"))
    if plans.count() <= FEW_SOURCES:
        return rows.join(F.broadcast(g), mine, "left")
    # a source may hold any share of the rows: its one row is repeated per salt, its documents are dealt over the salts
    g = g.withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return rows.join(g, mine & (salt == F.col("g_salt")), "left")


def _numbered(ties: DataFrame) -> DataFrame:
    """Tied rows (with ``h``) with nth, their number in their source by ``h``.

    Rows of one ``h`` are equal and numbered in blocks, those of a task, so no source or document is one group.
    """
    rows = cut(ties.withColumn("block", F.spark_partition_id()))
    block = ["g_source", "h", "block"]
    counts = rows.groupBy(*block).agg(F.count("*").alias("k"))
    before = Window.partitionBy("g_source").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(
        F.col("g_source").alias("o_source"), F.col("h").alias("o_h"), F.col("block").alias("o_block"),
        F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead"),
    )
    own = F.row_number().over(Window.partitionBy(*block).orderBy("h"))
    same = F.col("g_source").eqNullSafe(F.col("o_source")) & (F.col("h") == F.col("o_h")) & (F.col("block") == F.col("o_block"))
    return rows.withColumn("own", own).join(ahead, same).withColumn("nth", F.col("ahead") + F.col("own")).drop(
        "own", "ahead", "block", "o_source", "o_h", "o_block"
    )


def placed(rows: DataFrame, tied: DataFrame, plans: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``rows`` (source, doc_id, size, key, h) with ``g`` and copies, how often each is taken.

    ``tied`` has the same rows, or those of them that have a source's last doc_id at least.
    """
    ties = _numbered(_with_plan(tied, plans).filter(_tied()))
    others = _with_plan(rows, plans).filter(~_tied()).withColumn("nth", F.lit(None).cast("long"))
    if "g_salt" in others.columns:
        others, ties = others.drop("g_salt"), ties.drop("g_salt")
    return others.unionByName(ties).withColumn("copies", copies_of(ranges))


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = cut(keyed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "key"))
    plans = cut(plan(rows))
    # rows of one document and size give equal results, whichever of them are taken
    rows = rows.withColumn("h", F.lit(0).cast("long"))
    return placed(rows, rows, plans).select(
        "doc_id", "size", F.col("g.source_size").alias("source_size"), F.col("g.target").alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text", F.xxhash64(*docs.columns).alias("h"))
    plans = cut(plan(cut(keyed(rows.select("doc_id", "source", "text")).select("doc_id", "source", "size", "key"))))
    lasts = plans.select(F.col("source").alias("l_source"), F.col("last.doc_id").alias("l_id"))
    lasts = F.broadcast(lasts) if plans.count() <= FEW_SOURCES else lasts
    same = F.col("source").eqNullSafe(F.col("l_source")) & F.col("doc_id").eqNullSafe(F.col("l_id"))
    # words are counted for all rows once here, and again only for rows of the last documents
    tied = keyed(rows.join(lasts, same, "left_semi")).drop("text")
    found = placed(keyed(rows).drop("text"), tied, plans).filter(F.col("copies") > 0)
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(length(text) AS DOUBLE) AS chars,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    (CAST('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13] AS BIGINT) + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln(u) / coalesce((0.25::DOUBLE + 0.75::DOUBLE * least(size, 200) / 200)
    * CASE WHEN chars / greatest(size, 1) BETWEEN 4 AND 11 THEN 1::DOUBLE ELSE 0.5::DOUBLE END, 1) AS key
  FROM docs),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM keyed GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER before, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
    CASE WHEN 2 * source_size <= w * level THEN CAST(2 * source_size AS DOUBLE)
      ELSE w * (SELECT arg_min(level, source_size * 2 / w) FROM levels WHERE 2 * source_size > w * level) END AS target
  FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
