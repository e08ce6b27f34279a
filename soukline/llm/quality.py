"""Quality rules with adaptive thresholds.

Every text is measured once per pass. Integer measures go into histograms with logarithmic buckets (a quantile sketch:
relative error at most 1/32, merged by adding counts) per language and source. A group's sketch has its language's added to it as if
that were PRIOR rows more, and the language's has all documents' added likewise, so a large group goes by itself, a small
one by its language, and nothing changes at a given size. A measure's fence is an upper quantile of the blended sketch
and a multiple of its distance to the third quartile, or of an eighth of itself if that is more (likewise below, where low
values are bad, too); there is no fixed cutoff and no constant slack.

Defined results: a null or empty text has no words, fails the base rule and is not kept. Null lang or source are
groups of their own. Repeated rows are measured one by one and count as often as they occur. An empty table gives an
empty result. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from soukline.llm.common import cut
from soukline.llm.words import SPACE, Texts, hashes, mix, slices, with_columns

MIN_WORDS = 50
PRIOR = 50
NARROW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
# Measure: (numerator, denominator, scale, upper quantile per mille, multiple of its distance to the third quartile,
# whether a low value is bad too). Symbols are junk where nine of ten texts have none; repeated lines also occur in
# good texts, so their fence lies farther out.
MEASURES = {
    "repeat_share": ("n_repeat_words", "n_words", 1000, 950, 1, False),
    "symbol_share": ("n_symbols", "word_chars", 1000, 900, 3, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000, 990, 1, False),
    "word_length": ("word_chars", "n_words", 100, 950, 2, True),
}

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


def count_text(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of each text."""
    n = len(texts)
    starts, ends, of = texts.words()
    letters = ((texts.data & 0xC0) != 0x80) & ~SPACE[texts.data]
    covered = np.zeros(len(starts), dtype=bool)
    if len(starts) > 2:
        h = hashes(texts.data, starts, ends)
        whole = of[2:] == of[:-2]
        window = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:]) ^ mix(of[:-2].astype(np.uint64))
        sorted_windows = np.sort(window[whole])
        twice = np.unique(sorted_windows[1:][sorted_windows[1:] == sorted_windows[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, window), len(twice) - 1)
            hit = whole & (twice[at] == window)
            covered[:-2] |= hit
            covered[1:-1] |= hit
            covered[2:] |= hit
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n):
        solid = [x for x in texts.raw(k).split(b"\n") if x.strip()]
        lines[k] = len(solid)
        dup[k] = len(solid) - len(set(solid))
    return {
        "n_words": np.bincount(of, minlength=n).astype(np.int64),
        "word_chars": texts.per_text(letters),
        "n_symbols": texts.per_text(SYMBOL[texts.data]),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(of[covered], minlength=n).astype(np.int64),
        "n_lines": lines,
    }


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and the counts of every text; ``docs`` needs text and the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield with_columns(batch, carry, **count_text(texts))

    schema = docs.select(*carry).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    return docs.mapInArrow(run, schema)


def value_of(measure: str) -> Column:
    top, bottom, scale, *_ = MEASURES[measure]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {scale} * {top} DIV {bottom} ELSE 0 END")


def bucket(value: Column) -> Column:
    """The lower edge of a value's bucket: exact below 64, else the value's six leading binary digits."""
    spare = F.length(F.bin(value)) - 6
    width = F.expr("1L").cast("long")
    return F.when(value < 64, value).otherwise(value - value % F.call_function("shiftleft", width, spare))


def sketches(counts: DataFrame) -> DataFrame:
    """(level, lang, source, measure, edge, n): one merged histogram per group of each level."""
    cells = (
        counts.select("lang", "source", F.explode(F.array(*[
            F.struct(F.lit(m).alias("measure"), bucket(value_of(m)).alias("edge")) for m in MEASURES
        ])).alias("x"))
        .groupBy("lang", "source", "x.measure", "x.edge").agg(F.count("*").alias("n"))
    )
    none = F.lit(None).cast("string")
    levels = F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), none.alias("source")),
        F.struct(F.lit(0).alias("level"), none.alias("lang"), none.alias("source")),
    )
    return (
        cells.select(F.explode(levels).alias("g"), "measure", "edge", "n")
        .groupBy("g.level", "g.lang", "g.source", "measure", "edge").agg(F.sum("n").alias("n"))
    )


def fences(counts: DataFrame) -> DataFrame:
    """One row per (lang, source) with a low and a high fence for each measure.

    A quantile is the lower edge of the first bucket that reaches it in the blended sketch.
    """
    merged = cut(sketches(counts))
    order = Window.partitionBy("measure").orderBy("edge")
    every = Window.partitionBy("measure")
    # the sketch of all documents: a few hundred buckets a measure, whatever the input
    whole = merged.filter("level = 0").select(
        "measure", "edge", (F.sum("n").over(order).cast("double") / F.sum("n").over(every)).alias("above")
    )
    langs = _blended(merged.filter("level = 1"), ["lang"], whole.withColumn("lang", F.lit(None).cast("string")), [])
    groups = _blended(merged.filter("level = 2"), ["lang", "source"], langs, ["lang"])
    limits = []
    for m, (_, _, _, high, times, low) in MEASURES.items():
        def quantile(per_mille: int) -> Column:
            return F.min(F.when((F.col("measure") == m) & (F.col("share") * 1000 >= per_mille), F.col("edge")))

        up, down = quantile(high), quantile(1000 - high)
        # equal or nearly equal texts leave no distance: an eighth of the quantile at least
        above = F.greatest(up - quantile(750), F.floor(up / NARROW))
        below = F.greatest(quantile(250) - down, F.floor(down / NARROW))
        limits.append((up + times * above).alias(f"{m}_high"))
        limits.append((down - times * below if low else F.lit(-1).cast("long")).alias(f"{m}_low"))
    shares = groups.withColumnRenamed("above", "share")
    return shares.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*limits)


def _blended(cells: DataFrame, keys: list[str], parent: DataFrame, shared: list[str]) -> DataFrame:
    """keys, measure, edge, above: the share of a group's blended sketch up to each of the parent's buckets.

    ``parent`` has measure, edge, above and, where ``shared``, its own keys.
    """
    groups = cells.groupBy(*keys, "measure").agg(F.sum("n").alias("rows"))
    up = parent.select(*[F.col(k).alias(f"p_{k}") for k in shared], F.col("measure").alias("m"), F.col("edge").alias("e"), "above")
    same = F.col("measure") == F.col("m")
    for k in shared:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    # without keys of its own the parent has a few hundred rows
    grid = groups.join(up if shared else F.broadcast(up), same)
    own = cells.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("measure").alias("o_m"), F.col("edge").alias("o_e"), "n")
    hit = (F.col("m") == F.col("o_m")) & (F.col("e") == F.col("o_e"))
    for k in keys:
        hit = hit & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*keys, "measure").orderBy("e")).cast("double")
    return grid.join(own, hit, "left").select(
        *keys, "measure", F.col("e").alias("edge"), ((upto + PRIOR * F.col("above")) / (F.col("rows") + float(PRIOR))).alias("above")
    )


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, the counts, base_failed, reject_reason and kept, for every row of ``docs`` (text, lang, source).

    The texts are measured in two passes, once for the sketches and once for the verdicts, so nothing but the
    sketches is kept between them.
    """
    limits = fences(measured(docs.select("text", "lang", "source"), ["lang", "source"]))
    kept_names = list(dict.fromkeys([*carry, "lang", "source"]))
    rows = measured(docs, kept_names)
    rows = rows.join(
        limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left"
    )
    base = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")
    reason = F.when(base, F.lit("base"))
    for m in MEASURES:
        reason = reason.when((value_of(m) > F.col(f"{m}_high")) | (value_of(m) < F.col(f"{m}_low")), F.lit(m))
    return rows.select(
        *carry, *COUNTS, base.alias("base_failed"), reason.alias("reject_reason"), reason.isNull().alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns only."""
    rows = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    return judged(rows, ["row"]).filter("kept").select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    """doc_id, counts, verdict and reason of every document."""
    return judged(docs.select("doc_id", "text", "lang", "source"), ["doc_id"]).drop("n_lines")


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, i AS p FROM again UNION ALL SELECT r, i + 1 FROM again UNION ALL SELECT r, i + 2 FROM again)
  GROUP BY r),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines
  FROM docs JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
measures AS (
  SELECT *, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS v1,
    CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS v2,
    CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS v3,
    CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS v4
  FROM counts),
cells AS (
  SELECT level, CASE WHEN level > 0 THEN lang END AS lang, CASE WHEN level > 1 THEN source END AS source, m,
    CASE WHEN v < 64 THEN v ELSE v - v % (1::BIGINT << (length(bin(v)) - 6)) END AS edge
  FROM (SELECT lang, source, unnest([1, 2, 3, 4]) AS m, unnest([v1, v2, v3, v4]) AS v FROM measures),
    (SELECT unnest([0, 1, 2]) AS level)),
grouped AS (SELECT level, lang, source, m, edge, count(*) AS n FROM cells GROUP BY ALL),
whole AS (
  SELECT m, edge, sum(n) OVER (PARTITION BY m ORDER BY edge)::DOUBLE / sum(n) OVER (PARTITION BY m) AS above
  FROM grouped WHERE level = 0),
langs AS (
  SELECT g.lang, g.m, w.edge, (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.m ORDER BY w.edge)::DOUBLE + 50 * above)
    / (g.total + 50::DOUBLE) AS above
  FROM (SELECT lang, m, sum(n) AS total FROM grouped WHERE level = 1 GROUP BY ALL) g JOIN whole w USING (m)
  LEFT JOIN grouped c ON c.level = 1 AND c.lang IS NOT DISTINCT FROM g.lang AND c.m = g.m AND c.edge = w.edge),
shares AS (
  SELECT g.lang, g.source, g.m, w.edge, 1000 * ((sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source, g.m ORDER BY w.edge)::DOUBLE
    + 50 * above) / (g.total + 50::DOUBLE)) AS s
  FROM (SELECT lang, source, m, sum(n) AS total FROM grouped WHERE level = 2 GROUP BY ALL) g
  JOIN langs w ON w.lang IS NOT DISTINCT FROM g.lang AND w.m = g.m
  LEFT JOIN grouped c ON c.level = 2 AND c.lang IS NOT DISTINCT FROM g.lang AND c.source IS NOT DISTINCT FROM g.source
    AND c.m = g.m AND c.edge = w.edge),
quantiles AS (
  SELECT lang, source, m, min(edge) FILTER (s >= 50) AS q05, min(edge) FILTER (s >= 250) AS q25, min(edge) FILTER (s >= 750) AS q75,
    min(edge) FILTER (s >= 900) AS q90, min(edge) FILTER (s >= 950) AS q95, min(edge) FILTER (s >= 990) AS q99
  FROM shares GROUP BY ALL),
limits AS (
  SELECT lang, source, max(q95 + 1 * greatest(q95 - q75, q95 // 8)) FILTER (m = 1) AS h1,
    max(q90 + 3 * greatest(q90 - q75, q90 // 8)) FILTER (m = 2) AS h2,
    max(q99 + 1 * greatest(q99 - q75, q99 // 8)) FILTER (m = 3) AS h3,
    max(q95 + 2 * greatest(q95 - q75, q95 // 8)) FILTER (m = 4) AS h4,
    max(q05 - 2 * greatest(q25 - q05, q05 // 8)) FILTER (m = 4) AS l4
  FROM quantiles GROUP BY ALL),
judged AS (
  SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, f
  FROM measures c JOIN limits f ON f.lang IS NOT DISTINCT FROM c.lang AND f.source IS NOT DISTINCT FROM c.source),
reasons AS (
  SELECT *, CASE WHEN base_failed THEN 'base' WHEN v1 > f.h1 THEN 'repeat_share' WHEN v2 > f.h2 THEN 'symbol_share'
    WHEN v3 > f.h3 THEN 'dup_line_share' WHEN v4 > f.h4 OR v4 < f.l4 THEN 'word_length' END AS reject_reason
  FROM judged)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reject_reason,
  reject_reason IS NULL AS kept
FROM reasons
"""
