"""URL filter by the ratio of two character language models.

Rules come first: a rule fits its host and all subdomains if the path starts with the rule's, and the longest rule wins.
The urls that rules allow and those that they block each give a smoothed variable-order Markov model of host and path:
the probability of a character after up to ORDER characters, interpolated (Witten-Bell) from the longest context that the
class has seen down to no context at all. A url's score is the mean over its characters of log P(allowed) - log
P(blocked), and urls without a rule are blocked below a cut calibrated between the two classes' scores. Counts cover all
urls; the models stay tables, joined by n-gram, and everything is DataFrame functions.

Logarithms are summed as whole millionths, so results do not depend on the order of rows.

Defined results: a null url or one without ``://`` has empty host and path, no rule, and is judged like any other. Without
urls of both classes the cut is 0, and a class without urls gives every character the same probability. Repeated rows
count as often as they occur. An empty table gives an empty result. Only page_id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soukline.llm.common import cut

ORDER = 4
CHARACTERS = 256
MICRO = 1_000_000
# (rule, verdict); host and path are split at the first slash.
RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
START, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with host, path and the longest rule that fits."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    rows = pages.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", F.regexp_extract(tail, r"^[^?#]*", 0))
    return rows.withColumn("rule", longest_rule())


def longest_rule() -> Column:
    found = F.lit(None).cast("string")
    for rule, _ in sorted(RULES, key=lambda r: len(r[0])):
        name, slash, path = rule.partition("/")
        host = (F.col("host") == name) | F.col("host").endswith("." + name)
        found = F.when(host & F.col("path").startswith(slash + path), F.lit(rule)).otherwise(found)
    return found


def _label() -> Column:
    verdict = F.lit(None).cast("string")
    for rule, says in RULES:
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    return verdict


def windows(strings: DataFrame) -> DataFrame:
    """``strings`` (text and others), one row per character: the character with the ORDER before it."""
    padded = F.concat(F.lit(START * ORDER), F.col("text"), F.lit(END))
    places = F.explode(F.sequence(F.lit(1), F.length("text") + 1))
    return strings.withColumn("padded", padded).withColumn("place", places).withColumn(
        "window", F.substring(F.col("padded"), F.col("place"), F.lit(ORDER + 1))
    ).drop("padded", "place", "text")


def model(counts: DataFrame) -> DataFrame:
    """(window, gain): millionths of log P(allowed) - log P(blocked) of the last character after the others.

    ``counts`` has window, a and r: its occurrences in allowed and in blocked urls.
    """
    lower = None
    for k in range(ORDER + 1):
        gram = F.substring(F.col("window"), ORDER + 1 - k, k + 1) if k < ORDER else F.col("window")
        grams = counts.groupBy(gram.alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.substring(F.col("gram"), 1, k)
        totals = grams.groupBy(context.alias("context")).agg(
            F.sum("a").alias("all_a"), F.sum("r").alias("all_r"),
            F.count_if(F.col("a") > 0).alias("kinds_a"), F.count_if(F.col("r") > 0).alias("kinds_r"),
        )
        rows = grams.withColumn("context", context).join(totals, "context")
        if lower is None:
            even = F.lit(1.0 / CHARACTERS)
            rows = rows.withColumn("low_a", even).withColumn("low_r", even)
        else:
            rows = rows.withColumn("shorter", F.substring(F.col("gram"), 2, k)).join(lower, "shorter")
        for c in ("a", "r"):
            seen = F.col(f"all_{c}") + F.col(f"kinds_{c}")
            rows = rows.withColumn(
                f"p_{c}", F.when(seen > 0, (F.col(c) + F.col(f"kinds_{c}") * F.col(f"low_{c}")) / seen).otherwise(F.col(f"low_{c}"))
            )
        lower = rows.select(F.col("gram").alias("shorter"), F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
    gain = F.round((F.ln("low_a") - F.ln("low_r")) * MICRO).cast("long")
    return lower.select(F.col("shorter").alias("window"), gain.alias("gain"))


def scored(strings: DataFrame) -> DataFrame:
    """(k1, k2, score): mean gain of each different text; ``strings`` has text, k1, k2, a and r."""
    places = cut(windows(strings))
    counts = cut(places.groupBy("window").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    gains = places.select("k1", "k2", "window").join(model(counts), "window")
    return gains.groupBy("k1", "k2").agg((F.sum("gain") / F.count("*") / MICRO).alias("score"))


def judged(pages: DataFrame) -> DataFrame:
    """``pages`` (with url, and none of the names added here) with host, path, rule, score and verdict."""
    text = F.concat("host", "path")
    rows = parsed(pages).withColumn("k1", F.xxhash64(text)).withColumn("k2", F.hash(text))
    label = _label()
    strings = rows.groupBy("k1", "k2").agg(
        F.first(text).alias("text"), F.count_if(label == "allow").alias("a"), F.count_if(label == "block").alias("r")
    )
    strings = cut(strings)
    scores = cut(scored(strings).join(strings.select("k1", "k2", "a", "r"), ["k1", "k2"]))
    # the cut lies between the class means, nearer to the narrower class
    def moments(c):
        mean = F.sum(F.col("score") * F.col(c)) / F.sum(c)
        square = F.sum(F.col("score") * F.col("score") * F.col(c)) / F.sum(c)
        return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))

    (mean_a, wide_a), (mean_r, wide_r) = moments("a"), moments("r")
    middle = F.when(wide_a + wide_r > 0, (mean_a * wide_r + mean_r * wide_a) / (wide_a + wide_r)).otherwise((mean_a + mean_r) / 2)
    with_both = scores.agg(F.when((F.sum("a") > 0) & (F.sum("r") > 0), F.round(middle, 6)).otherwise(0.0))
    verdict = F.coalesce(label, F.when(F.col("score") >= with_both.scalar(), "allow").otherwise("block"))
    return (
        rows.join(scores.select("k1", "k2", F.round("score", 6).alias("score")), ["k1", "k2"], "left")
        .withColumn("verdict", verdict).drop("k1", "k2")
    )


def kept(pages: DataFrame) -> DataFrame:
    """The rows whose url is allowed, with their own columns only."""
    rows = judged(pages.select(F.struct("*").alias("row"), "url"))
    return rows.filter("verdict = 'allow'").select("row.*")


def op8(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def _oracle() -> str:
    grams = []
    for k in range(ORDER + 1):
        lower = (
            f"1.0::DOUBLE / {CHARACTERS} AS low_a, 1.0::DOUBLE / {CHARACTERS} AS low_r FROM g{k} JOIN t{k} USING (context)"
            if k == 0 else
            f"l.p_a AS low_a, l.p_r AS low_r FROM g{k} JOIN t{k} USING (context) JOIN p{k - 1} l ON l.gram = substr(g{k}.gram, 2)"
        )
        grams.append(f"""
g{k} AS (SELECT gram, substr(gram, 1, {k}) AS context, sum(a) AS a, sum(r) AS r
  FROM (SELECT substr(win, {ORDER + 1 - k}) AS gram, a, r FROM counts) GROUP BY gram),
t{k} AS (SELECT context, sum(a) AS all_a, sum(r) AS all_r, count(*) FILTER (a > 0) AS kinds_a,
  count(*) FILTER (r > 0) AS kinds_r FROM g{k} GROUP BY context),
p{k} AS (SELECT gram,
  CASE WHEN all_a + kinds_a > 0 THEN (a + kinds_a * low_a) / (all_a + kinds_a) ELSE low_a END AS p_a,
  CASE WHEN all_r + kinds_r > 0 THEN (r + kinds_r * low_r) / (all_r + kinds_r) ELSE low_r END AS p_r
  FROM (SELECT g{k}.gram, g{k}.a, g{k}.r, all_a, all_r, kinds_a, kinds_r, {lower})),""")
    order = sorted(RULES, key=lambda r: -len(r[0]))
    cases = []
    for rule, _ in order:
        host, slash, path = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{rule}'")
    says = " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in RULES)
    return f"""
WITH split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM split)),
ruled AS (SELECT *, CASE {' '.join(cases)} END AS rule FROM parsed),
labelled AS (SELECT *, host || path AS s, CASE rule {says} END AS says FROM ruled),
strings AS (SELECT s, count(*) FILTER (says = 'allow') AS a, count(*) FILTER (says = 'block') AS r FROM labelled GROUP BY s),
places AS (
  SELECT s, a, r, substr(repeat(chr(2), {ORDER}) || s || chr(3), i, {ORDER + 1}) AS win
  FROM (SELECT s, a, r, unnest(range(1, length(s) + 2)) AS i FROM strings)),
counts AS (SELECT win, sum(a) AS a, sum(r) AS r FROM places GROUP BY win),{''.join(grams)}
gains AS (SELECT gram AS win, CAST(round((ln(p_a) - ln(p_r)) * {MICRO}) AS BIGINT) AS gain FROM p{ORDER}),
scores AS (
  SELECT s, any_value(a) AS a, any_value(r) AS r, sum(gain)::DOUBLE / count(*) / {MICRO} AS score
  FROM places JOIN gains USING (win) GROUP BY s),
moments AS (
  SELECT sum(a) AS n_a, sum(r) AS n_r, sum(score * a) / sum(a) AS m_a, sum(score * r) / sum(r) AS m_r,
    sqrt(greatest(sum(score * score * a) / sum(a) - (sum(score * a) / sum(a)) ** 2, 0)) AS w_a,
    sqrt(greatest(sum(score * score * r) / sum(r) - (sum(score * r) / sum(r)) ** 2, 0)) AS w_r
  FROM scores),
cut AS (
  SELECT CASE WHEN n_a > 0 AND n_r > 0 THEN round(
    CASE WHEN w_a + w_r > 0 THEN (m_a * w_r + m_r * w_a) / (w_a + w_r) ELSE (m_a + m_r) / 2 END, 6) ELSE 0 END AS least
  FROM moments)
SELECT page_id, host, path, rule,
  coalesce(says, CASE WHEN score >= (SELECT least FROM cut) THEN 'allow' ELSE 'block' END) AS verdict,
  round(score, 6) AS score
FROM labelled JOIN scores USING (s)
"""


ORACLE = _oracle()
