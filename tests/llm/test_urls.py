import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from soukline.llm import urls


def frame(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    for name in ("html", "host", "text", "k1", "a", "r", "score", "verdict", "row"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


URLS = (
    [f"http://shop{k}.example.net/de/pills{k}" for k in range(30)]
    + [f"https://blog.example.net/en/post-{k}?x=1" for k in range(30)]
    + [f"https://EXAMPLE.org/fr/{k}#top" for k in range(20)]
    + [f"http://q.example.com/de/{k}.html" for k in range(20)]
    + [f"http://blog.example.com/en/post-{k}" for k in range(9)] + [f"http://shop.example.com/es/pills{k}" for k in range(9)]
    + [None, "", "no scheme", "http://", "http://a.net", "http://a.net?x", "://net/", "http://net/x", "http://xnet/x",
       "http://example.net/en/", "http://a.example.net/en", "mailto://é.org/fr/漢", "a://b://c/d", "http://a.net/\nb", "x" * 3000,
       "http://long.example/" + "y" * 20_000] * 2
)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:at]), rest[at:]
    return host, tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def rule_of(host, path):
    fits = [
        r for r, _ in urls.RULES
        if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])
    ]
    return max(fits, key=len, default=None)


def brute(rows):
    """score and verdict of each url, from plain dictionaries."""
    split = [parts(u) for u in rows]
    says = [dict(urls.RULES).get(rule_of(*p)) for p in split]
    text = [h + p for h, p in split]
    grams = {c: [Counter() for _ in range(urls.ORDER + 1)] for c in ("allow", "block")}
    for t, s in zip(text, says):
        padded = urls.START * urls.ORDER + t + urls.END
        for k in range(urls.ORDER, len(padded)) if s else ():
            for n in range(urls.ORDER + 1):
                grams[s][n][padded[k - n: k + 1]] += 1
    context = {c: [defaultdict(lambda: [0, 0]) for _ in range(urls.ORDER + 1)] for c in grams}
    for c, levels in grams.items():
        for n, table in enumerate(levels):
            for g, count in table.items():
                context[c][n][g[:-1]][0] += count
                context[c][n][g[:-1]][1] += 1

    def p(c, g):
        value = 1 / urls.CHARACTERS
        for n in range(urls.ORDER + 1):
            tail = g[urls.ORDER - n:]
            total, kinds = context[c][n][tail[:-1]]
            if total:
                value = (grams[c][n][tail] + kinds * value) / (total + kinds)
        return value

    score = []
    for t in text:
        padded = urls.START * urls.ORDER + t + urls.END
        gains = [math.log(p("allow", padded[k: k + 5])) - math.log(p("block", padded[k: k + 5])) for k in range(len(t) + 1)]
        score.append(sum(gains) / len(gains))

    def moments(c):
        x = [v for v, s in zip(score, says) if s == c]
        mean = sum(x) / len(x)
        return mean, math.sqrt(max(0, sum(v * v for v in x) / len(x) - mean * mean))

    (ma, wa), (mr, wr) = moments("allow"), moments("block")
    least = (ma * wr + mr * wa) / (wa + wr)
    return [(h, q, rule_of(h, q), v, s or ("allow" if v >= least else "block")) for (h, q), v, s in zip(split, score, says)]


def test_rows_equal_brute_force(spark):
    got = sorted(urls.op8(frame(spark, URLS)).collect())
    for r, (host, path, rule, score, verdict) in zip(got, brute(URLS)):
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
        assert abs(r.score - score) < 3e-6
    unruled = [r for r in got if 100 <= r.page_id < 118]
    assert [r.verdict for r in unruled] == ["allow"] * 9 + ["block"] * 9


def test_no_labels_and_no_rows(spark):
    assert {(r.score, r.verdict) for r in urls.op8(frame(spark, ["http://a.b/c", None])).collect()} == {(0.0, "allow")}
    one = urls.op8(frame(spark, ["http://a.net/x", "http://b.c/d"])).collect()
    assert {r.page_id: r.verdict for r in one}[0] == "block"
    assert urls.op8(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_filter_keeps_columns(spark):
    df = frame(spark, URLS)
    kept = urls.kept(df)
    assert kept.columns == df.columns
    verdicts = {r.page_id: r.verdict for r in urls.op8(df).collect()}
    assert sorted(r.page_id for r in kept.collect()) == sorted(k for k, v in verdicts.items() if v == "allow")


def test_main_path_has_no_python(spark):
    plan = urls.op8(frame(spark, URLS[:5]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
