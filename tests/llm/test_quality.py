import re
from collections import Counter

from pyspark.sql import functions as F

from soukline.llm import quality

from .conftest import clean, odd_rows

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k: k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) for d in range(3) if grams[tuple(w[k: k + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force_on_odd_rows(odd):
    got = quality.op10(odd).select("doc_id", *quality.COUNTS[:5], "base_failed", "kept").collect()
    want = []
    for doc_id, text, *_ in odd_rows():
        n = brute(text)
        want.append((doc_id, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted(map(str, (tuple(r)[:-1] for r in got))) == sorted(map(str, want))
    assert all(not r.kept for r in got if r.base_failed)


def test_overlapping_windows_and_repeated_lines(documents):
    docs = documents([(1, "a a a a"), (2, "x y z x y z"), (3, "l m\nl m\n\n \nl m\nl m "), (4, "a b\x85c d")])
    got = {r.doc_id: (r.n_repeat_words, r.n_dup_lines, r.n_words) for r in quality.op10(docs).collect()}
    assert got == {1: (4, 0, 4), 2: (6, 0, 6), 3: (8, 2, 8), 4: (0, 0, 3)}


def test_thresholds_follow_the_group(documents):
    marked = [(k, clean(k) + " # # # # # # # #", "en", "forum") for k in range(400)]
    plain = [(1000 + k, clean(k), "en", "news") for k in range(400)]
    odd_one = [(5000, clean(7) + " " + " ".join(f"x{k}###" for k in range(40)), "en", "news")]
    rows = quality.op10(documents(marked + plain + odd_one)).collect()
    assert {r.doc_id for r in rows if not r.kept} == {5000}
    assert {r.reject_reason for r in rows} == {None, "symbol_share"}


def test_sketches_merge(documents):
    docs = documents([(k, clean(k, words=60 + k % 40), "en" if k % 3 else None, f"s{k % 2}") for k in range(300)])
    counts = quality.measured(docs, ["lang", "source"])
    cells = quality.sketches(counts)
    by_level = {r.level: r.n for r in cells.filter("measure = 'word_length'").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert by_level == {0: 300, 1: 300, 2: 300}
    value = counts.select(quality.value_of("word_length").alias("v")).withColumn("b", quality.bucket(F.col("v")))
    assert value.filter("b > v or 32 * (v - b) > v").isEmpty()


def test_filter_keeps_columns_and_clean_rows(odd, empty):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {20, 21, 22, None}
    assert quality.keep_good(empty).collect() == [] and quality.op10(empty).collect() == []


def fence_of(docs, lang, source):
    rows = quality.fences(quality.measured(docs.select("text", "lang", "source"), ["lang", "source"])).collect()
    return {(r.f_lang, r.f_source): r for r in rows}[lang, source]


def test_fences_do_not_jump_at_any_group_size(documents):
    bulk = [(k, clean(k), "en", "news") for k in range(300)]
    highs = []
    for n in (195, 199, 200, 201, 205):
        some = [(1000 + k, clean(k) + " #" * (k % 40), "en", "forum") for k in range(n)]
        highs.append(fence_of(documents(bulk + some), "en", "forum").symbol_share_high)
    assert max(highs) - min(highs) <= 0.1 * max(highs)


def test_groups_of_different_texts_have_different_fences(documents):
    def page(k, marks, repeats):
        return clean(k) + " #" * marks + "\n" + "again and again\n" * repeats

    rows = [(k, page(k, 10 + k % 30, 1 + k % 6), "en", "forum") for k in range(600)]
    rows += [(1000 + k, page(k % 600, k % 20 == 0, 1), "en", "news") for k in range(5000)]
    docs = documents(rows)
    forum, news = fence_of(docs, "en", "forum"), fence_of(docs, "en", "news")
    assert forum.symbol_share_high > 2 * news.symbol_share_high
    assert forum.dup_line_share_high > 2 * news.dup_line_share_high
