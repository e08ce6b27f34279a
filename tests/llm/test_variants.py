import random
import re
import zlib
from collections import Counter

from soukline.llm import variants

from .conftest import clean, odd_rows


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute_counts(rows):
    out = Counter()
    for doc, text, *_ in rows:
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def brute(counts):
    form, size = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        size[w] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, size[w], counts.get(form[w])))
    return sorted(out)


def lexicon(seed, n, letters="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc", "abcabcd", "bcabcd", "x" * 300, "x" * 150 + "y" + "x" * 149, "x" * 299}
    return {w: 5 ** rng.randint(1, 5) + rng.randint(0, 3) for w in words}


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_pairs_forms_and_roots_equal_brute_force(spark):
    for seed, n, letters in ((1, 150, "abé"), (2, 200, "abcdefgÿ"), (3, 60, "ab")):
        counts = lexicon(seed, n, letters)
        df = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
        got = variants.grouped(df)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert rows_of(got) == brute(counts)


def test_query_equals_brute_force_on_texts(documents):
    rng = random.Random(5)
    base = ["writing", "language", "grammaire", "königin", "spelling", "variant", "variants", "variante", "wörter"]
    rows = [(k, " ".join(rng.choice(base) for _ in range(120)).title() + ",Àéî!") for k in range(60)]
    rows += [(100 + k, "languag3 langage spellling-spellling GRAMMAIRE") for k in range(7)]
    counts = brute_counts(rows)
    assert any(w not in base for w in counts)  # damage is seen
    assert rows_of(variants.op12(documents(rows))) == brute(counts)


def test_odd_rows(odd, empty, documents):
    assert rows_of(variants.op12(odd)) == brute(brute_counts(odd_rows()))
    assert variants.op12(empty).collect() == []
    # a very long word, five times, and its neighbour
    long = "ab" * 30_000
    rows = [(k, f"{long} {clean(k)} {long[:-1]}") for k in range(5)]
    assert rows_of(variants.op12(documents(rows))) == brute(brute_counts(rows))


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(variants, "PIECE", 10)
    text = "one twothree fourfivesixseven eight " * 5
    words = [w for piece in variants._pieces(text) for w in variants._RUN.findall(piece)]
    assert words == text.split()
