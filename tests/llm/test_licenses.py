import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from soukline.llm import licenses
from soukline.llm.licenses import TEMPLATES, align, winnowed

from .conftest import clean


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
        row = new
    return row[-1]


SEQ = st.lists(st.integers(0, 4), min_size=1, max_size=12)


@settings(max_examples=300, deadline=None)
@given(SEQ, SEQ)
def test_a_wide_band_gives_the_longest_common_subsequence(a, b):
    n, first, last = align(np.array(a), b, -20, 20)
    assert n == lcs(a, b)
    if n:
        assert lcs(a, b[first: last + 1]) == n and b[first] in a and b[last] in a


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=0, max_size=30), st.integers(1, 6))
def test_every_window_keeps_its_least(values, window):
    kept = winnowed(np.array(values), window)
    for k in range(max(0, len(values) - window + 1)):
        part = range(k, k + window)
        assert any(p in kept and values[p] == min(values[k: k + window]) for p in part)


def test_matches_spans_and_coverage(documents):
    mit = " ".join(TEMPLATES["MIT"].split())
    changed = mit.replace("free of charge", "at no cost at all").replace("the Software", "this Software")
    docs = documents([
        (1, f"é {clean(1)}\n{TEMPLATES['MIT-notice']} {clean(2)}"),
        (2, f"{clean(3)} {changed} {clean(4)} {TEMPLATES['Apache-2.0-notice']}"),
        (3, mit[: len(mit) // 2]), (4, clean(5)), (5, " ".join([TEMPLATES["GPL-3.0-notice"], clean(1)] * 3)),
    ])
    rows = licenses.op6(docs).collect()
    found = sorted((r.doc_id, r.license) for r in rows)
    assert found == [(1, "MIT-notice"), (2, "Apache-2.0-notice"), (2, "MIT"), *[(5, "GPL-3.0-notice")] * 3]
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        span = text[r.doc_id][r.span_start: r.span_end]
        assert r.coverage == r.matched_words / r.template_words >= 0.8
        if r.license.endswith("notice"):
            assert span == TEMPLATES[r.license].rstrip(".") and r.coverage == 1
        else:
            assert span.startswith("Permission is hereby") and span.endswith("DEALINGS IN THE SOFTWARE")


def test_odd_rows(odd, empty):
    assert licenses.op6(odd).collect() == [] and licenses.op6(empty).collect() == []


def test_words_inserted_or_left_out_in_the_middle(documents):
    mit = TEMPLATES["MIT"].split()
    half, rows = len(mit) // 2, []
    for k in (10, 20, 30):
        rows.append((k, " ".join([clean(1), *mit[: half - k // 2], *mit[half + k - k // 2:], clean(2)])))
        rows.append((100 + k, " ".join([clean(1), *mit[:half], clean(3, words=k), *mit[half:], clean(2)])))
    rows.append((200, f"{rows[0][1]} {rows[3][1]}"))
    got = sorted((r.doc_id, r.license, r.matched_words, r.template_words) for r in licenses.op6(documents(rows)).collect())
    assert [g[:2] for g in got] == [(d, "MIT") for d in (10, 20, 30, 110, 120, 130, 200, 200)]
    lost = {d: w - m for d, _, m, w in got[:6]}
    assert lost == {10: 10, 20: 20, 30: 30, 110: 0, 120: 0, 130: 0}


def test_short_notices_tags_and_variants(documents):
    names = [
        "All-rights-reserved", "SPDX-MIT", "SPDX-GPL-2.0", "CC0-1.0-notice", "CC0-1.0-deed", "Unlicense", "BSD-2-Clause",
        "BSD-3-Clause", "GPL-2.0-header", "GPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0-header", "AGPL-3.0-header",
        "GPL-2.0-preamble", "GPL-3.0-preamble",
    ]
    rows = [(k, f"{clean(k)} {TEMPLATES[n]} {clean(k, 1)}") for k, n in enumerate(names)]
    rows += [(90, "all rights reserved"), (91, "All rights"), (92, "reserved. All rights"), (93, "SPDX-License-Identifier: X")]
    got = sorted((r.doc_id, r.license, r.coverage) for r in licenses.op6(documents(rows)).collect())
    assert got == [*[(k, n, 1.0) for k, n in enumerate(names)], (90, "All-rights-reserved", 1.0)]


def test_short_notices_with_a_word_changed_and_side_by_side(documents):
    apache, mit = TEMPLATES["Apache-2.0-notice"], TEMPLATES["MIT-notice"]
    rows = [
        (1, f"{clean(1)} Licensed under the Apache Licence, Version 2.0 {clean(2)}"), (2, "\n".join([apache] * 5)),
        (3, f"{mit} {mit} Released beneath the MIT License. {mit}"), (4, "Released under the BSD License."),
        (5, "Licensed under the Mozilla License, Version 2.0"), (6, TEMPLATES["CC-BY-4.0-notice"]),
        (7, TEMPLATES["CC-BY-SA-4.0-notice"]),
    ]
    got = sorted((r.doc_id, r.license, r.matched_words) for r in licenses.op6(documents(rows)).collect())
    assert got == [
        (1, "Apache-2.0-notice", 7), *[(2, "Apache-2.0-notice", 8)] * 5, (3, "MIT-notice", 4), *[(3, "MIT-notice", 5)] * 3,
        (6, "CC-BY-4.0-notice", 13), (7, "CC-BY-SA-4.0-notice", 14),
    ]


def test_one_changed_word_anywhere_leaves_a_shingle():
    for n in range(licenses.K, licenses.SHORT):
        lost = n - licenses.math.ceil(licenses.COVERAGE * n)
        cuts = [-1, *[(k + 1) * (n + 1) // (lost + 1) - 1 for k in range(lost)], n]
        assert max(b - a - 1 for a, b in zip(cuts, cuts[1:])) >= licenses.shingle_words(n)
