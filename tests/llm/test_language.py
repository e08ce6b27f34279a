import itertools
import zlib

import numpy as np
import pyarrow as pa

from soukline.llm import language
from soukline.llm.common import one_each
from soukline.llm.words import Texts

EN = "the house and river with some bread under this old bridge where they walk".split()
DE = "das haus und der fluss mit etwas brot unter dieser alten brücke wo sie gehen".split()


def sentences(words, n):
    return " ".join(" ".join(words[(n * 5 + k * 3 + k * j) % len(words)] for k in range(7)) + "." for j in range(1, 6))


def corpus(n):
    return [(k, sentences(EN if k % 2 else DE, k), "en" if k % 2 else "de") for k in range(n)]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    scores, step, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    sequence = np.array([0, 0, 0, 0, 1, 2, 2, 2, 3])
    want, pairs_want = np.zeros((9, 3)), np.zeros((3, 3))
    for s in range(4):
        at = np.flatnonzero(sequence == s)
        total, part, pairs = 0.0, np.zeros((len(at), 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=len(at)):
            w = np.exp(start[path[0]] + sum(scores[i, y] for i, y in zip(at, path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                part[i, y] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        want[at], pairs_want = part / total, pairs_want + pairs / total
    order, bounds = language.by_step(sequence)
    got, pairs = np.empty((9, 3)), np.zeros((3, 3))
    got[order] = language.forward_backward(np.exp(scores)[order], bounds, step, start, pairs)
    assert np.allclose(got, want) and np.allclose(pairs, pairs_want)


def test_code_switched_words_are_told_apart():
    rows = corpus(60)
    crf = language.fit([r[1] for r in rows], [r[2] for r in rows])
    mixed = " ".join(EN[:9]) + " " + " ".join(DE[:4])
    lang, score = language.label(crf, Texts(pa.array([mixed, " ".join(DE[:9] + EN[:4]), "brücke", "12 !!", None, ""])))
    assert lang == ["en", "de", "de", "und", "und", "und"]
    assert 0.5 < score[0] < 0.9 and score[3:].tolist() == [0, 0, 0]


def test_held_out_accuracy_and_no_peeking(documents):
    rows = corpus(200)
    out = language.op7(documents(rows)).collect()
    true = {r[0]: r[2] for r in rows}
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held)
    wrong = [(k, t, "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, t, y in rows]
    assert sorted(map(tuple, language.op7(documents(wrong)).collect())) == sorted(map(tuple, out))


def test_odd_rows(odd, empty, documents):
    out = language.op7(odd).collect()
    assert len(out) == odd.count()
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 9)} == {"und"}
    assert language.op7(empty).collect() == []
    none = documents([(1, "some text", None), (2, "more text", None)])
    assert {(r.lang_pred, r.score) for r in language.op7(none).collect()} == {("und", 0.0)}


def test_a_repeated_document_is_one_learning_row(spark, documents, monkeypatch):
    seen = []
    rows = [(k, t, lang) for k, t, lang in corpus(40)]
    docs = documents(rows + [rows[5]] * 2000 + [rows[6]] * 500)
    monkeypatch.setattr(language, "one_each", lambda df, keys: seen.append((df.count(), one_each(df, keys))) or seen[-1][1])
    language.train(docs, per_label=40)
    before, after = seen[0]
    assert before > 500 and after.count() == len({r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2})
