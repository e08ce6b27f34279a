import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from soukline.llm import words
from soukline.llm.words import Texts, hashes

WORD = re.compile("[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.sampled_from(list("ab \n\t\x0bßé漢\x1c\xa0")), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=8), st.integers(0, 3))
def test_words_and_hashes_are_those_of_each_text(rows, skip):
    column = pa.array([None] * skip + rows, pa.string()).slice(skip)
    texts = Texts(column)
    starts, ends, of = texts.words()
    found = [texts.data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert found == [w for r in rows for w in WORD.findall(r or "")]
    assert of.tolist() == [k for k, r in enumerate(rows) for _ in WORD.findall(r or "")]
    h = hashes(texts.data, starts, ends)
    assert len(set(h.tolist())) == len(set(found))
    assert len({(w, x) for w, x in zip(found, h.tolist())}) == len(set(found))


def test_slices_do_not_change_hashes(monkeypatch):
    column = pa.array(["one two three " * 50, "", None, "two", "x" * 500])
    texts = Texts(column)
    whole = hashes(texts.data, *texts.words()[:2])
    monkeypatch.setattr(words, "SLICE_BYTES", 16)
    assert (hashes(texts.data, *texts.words()[:2]) == whole).all()
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    parts = list(words.slices([batch]))
    assert sum(p.num_rows for p, _ in parts) == 5 and len(parts) > 1
    assert (np.concatenate([hashes(t.data, *t.words()[:2]) for _, t in parts]) == whole).all()
