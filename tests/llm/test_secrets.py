import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from soukline.llm import secrets

from .conftest import odd_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, e, secrets.BASE[k]) for s, k, e in sorted(spans)]


def base_of(text):
    return [x for x in secrets.scan(text.encode()) if x[2] in secrets.BASE]


PIECES = st.sampled_from([
    "password", "Token", "API_KEY", "apikey", "secret", "passwd", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678",
    "0123456789abcdef", "deadbeef", "é", "漢", "\n", "x", "ſecret", "toKen", "user=", "https://h.example/x", "aB3" * 8,
])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    assert base_of(text) == brute(text)


def test_weak_parts_need_complements():
    key = "aB3dE6gH9jK2mN5pQ8sT1v"
    assert secrets.scan(f"see {key} here".encode()) == []
    both = f"username: ada and {key} at https://api.example.com/v1 end"
    assert [k for _, _, k in secrets.scan(both.encode())] == ["weak_id", "weak_secret", "endpoint"]
    far = f"username: ada {'word ' * 60}{key}"
    assert secrets.scan(far.encode()) == []
    assert secrets.scan(b"username: ada at https://api.example.com/v1") == []
    spans = secrets.scan(f"é {both}".encode())
    assert [both[s - 2: e - 2] for s, e, _ in spans] == ["username: ada", key, "https://api.example.com/v1"]


def test_odd_rows(odd, empty):
    got = sorted(map(str, (tuple(r)[:5] for r in secrets.op4(odd).collect())))
    want = []
    for doc_id, text, *_ in odd_rows():
        b = brute(text or "")
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in b).encode()).hexdigest()
        want.append(str((doc_id, *[sum(k == x for _, _, k in b) for x in secrets.BASE], digest)))
    assert got == sorted(want)
    assert secrets.op4(empty).collect() == [] and secrets.redacted(empty).collect() == []


def test_redaction_masks_secrets_only(odd, documents):
    same = secrets.redacted(odd)
    assert same.columns == odd.columns
    assert sorted(map(str, (r.text for r in same.collect()))) == sorted(map(str, (r.text for r in odd.collect())))
    docs = documents([(1, "é token = 'abcdefghijklmnop' ok", "en", "s", 31), (2, "clean text", "en", "s", 10)])
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(docs).collect()}
    assert got == {1: ("é [SECRET]' ok", 14), 2: ("clean text", 10)}
