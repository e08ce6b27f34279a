"""Secret scan with multipart credential linking.

Three base kinds are always reported. Weak parts (named account identifiers, unnamed token-like strings, endpoints)
are reported only where complementary parts stand within the same scope: the parts are intervals of the text, and an
interval join finds, for each weak part, whether a part of the other kind lies within REACH characters on either side.

Defined results: a null or empty text has no spans (base_sha256 is the digest of the empty string). Positions are code
points, ends exclusive. Repeated rows are scanned one by one. An empty table gives an empty result. Other columns pass
through ``redacted`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from soukline.llm.words import slices, with_columns

REACH = 200
MASK = "[SECRET]"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_id", "weak_secret", "endpoint")

# ``assign`` and the named identifiers are searched in ASCII-lowered bytes, so either case of A-Z matches.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
NAMED_ID = re.compile(
    rb"""(?:client_id|access_key_id|account_id|username|account|user)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=@-]{3,})"""
)
ENDPOINT = re.compile(rb"https?://[^\x20\x09-\x0D\"'<>]+")
KEYS = (b"password", b"passwd", b"secret", b"token", b"api")


def _mixed(run: bytes) -> bool:
    """Looks like a random token: digits, capitals and small letters."""
    return bool(re.search(rb"[0-9]", run) and re.search(rb"[A-Z]", run) and re.search(rb"[a-z]", run))


def _runs(raw: bytes, least: int, alphabet: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` bytes of an alphabet."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = alphabet[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def _alphabet(symbols: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(symbols)] = True
    return table


HEX_BYTES = _alphabet(b"0123456789abcdef")
TOKEN_BYTES = _alphabet(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _near(span: tuple[int, int], starts: list[int], ends: list[int]) -> bool:
    """Whether an interval of a sorted, non-overlapping list lies within REACH of the span."""
    k = bisect_left(ends, span[0] - REACH)
    return k < len(starts) and starts[k] <= span[1] + REACH


def _interval_join(left: list, right: list) -> list:
    """The left intervals that have a right one in their scope; both in text order."""
    if not right:
        return []
    starts, ends = [s for s, _ in right], [e for _, e in right]
    return [x for x in left if _near(x, starts, ends)]


def _disjoint(spans: list, taken: list) -> list:
    """Spans that overlap none of the taken ones (both sorted)."""
    starts, ends = [s for s, _ in taken], [e for _, e in taken]
    out = []
    for s, e in spans:
        k = bisect_left(ends, s + 1)
        if k == len(starts) or starts[k] >= e:
            out.append((s, e))
    return out


def _union(*lists: list) -> list:
    """Sorted intervals, overlapping ones merged."""
    out: list = []
    for s, e in sorted(x for one in lists for x in one):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def scan(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every reported span of a UTF-8 text, by start, then in the order of KINDS."""
    low = raw.lower()
    found: dict[str, list] = {k: [] for k in KINDS}
    if any(k in low for k in KEYS):
        found["assign"] = [m.span() for m in ASSIGN.finditer(low) if m.end(1) - m.start(1) >= 12]
    found["access"] = [m.span() for m in ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    found["hex"] = _runs(raw, 16, HEX_BYTES)
    named = [m.span() for m in NAMED_ID.finditer(low)] if b"user" in low or b"_id" in low or b"account" in low else []
    urls = [m.span() for m in ENDPOINT.finditer(raw)] if b"://" in raw else []
    strong = _union(*(found[k] for k in BASE))
    loose = [x for x in _runs(raw, 20, TOKEN_BYTES) if _mixed(raw[x[0]: x[1]])]
    loose = _disjoint(_disjoint(loose, strong), _union(urls, named))
    named = _disjoint(named, strong)
    points = _code_points(raw, [x for one in (*found.values(), named, urls, loose) for x in one])
    found = {k: [(points[s], points[e]) for s, e in v] for k, v in found.items()}
    named, urls, loose = ([(points[s], points[e]) for s, e in v] for v in (named, urls, loose))
    identifiers, secrets = _union(named, found["access"]), _union(loose, found["assign"], found["hex"])
    found["weak_secret"] = _interval_join(loose, identifiers)
    found["weak_id"] = _interval_join(named, secrets)
    found["endpoint"] = _interval_join(_interval_join(urls, identifiers), secrets)
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(((s, e, k) for k, v in found.items() for s, e in v), key=lambda x: (x[0], order[x[2]], x[1]))


def _code_points(raw: bytes, spans: list) -> dict[int, int]:
    """Code point positions of the given byte positions, counted from one to the next."""
    out, at, n = {}, 0, 0
    for p in sorted({p for x in spans for p in x}):
        n += len(raw[at:p].decode("utf-8", "replace"))
        at, out[p] = p, n
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scanned(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry``, counts, digest and spans of every row; ``docs`` needs text and the carried columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            rows = [scan(texts.raw(k)) for k in range(len(texts))]
            base = [[x for x in r if x[2] in BASE] for r in rows]
            counts = {
                f"n_{k}": pa.array([sum(x[2] == k for x in r) for r in base], pa.int64()) for k in BASE
            }
            yield with_columns(
                batch, carry, **counts,
                base_sha256=pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], pa.string()),
                spans=pa.array([_joined(r) for r in rows], pa.string()),
            )

    schema = docs.select(*carry).schema
    for k in BASE:
        schema = schema.add(f"n_{k}", "long")
    return docs.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def _mask(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    out, at = [], 0
    for s, e in _union([(s, e) for s, e, k in scan(raw) if k != "endpoint"]):
        out += [text[at:s], MASK]
        at = e
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with every reported secret and identifier replaced by MASK.

    ``n_chars``, where there is such a column, is the new length. A null text stays null.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            null = batch.column(names.index("text")).is_null().to_pylist()
            new = [None if null[k] else _mask(texts.raw(k)) for k in range(len(texts))]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                kind = batch.schema.field("n_chars").type
                old = columns[names.index("n_chars")].to_pylist()
                columns[names.index("n_chars")] = pa.array(
                    [o if t is None else len(t) for o, t in zip(old, new, strict=True)], kind
                )
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))


def op4(docs: DataFrame) -> DataFrame:
    return scanned(docs.select("doc_id", "text"), ["doc_id"])
