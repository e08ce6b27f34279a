"""Words of whole texts, hashed a batch at a time.

A word is a run of bytes other than space and \\x09-\\x0D. Texts stay in the Arrow buffer; starts, ends and 64-bit
hashes come from a few array operations, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Spaces and ASCII punctuation: what separates the words of a model.
BREAK = SPACE.copy()
BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i below n at least."""
    if len(_powers.get("up", ())) < n:
        n = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("up", BASE), ("down", inverse)):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


class Texts:
    """The texts of some rows: ``data`` holds their bytes, ``offsets`` where each begins; a null text is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0]: offsets[-1]]
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def raw(self, k: int) -> bytes:
        return self.data[self.offsets[k]: self.offsets[k + 1]].tobytes()

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end (in ``data``) and text number of each word; ``between`` tells the bytes that separate words."""
        solid = ~between[self.data]
        first = np.zeros(len(solid) + 1, dtype=bool)
        first[self.offsets] = True
        before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
        after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
        starts = np.flatnonzero(solid & (~before | first[:-1]))
        ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word; equal words have equal hashes, wherever they stand.

    ``starts`` ascend. Worked off in slices of about SLICE_BYTES, so that memory beyond the text itself stays bounded
    by a slice or the longest word.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, begin + SLICE_BYTES)))
        chunk = data[begin: ends[to - 1]]
        up, down = _power(len(chunk) + 1)
        run = np.zeros(len(chunk) + 1, dtype=np.uint64)
        np.cumsum((chunk.astype(np.uint64) + np.uint64(1)) * up[: len(chunk)], out=run[1:])
        s, e = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The rows in pieces of about SLICE_BYTES of text, one row at least, each with its texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(text))
        offsets = Texts(column).offsets
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(at, to - at), Texts(column.slice(at, to - at))
            at = to


def with_columns(batch: pa.RecordBatch, keep: list[str], **new) -> pa.RecordBatch:
    """The kept columns of a batch and the new ones, in that order."""
    arrays = [batch.column(batch.schema.names.index(k)) for k in keep]
    return pa.RecordBatch.from_arrays(
        [*arrays, *(v if isinstance(v, pa.Array) else pa.array(v) for v in new.values())], names=[*keep, *new]
    )
