"""Words and hashed word sequences of whole texts, on byte arrays.

A word is a run of ``[^\\x20\\x09-\\x0D]+``.  The separators are ASCII, so words
are cut on the UTF-8 bytes.  A word's hash is a polynomial over its bytes
(random 64-bit values per byte, arithmetic modulo 2**64) that is read off one
prefix sum per chunk, then mixed; sequences of words are hashed from those.
Equal sequences get equal hashes, and two different ones collide with a
probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text that are hashed at a time; arrays of about 40 bytes per byte are held.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BASE = int(_rng.integers(1 << 62, 1 << 63)) | 5
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        got = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return got[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and per text the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash for every word; ``fold`` takes A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUE)[data] * _power("up", _BASE, n), out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * _power("down", _BACK, n)[starts] + (ends - starts).astype(np.uint64))


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words, one per start."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n] * _STEP[0]
    for i in range(1, k):
        out += words[i : i + n] * _STEP[i]
    return mix(out + np.uint64(k))


def whole_hash(words: np.ndarray, salt: int = 0) -> int:
    """Hash of a whole sequence of hashes, its length included."""
    n = len(words)
    total = int((words * _power("seq", _BASE ^ 0x55AA, n)).sum(dtype=np.uint64)) if n else 0
    return int(mix(np.array([(total + n * 0x9E3779B97F4A7C15 + salt * 0xD1B54A32D192ED03) % (1 << 64)], np.uint64))[0])


def signed(x: int) -> int:
    """An unsigned 64-bit value as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x
