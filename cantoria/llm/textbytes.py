"""Words and shingles of Arrow string columns as numpy arrays: whole batches at once, no Python string per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cantoria.llm.common import SPACES

CHUNK = 1 << 20  # bytes of text handled at once (a longer text is one chunk)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_state: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_state.get("up", ())) < n:
        m = max(n, CHUNK + 1)
        steps = np.full(m, _ODD)
        steps[0] = 1
        _state["up"] = np.multiply.accumulate(steps)
        steps = np.full(m, _BACK)
        steps[0] = 1
        _state["down"] = np.multiply.accumulate(steps)
    return _state["up"], _state["down"]


def byte_values() -> np.ndarray:
    if "bytes" not in _state:
        _state["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    return _state["bytes"]


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """C and D such that the hash of data[a:b] is (C[b] - C[a]) * D[a], whatever its place."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_values()[data] * up[:len(data)], out=sums[1:])
    return sums, down


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null: empty) and the offsets of its rows (n + 1)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) with about CHUNK bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def _is_space() -> np.ndarray:
    if "space" not in _state:
        t = np.zeros(256, bool)
        t[[ord(c) for c in SPACES]] = True
        _state["space"] = t
    return _state["space"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word (n + 1)."""
    solid = ~_is_space()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and for each row the index of its first word (n + 1)."""
    starts, ends, first = word_spans(data, offsets)
    sums, down = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * down[starts]), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n words inside each row (none in shorter rows), and each row's first window (rows + 1)."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=at[1:])
    if at[-1] == 0:
        return np.zeros(0, np.uint64), at
    whole = len(words) - n + 1
    h = np.zeros(whole, np.uint64)
    for i in range(n):
        h = h * _ODD + words[i:whole + i]
    rows = np.repeat(np.arange(len(counts)), counts)
    return mix(h[np.arange(at[-1]) - at[rows] + first[rows]]), at
