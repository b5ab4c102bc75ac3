"""Word shingles of whole texts as 64-bit hashes, made with array operations over many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxhash64 of the bytes of each word, A-Z lower-cased: words are told apart as they are, and each different one is hashed once."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)
    held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[at]])]).dictionary_encode()
    of = np.fromiter(map(xxhash.xxh64_intdigest, held.dictionary.to_pylist()), np.uint64, len(held.dictionary))
    return of[held.indices.to_numpy()]


def joined_hashes(words: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of words[at : at + length] for each run; each step scrambles what it has, so that no structure of the words carries over."""
    out = mix(length.astype(np.uint64))
    for k in range(int(length.max(initial=0))):
        some = np.flatnonzero(length > k)
        out[some] = mix(out[some] * _ODD + words[at[some] + k])
    return out


def parts_of(texts: pa.Array, part: int):
    """(first row, data bytes, bounds) of runs of rows with about `part` bytes; null texts are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    group = (offsets[:-1] - offsets[0]) // part
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word (a run without ASCII white space) of the texts in data."""
    n = len(data)
    if not n:
        return (np.empty(0, np.int64),) * 3
    solid = ~((data == 0x20) | ((data >= 9) & (data <= 13)))
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    first[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(first & solid)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = ~solid[1:]
    inner = bounds[1:-1]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(last & solid) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def shingle_sets(texts: pa.Array, size: int = 5, part: int = 1_000_000):
    """For runs of rows: (first row, sorted distinct hashes of all rows one after the other, number of each row).

    Words are lower-cased (A-Z). A text of fewer than `size` words but one has its whole sequence as
    its only shingle; a text without words has none.
    """
    for a, data, bounds in parts_of(texts, part):
        rows = len(bounds) - 1
        starts, ends, doc = words(data, bounds)
        if not len(starts):
            yield a, np.empty(0, np.uint64), np.zeros(rows, np.int64)
            continue
        word = word_hashes(data, starts, ends)
        count = np.bincount(doc, minlength=rows)
        head = np.cumsum(count) - count
        long = count >= size
        made = np.where(long, count - size + 1, (count > 0).astype(np.int64))
        at = np.repeat(head - (np.cumsum(made) - made), made) + np.arange(made.sum())
        length = np.repeat(np.minimum(count, size), made)
        hashes = joined_hashes(word, at, length)
        ends_of = np.cumsum(made)
        out, sizes = [], np.zeros(rows, np.int64)
        for k in np.flatnonzero(made).tolist():
            own = hashes[ends_of[k] - made[k] : ends_of[k]]
            own = np.unique(own)
            out.append(own)
            sizes[k] = len(own)
        yield a, np.concatenate(out), sizes
