"""Words and shingles of Arrow text columns, computed on UTF-8 bytes with numpy."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Spark expression and Python regex for one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving its memory back to the system at the end of a task.

    Workers are kept for later tasks, and what an allocator holds on to counts against
    the executor all that time.
    """

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return task


def tables() -> dict:
    """Byte tables: white space, and bytes with A-Z in lower case."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return {"space": space, "lower": lower}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    if not len(text):
        return
    _, off, data = text.buffers()
    offsets = np.frombuffer(off, np.int64)[text.offset : text.offset + len(text) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(text)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        lo, hi = offsets[at], offsets[end]
        yield at, end, buf[lo:hi], offsets[at : end + 1] - lo
        at = end


def words(buf: np.ndarray, offsets: np.ndarray, tab: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row it is in."""
    solid = ~tab["space"][buf]
    n = len(solid)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def powers(n: int, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(cache.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        with np.errstate(over="ignore"):
            for name, p in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
                x = np.full(size, p, np.uint64)
                x[0] = 1
                cache[name] = np.multiply.accumulate(x)
    return cache["up"][:n], cache["down"][:n]


def hash_sums(buf: np.ndarray, tab: dict, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any span of ``buf`` follows."""
    up, down = powers(len(buf), cache)
    total = np.zeros(len(buf) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((tab["lower"][buf].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return total, down


def span_hashes(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, under the byte table of ``sums``."""
    total, down = sums
    with np.errstate(over="ignore"):
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, tab: dict, cache: dict) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z in lower case."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return span_hashes(hash_sums(buf, tab, cache), start, end)


def shingle_sets(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles of ``width`` words.

    A row with fewer words has its whole sequence as one shingle, a row without
    words an empty set.
    """
    first = np.searchsorted(row, np.arange(n_rows))
    count = np.searchsorted(row, np.arange(n_rows), "right") - first
    factor = [pow(_P, 2 * k + 3, 1 << 64) for k in range(width)]
    with np.errstate(over="ignore"):
        full = max(0, len(hashes) - width + 1)
        total = np.full(full, width, np.uint64)
        for k in range(width):
            total += hashes[k : k + full] * np.uint64(factor[k])
        total = mix(total)
        out = []
        for at, n in zip(first.tolist(), count.tolist(), strict=True):
            if n >= width:
                got = np.sort(total[at : at + n - width + 1])
                if len(got) > 1:
                    new = np.empty(len(got), bool)
                    new[0] = True
                    np.not_equal(got[1:], got[:-1], out=new[1:])
                    got = got[new]
                out.append(got)
            elif n:
                part = np.full(1, n, np.uint64)
                for k in range(n):
                    part += hashes[at + k] * np.uint64(factor[k])
                out.append(mix(part))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
