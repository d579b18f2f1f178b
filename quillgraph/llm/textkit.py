"""Vectorised word and shingle primitives over Arrow string columns.

Everything works on the UTF-8 bytes of a whole batch at once, so a text is
never turned into Python word objects.  Hashes are 64 bits wide and do not
depend on the process, the machine or the batch a text arrives in.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled together; bounds the temporary arrays.
GROUP_BYTES = 1 << 18

_WS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: Bytes of words split at ASCII white space only.
PLAIN = np.ones(256, dtype=bool)
PLAIN[list(_WS)] = False

#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
#: Eight bytes at a time: masks by the number of bytes that count, and a number per place in the word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_PLACES = 64


def _spread(place: np.ndarray) -> np.ndarray:
    return mix64((place.astype(np.uint64) + _U(257)) * _U(0xA0761D6478BD642F))


_PLACE = _spread(np.arange(_PLACES))


#: What this worker process keeps between tasks, by operator.
kept: dict[str, dict] = {}


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow.

    Workers live on after a task.  Before it, the tables of operators other
    than ``keep`` are dropped; after it, freed memory is given back.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [k for k in kept if k != keep]:
            del kept[name]
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def groups(offs: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) holding about ``limit`` bytes; at least one row each."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def find_words(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and, per row, the index of its first word.

    ``offs`` starts at 0 and ends at len(buf).  The third array has one more
    entry than there are rows.
    """
    n = len(buf)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offs), dtype=np.int64)
    inside = is_word[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash per word; ``fold`` takes A-Z as a-z.

    Eight bytes at a time are mixed with their place in the word before they
    are added, so no rule of algebra makes words collide (a polynomial modulo
    2**64 has such words, those of the Thue-Morse sequence).
    """
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = _FOLDED[buf] if fold else buf
    wide = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    size = ends - starts

    def mixed(at: np.ndarray, left: np.ndarray, place: np.ndarray | np.uint64) -> np.ndarray:
        return mix64((wide[at] & _MASK[np.minimum(left, 8)]) ^ place)

    out = mixed(starts, size, _PLACE[0])
    more = np.flatnonzero(size > 8)
    for k in range(1, _PLACES):
        if not len(more):
            break
        out[more] += mixed(starts[more] + 8 * k, size[more] - 8 * k, _PLACE[k])
        more = more[size[more] > 8 * (k + 1)]
    for w in more.tolist():  # giant words, one by one
        at = np.arange(starts[w] + 8 * _PLACES, ends[w], 8)
        for c in range(0, len(at), GROUP_BYTES):
            part = at[c : c + GROUP_BYTES]
            out[w : w + 1] += mixed(part, ends[w] - part, _spread(np.arange(_PLACES + c, _PLACES + c + len(part)))).sum(dtype=np.uint64)
    return mix64(out + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive entries of ``words``.

    Runs over row borders are included; callers drop them.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, size, dtype=np.uint64) * _U(0xA0761D6478BD642F)
    for k in range(size):
        h = h * _U(0xE7037ED1A0B428DB) + words[k : k + n]
        h ^= h >> _U(32)
    return mix64(h)


def word_groups(column: pa.Array, is_word: np.ndarray, fold: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, last row + 1, word hashes, first word per row, bytes per row."""
    raw, offs = text_buffers(column)
    for a, b in groups(offs):
        buf, own = raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        starts, ends, first = find_words(buf, own, is_word)
        yield a, b, hash_words(buf, starts, ends, fold), first, np.diff(own)


def shingle_sets(column: pa.Array, size: int, is_word: np.ndarray = PLAIN) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words, but not none, gives one hash for its whole sequence.
    """
    for a, b, words, first, _ in word_groups(column, is_word):
        runs = window_hashes(words, size)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= size:
                s = np.sort(runs[lo : hi - size + 1])
                keep = np.empty(len(s), dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif hi > lo:
                yield window_hashes(words[lo:hi], int(hi - lo))
            else:
                yield np.zeros(0, dtype=np.uint64)
