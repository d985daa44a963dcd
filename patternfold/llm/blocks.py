"""Columnar text blocks: words and their 64-bit hashes, straight from Arrow's UTF-8 buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Null texts count as empty.
All work is numpy over the bytes of one slice of a batch, so the memory of a task depends on
``SLICE_BYTES`` (or its longest single text), not on the size of the input.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
CHUNK = 1 << 20
LONGEST_MIXED = 64
HELD = 32 << 20
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # fixed values of the C library


def trim() -> None:
    """Gives freed memory back to the machine: a worker process lives long, beside others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    """The C library, told to reuse freed memory up to HELD bytes rather than to ask the system for each array anew."""
    try:
        found = ctypes.CDLL("libc.so.6")
        found.mallopt(_TRIM_THRESHOLD, HELD)
        found.mallopt(_MMAP_THRESHOLD, HELD // 4)
        return found if hasattr(found, "malloc_trim") else None
    except (OSError, AttributeError):
        return None


_LIBC = _libc()
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def is_space(raw: np.ndarray) -> np.ndarray:
    return _SPACE[raw]


def lower(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[raw]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of h over all 64."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES, trims: bool = True) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` bytes of text (one row at least). ``trims``: after each, freed memory goes back to the machine; without, the next one takes it over, which spares the machine to clear its pages."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
        if trims:
            trim()


class Words:
    """start, end: byte positions in ``raw`` (lower-cased if asked for); doc: row; hash: 64 bits of the word's bytes."""

    __slots__ = ("raw", "off", "start", "end", "hash", "counts")

    def __init__(self, raw, off, start, end, hashes):
        self.raw, self.off, self.start, self.end, self.hash = raw, off, start, end, hashes
        at = np.searchsorted(start, off)
        self.counts = np.diff(at)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    @property
    def bounds(self) -> np.ndarray:
        """Row i's words are bounds[i] .. bounds[i + 1] - 1."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def word_marks(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a row's boundary ends a word."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    dark = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = dark.copy()
    begin[1:] &= ~dark[:-1] | edge[1:n]
    finish = dark.copy()
    finish[:-1] &= ~dark[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def _lanes(raw: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as one little-endian number; beyond the end there are zeros."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, 0, (1,))


#: What of a number's bytes belongs to a segment of which so many bytes are left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEED = _U(0x9E3779B97F4A7C15)


def segment_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of raw[start[i]:end[i]]; segments ascend and don't overlap.

    Up to seven bytes and their number are one number, which ``mix`` maps one to one. Longer segments are mixed
    eight bytes at a time, those over LONGEST_MIXED by BLAKE2b. A hash can still meet another's: see Spellings.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # pieces of whole segments, so that the copies stay in cache
        a = start[i]
        j = max(i + 1, int(np.searchsorted(end, a + CHUNK, side="right")))
        piece = raw[a : end[j - 1]]
        out[i:j] = _piece_hashes(_LOWER[piece] if lower else piece, start[i:j] - a, (end[i:j] - start[i:j]).astype(np.int64))
        i = j
    return out


def _piece_hashes(piece: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    lanes = _lanes(piece)
    h = (lanes[start] & _LEFT[np.minimum(size, 8)]) + (np.minimum(size, 8).astype(np.uint64) << _U(56))
    h = mix(h)
    more = np.flatnonzero(size >= 8)
    if len(more):
        h[more] = mix(h[more] + size[more].astype(np.uint64) * _SEED)
        for k in np.flatnonzero(size > LONGEST_MIXED).tolist():
            h[k] = int.from_bytes(hashlib.blake2b(piece[start[k] : start[k] + size[k]].tobytes(), digest_size=8).digest(), "little")
        at = 8
        live = more[(size[more] > 8) & (size[more] <= LONGEST_MIXED)]
        while len(live):
            own = lanes[start[live] + at] & _LEFT[np.minimum(size[live] - at, 8)]
            h[live] = mix((h[live] ^ mix(own + _U(at))) + _SEED)
            at += 8
            live = live[size[live] > at]
    return h


class Growing:
    """A one-dimensional array to append to; its room doubles, so that appending costs the size of what is new."""

    __slots__ = ("_data", "n")

    def __init__(self, kind, values: np.ndarray | None = None):
        self._data, self.n = np.zeros(1 << 10, kind), 0
        if values is not None:
            self.add(values)

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self._data):
            data = np.zeros(1 << (need - 1).bit_length(), self._data.dtype)
            data[: self.n] = self._data[: self.n]
            self._data = data
        self._data[self.n : need] = values
        self.n = need

    @property
    def all(self) -> np.ndarray:
        return self._data[: self.n]

    def take(self, at: np.ndarray) -> np.ndarray:
        return np.take(self._data, at)


class Spellings:
    """The bytes of remembered segments, to compare hits of a HashIndex with."""

    def __init__(self) -> None:
        self.size, self.first, self.place = Growing(np.int64), Growing(np.uint64), Growing(np.int64)
        self.store = Growing(np.uint8)

    def add(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Segments in the order of their numbers."""
        size = (end - start).astype(np.int64)
        long = size > 8
        place = np.zeros(len(size), np.int64)
        place[long] = self.store.n + np.cumsum(size[long]) - size[long]
        self.store.add(raw[ragged(start[long], size[long])])
        self.size.add(size)
        self.first.add(_lanes(raw)[start] & _LEFT[np.minimum(size, 8)] if len(start) else np.zeros(0, np.uint64))
        self.place.add(place)

    def keep(self, numbers: np.ndarray) -> "Spellings":
        """Those of the given numbers, renumbered in that order."""
        out, size = Spellings(), self.size.take(numbers)
        long = size > 8
        place = np.zeros(len(numbers), np.int64)
        place[long] = np.cumsum(size[long]) - size[long]
        out.store.add(self.store.take(ragged(self.place.take(numbers)[long], size[long])))
        out.size.add(size), out.first.add(self.first.take(numbers)), out.place.add(place)
        return out

    def _long_lanes(self) -> np.ndarray:
        """_lanes of the store, without a copy of it."""
        self.store.add(np.zeros(8, np.uint8))  # room for what the last lanes read beyond their segments
        self.store.n -= 8
        return np.ndarray((self.store.n + 1,), np.dtype("<u8"), self.store._data, 0, (1,))

    def differ(self, number: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Indices of the segments whose bytes aren't those kept under their numbers."""
        if not len(number):
            return np.zeros(0, np.int64)
        size = (end - start).astype(np.int64)
        lanes = _lanes(raw)
        wrong = (self.size.take(number) != size) | ((lanes[start] & _LEFT[np.minimum(size, 8)]) != self.first.take(number))
        long = np.flatnonzero((size > 8) & ~wrong)
        large = long[size[long] > LONGEST_MIXED]
        for k in large.tolist():
            p = self.place.all[number[k]]
            wrong[k] = not np.array_equal(raw[start[k] : end[k]], self.store.all[p : p + size[k]])
        long = long[size[long] <= LONGEST_MIXED]
        kept = self._long_lanes()
        at = 8
        while len(long):
            bad = (lanes[start[long] + at] ^ kept[self.place.take(number[long]) + at]) & _LEFT[np.minimum(size[long] - at, 8)] != 0
            wrong[long[bad]] = True
            at += 8
            long = long[size[long] > at]
        return np.flatnonzero(wrong)


def words(column, lower: bool = False) -> Words:
    raw, off = utf8(column)
    start, end = word_marks(raw, off)
    if lower:
        raw = _LOWER[raw]
    return Words(raw, off, start, end, segment_hashes(raw, start, end))


def windows(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and their rows' counts.

    A row with fewer words, but at least one, has one run: all its words.
    """
    n, h = len(w.hash), w.hash
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(w.counts), np.int64)
    bounds = w.bounds
    total = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        total[: n - k] += mix(h[k:] + _U(k + 1))
    full = np.maximum(w.counts - size + 1, 0)
    keep = np.ones(n, bool)
    for k in range(1, size):
        at = bounds[1:] - k
        keep[at[at >= bounds[:-1]]] = False
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    for d in short:  # a handful of words each
        total[bounds[d]] = int(sum(int(x) for x in mix(h[bounds[d] : bounds[d + 1]] + np.arange(1, w.counts[d] + 1, dtype=np.uint64))) + 977 * int(w.counts[d])) % 2**64
    keep[bounds[short]] = True
    full[short] = 1
    return mix(total[keep]), full


class HashIndex:
    """Open addressing from 64-bit hashes to the numbers 0, 1, 2 ... in order of insertion."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h * _U(0x9FB21C651E98DF25) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of h; -1 where unknown."""
        slot, mask = self._slots(h), len(self.keys) - 1
        found = self.vals[slot]
        open_ = np.flatnonzero((self.keys[slot] != h) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found[open_] = self.vals[slot[open_]]
            open_ = open_[(self.keys[slot[open_]] != h[open_]) & (found[open_] >= 0)]
        return found

    def add(self, h: np.ndarray) -> None:
        """h: distinct and unknown."""
        need = self.n + len(h)
        if need * 5 > len(self.keys) * 3:
            old = np.empty(self.n, np.uint64)
            old[self.vals[self.vals >= 0]] = self.keys[self.vals >= 0]
            self.clear((2 * need - 1).bit_length())
            self._put(old)
        self._put(h)

    def _put(self, h: np.ndarray) -> None:
        slot, mask, todo = self._slots(h), len(self.keys) - 1, np.arange(len(h))
        while len(todo):
            free = self.vals[slot[todo]] < 0
            mine = todo[free]
            self.vals[slot[mine]] = mine + self.n
            self.keys[slot[mine]] = h[mine]
            lost = mine[self.vals[slot[mine]] != mine + self.n]
            todo = np.concatenate([todo[~free], lost])
            slot[todo] = (slot[todo] + 1) & mask
        self.n += len(h)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Remembered:
    """Something known of segments of bytes, by number: each distinct segment is learned once while remembered.

    Found by hash, then compared byte by byte; a segment that meets another's number is sought again under a
    further hash. At most MOST segments are remembered, and MOST_BYTES of their bytes before the last slice.
    """

    MOST, MOST_BYTES = 600_000, 1 << 26

    def _reset(self) -> None:
        self.index, self.spelled = HashIndex(18), Spellings()
        self.hashes, self.seen = Growing(np.uint64), Growing(np.int32)

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """To be given: appends what is known of new segments, in this order."""
        raise NotImplementedError

    def _keep(self, numbers: np.ndarray) -> None:
        """To be given: keeps what is known of these numbers, in this order."""
        raise NotImplementedError

    def _add(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self._learn(raw, start, end)
        self.spelled.add(raw, start, end)
        self.index.add(hashes)
        self.hashes.add(hashes)
        self.seen.add(np.zeros(len(hashes), np.int32))

    def _forget(self) -> None:
        """Keeps the segments seen in more than one slice, half of MOST and of MOST_BYTES at most."""
        seen = self.seen.all
        often = np.flatnonzero(seen > 1)
        often = often[np.argsort(-seen[often], kind="stable")[: self.MOST // 2]]
        often = np.sort(often[np.cumsum(self.spelled.size.take(often)) <= self.MOST_BYTES // 2])
        hashes, seen, spelled = self.hashes.take(often), seen[often] // 2, self.spelled.keep(often)
        self._keep(often)
        self.index, self.spelled, self.hashes, self.seen = HashIndex(18), spelled, Growing(np.uint64, hashes), Growing(np.int32, seen)
        self.index.add(hashes)

    def numbers(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The numbers of the segments raw[start[i]:end[i]]."""
        out = self.index.find(hashes)
        new = np.flatnonzero(out < 0)
        if self.index.n and (self.spelled.store.n > self.MOST_BYTES or self.index.n + len(new) > self.MOST and self.index.n + len(np.unique(hashes[new])) > self.MOST):
            self._forget()
            out = self.index.find(hashes)
        todo, own, h = None, out, hashes
        while True:
            unknown = np.flatnonzero(own < 0)
            if len(unknown):
                new, at = np.unique(h[unknown], return_index=True)
                at = unknown[at] if todo is None else todo[unknown[at]]
                self._add(new, raw, start[at], end[at])
                own[unknown] = self.index.find(h[unknown])
            wrong = self.spelled.differ(own, raw, *((start, end) if todo is None else (start[todo], end[todo])))
            if todo is not None:
                out[todo] = own
            if not len(wrong):
                break
            todo = wrong if todo is None else todo[wrong]
            h = mix(h[wrong] + _SEED)
            own = self.index.find(h)
        self.seen.all[out] += 1  # once a slice, however often it stands there
        return out
