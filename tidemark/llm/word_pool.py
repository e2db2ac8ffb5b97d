"""Ids of pieces of text, remembered by a worker and looked up for whole batches at once.

A batch is one array of bytes, cut into pieces. A piece's number is a sum of one pseudo-random number for each byte times one for its
place; numbers are looked up in an open-addressing table, and what is found is compared with the piece byte by
byte, so that two pieces of one number are never taken for each other. Pieces that are new, long or
collide are encoded by the caller. A full pool keeps what it has, which are mostly the frequent pieces, until it meets too little of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST_KEPT = 64  # bytes; longer pieces are encoded anew each time
REMEMBERED = 600_000  # pieces, some 100 bytes each
STRANGE = 0.4  # share of unknown pieces from which a full pool is of no use and begins anew
WINDOW = 1 << 18  # bytes that are worked on at once; a longer piece is worked on alone


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each begins and the last ends. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    _, edges, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if edges is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    edge = np.frombuffer(edges, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, edge - edge[0]


def slices(batch: pa.RecordBatch, column: int, most: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``most`` bytes of that column each, or one longer value."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), then the same of start[1], and so on."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def binary(values: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Rows of bytes, one from each edge to the next (counted in items of ``values``)."""
    at = edge * values.itemsize
    if at[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    raw = values.tobytes()
    return pa.array([raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.all, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.all):
            self.all = np.concatenate([self.all[: self.size], np.zeros(max(need, 2 * self.size) - self.size, self.all.dtype)])
        self.all[self.size : need] = values
        self.size = need


class NumberTable:
    """Open addressing from numbers to rows, which are not negative."""

    def __init__(self):
        self.bits, self.used = 12, 0
        self._empty()

    def _empty(self) -> None:
        self.key, self.row = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for absent ones."""
        slot = self._slot(keys)
        out = self.row[slot]
        left = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            out[left] = self.row[slot]
            again = (out[left] >= 0) & (self.key[slot] != keys[left])
            left, slot = left[again], slot[again]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Takes in distinct keys that are absent."""
        if (self.used + len(keys)) * 2 > 1 << self.bits:
            old = self.row >= 0
            keys, rows = np.concatenate([self.key[old], keys]), np.concatenate([self.row[old], rows])
            self.used = 0
            while len(keys) * 3 > 1 << self.bits:
                self.bits += 1
            self._empty()
        self.used += len(keys)
        slot = self._slot(keys)
        while len(keys):  # of the keys that ask for a free slot, the first takes it
            free = np.flatnonzero(self.row[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.row[slot[taken]], self.key[slot[taken]] = rows[taken], keys[taken]
            left = np.ones(len(keys), bool)
            left[taken] = False
            keys, rows, slot = keys[left], rows[left], (slot[left] + 1) & ((1 << self.bits) - 1)


class WordPool:
    """``encode`` gives the ids of pieces, one after another, and how many each has. A piece's ids depend on its bytes alone."""

    def __init__(self, kind: np.dtype, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.kind, self.encode_new = np.dtype(kind), encode
        numbers = np.random.default_rng(2024).integers(1, 1 << 63, 256 + LONGEST_KEPT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_byte, self.of_place = numbers[:256], numbers[256:]
        self._clear()

    def _clear(self) -> None:
        self.table = NumberTable()
        self.ids, self.id_start, self.id_count = _Grown(self.kind), _Grown(np.int64), _Grown(np.int64)
        self.bytes, self.byte_start, self.byte_count = _Grown(np.uint8), _Grown(np.int64), _Grown(np.int64)

    def _take_in(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes pieces and appends them; their rows."""
        ids, counts = self.encode_new(pieces)
        first, size = self.id_start.size, np.array([len(x) for x in pieces], np.int64)
        self.id_start.extend(self.ids.size + np.cumsum(counts) - counts)
        self.id_count.extend(counts)
        self.ids.extend(ids)
        self.byte_start.extend(self.bytes.size + np.cumsum(size) - size)
        self.byte_count.extend(size)
        self.bytes.extend(np.frombuffer(b"".join(pieces), np.uint8))
        return np.arange(first, self.id_start.size)

    def encode(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces of ``raw``, which begin at ``start``, and how many each has."""
        ids, counts, at = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)], 0
        end = np.append(start[1:], len(raw)) if len(start) else start
        while at < len(start):
            stop = max(at + 1, int(np.searchsorted(end, start[at] + WINDOW)))
            found = self._window(raw[start[at] : end[stop - 1]], start[at:stop] - start[at])
            ids.append(found[0])
            counts.append(found[1])
            at = stop
        return np.concatenate(ids), np.concatenate(counts)

    def _window(self, raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.append(start[1:], len(raw)) - start
        byte_at = np.arange(len(raw))
        place = byte_at - np.repeat(start, size)
        if int(size.max()) > LONGEST_KEPT:
            place = np.minimum(place, LONGEST_KEPT - 1)
        number = np.add.reduceat(self.of_byte[raw] * self.of_place[place], start) + size.astype(np.uint64)
        number = (number ^ (number >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        row = self.table.find(number)
        row[size > LONGEST_KEPT] = -1
        text = raw.tobytes()
        new = np.flatnonzero((row < 0) & (size <= LONGEST_KEPT))
        full = self.id_start.size > REMEMBERED
        if full and len(new) > STRANGE * len(start):
            self._clear()
            return self._window(raw, start)
        sizes = lambda: [g.size for g in (self.ids, self.id_start, self.id_count, self.bytes, self.byte_start, self.byte_count)]
        marks = sizes()
        if len(new):
            key, first, which = np.unique(number[new], return_index=True, return_inverse=True)
            asked = new[first]
            rows = self._take_in([text[a : a + n] for a, n in zip(start[asked].tolist(), size[asked].tolist(), strict=True)])
            row[new] = rows[which]
            if not full:
                self.table.add(key, rows)
                marks = sizes()
        other = (row < 0) | (self.byte_count.all[row] != size)  # long ones, and those of a known piece's number
        row[other] = 0
        good = np.ones(len(start), bool)
        if other.all():
            good[:] = False
        else:
            own = np.where(other, 0, size)
            at = ragged(self.byte_start.all[row], own)
            same = self.bytes.all[at] == (raw if not other.any() else raw[np.repeat(~other, size)])
            if not same.all():
                good[np.repeat(np.arange(len(start)), own)[~same]] = False
            good &= ~other
        odd = np.flatnonzero(~good)
        if len(odd):  # kept for this window only
            row[odd] = self._take_in([text[a : a + n] for a, n in zip(start[odd].tolist(), size[odd].tolist(), strict=True)])
        count = self.id_count.all[row]
        ids = self.ids.all[ragged(self.id_start.all[row], count)]
        for g, n in zip((self.ids, self.id_start, self.id_count, self.bytes, self.byte_start, self.byte_count), marks, strict=True):
            g.size = n
        return ids, count
