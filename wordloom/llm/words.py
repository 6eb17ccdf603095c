"""Words and word shingles of whole texts, hashed with numpy a batch at a time.

A word is a run of bytes other than space and \\t..\\r; A-Z count as a-z. Each
word becomes a 64-bit hash, so that later steps move integers, not strings.
Null text reads as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

U64 = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20
_POWERS = np.ones(1, U64)
_BASE = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_PLACE = mix(np.arange(1001, 1065, dtype=U64) * _BASE) | U64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(max(n, 256), _BASE, U64)]))
    return _POWERS


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into (first row, end row, bytes, offsets) of about CHUNK_BYTES; a text is never cut."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, at + 1), len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _bytes(column: pa.Array) -> np.ndarray:
    return pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64()).to_numpy(zero_copy_only=False)


def cut(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about size bytes of the string column, so that memory follows bytes and not rows; a text is never cut."""
    ends, at = np.cumsum(_bytes(batch.column(column))), 0
    while at < len(batch):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, rows): the rows of a task in blocks of size bytes of the string column at most, a longer text in one of its own.

    Blocks follow from the rows alone, however they come in batches, and numbers are the same whenever a task is run again.
    """
    number, held, room = TaskContext.get().partitionId() << 32, [], size

    def done() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        n, at = _bytes(batch.column(column)), 0
        while at < len(batch):
            fit = int(np.searchsorted(np.cumsum(n[at:]), room, side="right"))
            if not fit and held:
                yield number, done()
                number, held, room = number + 1, [], size
                continue
            fit = max(fit, 1)
            held.append(batch.slice(at, fit))
            room -= int(n[at : at + fit].sum())
            at += fit
    if held:
        yield number, done()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word with the total at the end)."""
    low = _LOWER[data]
    solid = ~_GAP[low]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] |= solid[edges]
    starts = np.flatnonzero(start)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U64), first
    body = np.flatnonzero(solid)
    at = (np.cumsum(solid) - 1)[starts]
    size = np.diff(np.append(at, len(body)))
    place = body - np.repeat(starts, size)
    value = _BYTE[low[body]] * _powers(int(size.max()) + 1)[place]
    return mix(np.add.reduceat(value, at) + size.astype(U64)), first


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each): all runs of k words; a text of 1 to k-1 words gives its whole sequence."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    if len(h) >= k:
        x = np.zeros(len(h) - k + 1, U64)
        for j in range(k):
            x += h[j : len(h) - k + 1 + j] * _PLACE[j]
        whole = text[: len(x)] == text[k - 1 :]
        x, of = mix(x[whole]), text[: len(x)][whole]
    else:
        x, of = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        y = n[short].astype(U64) * _BASE
        for j in range(k - 1):
            has = n[short] > j
            y[has] += h[first[short[has]] + j] * _PLACE[j]
        x, of = np.concatenate([x, mix(y)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        x, of = x[order], of[order]
    return x, of


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct shingle hashes of its whole text."""
    for at, end, data, offsets in chunks(column):
        x, of = shingles(*words(data, offsets), k)
        cut = np.searchsorted(of, np.arange(end - at + 1))
        for i in range(end - at):
            yield np.unique(x[cut[i] : cut[i + 1]])
