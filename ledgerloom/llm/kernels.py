"""Vectorised text kernels that run on the UTF-8 buffers of Arrow batches.

A task never sees more than ``CHUNK_BYTES`` of text at once, except for a single
row that is longer; whole rows are always processed.
"""

import ctypes
import functools

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_P = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def give_back():
    """Return what this process has freed to the system: Arrow's pool, malloc's arenas and a very long text's powers."""
    if len(_POWERS[0]) > 2 * CHUNK_BYTES:
        _POWERS[:] = [p[:1].copy() for p in _POWERS]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run``, a map over a task's record batches, with its memory given back at the end: Python workers outlive tasks."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def chunks(batches, text_col, limit=CHUNK_BYTES):
    """Slices of the record batches, with the UTF-8 bytes and offsets of ``text_col`` (null: empty)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(text_col))
        text = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(text):
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(text))
            part = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            first = last


def space(data):
    """True for the bytes 0x20 and 0x09-0x0D, which separate words."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(inside, offsets):
    """Maximal runs of true bytes that do not cross the offsets: document index, start, end."""
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    start[at] = inside[at]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    end[at] = inside[at]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def line_spans(data, offsets):
    """Every \\n-separated line, empty ones too: document index, start, end."""
    cut = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], cut + 1])
    docs = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, "right") - 1])
    ends = np.concatenate([offsets[1:], cut])
    order_s, order_e = np.lexsort((starts, docs)), np.lexsort((ends, docs))
    return docs[order_s], starts[order_s], ends[order_e]


def mix(x):
    """A bijective finaliser of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n):
    """p**0 .. p**n and the inverses, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, p in ((0, _P), (1, pow(_P, -1, 1 << 64))):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def span_hashes(data, starts, ends):
    """64-bit polynomial hashes of byte spans, finalised with the span's length."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_STEPS = np.array([0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(docs, words, width=5):
    """Hashes of every window of ``width`` words; a shorter document is one shingle of all its words."""
    n = len(words)
    if n == 0:
        return docs, words
    head = np.maximum(n - width + 1, 0)
    value = np.zeros(head, np.uint64)
    for k in range(width if head else 0):
        value += words[k : k + head] * _STEPS[k % 5] * np.uint64(2 * (k // 5) + 1)
    full = docs[:head] == docs[width - 1 :] if head else np.zeros(0, bool)
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    counts = np.diff(np.concatenate([first, [n]]))
    short = np.flatnonzero(counts < width)
    tail = [mix(np.uint64(counts[i]) + np.add.reduce(words[first[i] : first[i] + counts[i]] * _STEPS[np.arange(counts[i]) % 5], keepdims=True)) for i in short]
    out_docs = np.concatenate([docs[:head][full], docs[first[short]]])
    return out_docs, np.concatenate([mix(value[full]), *tail]) if len(tail) else mix(value[full])


def per_document(values, offsets):
    """Sums of byte-level values over each document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
