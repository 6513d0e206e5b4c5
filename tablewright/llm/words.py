"""Words of Arrow text batches as numpy arrays.

Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased.  A batch is cut
into chunks of whole texts, about ``CHUNK`` bytes each, so memory stays bounded
by the longest text; every byte of every text is read.  NULL texts are empty.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {}


def mix(x):
    """Finalise 64-bit hashes (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(base, n):
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK), base, np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def bytes_of(text):
    """``(data, offsets)`` of a string array; NULL is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(text, size=CHUNK):
    """``(first row, data, offsets)`` for runs of whole texts."""
    data, at = bytes_of(text)
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data, at):
    """``(row, start, end, hash)`` of the words of one chunk."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    low = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(at, start, side="right") - 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[low] * _power(_BASE, len(data)), out=total[1:])
    code = (total[end] - total[start]) * _power(pow(_BASE, -1, 1 << 64), len(data))[start]
    return row, start, end, mix(code + (end - start).astype(np.uint64))


def shingles(row, code, width, n_rows):
    """``(row, first word, hash)`` of runs of ``width`` words inside a text.

    A text with fewer words has its whole sequence as one shingle; a text
    without words has none.
    """
    n = len(row)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    if n >= width:
        first = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    else:
        first = np.zeros(0, np.int64)
    value = np.zeros(len(first), np.uint64)
    for k in range(width):
        value += code[first + k] * factor[k]
    value = mix(value)
    count = np.bincount(row, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.searchsorted(row, short)
        few = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            few[has] += code[begin[has] + k] * factor[k]
        few = mix(few ^ (count[short].astype(np.uint64) << np.uint64(56)))
        rows = np.concatenate([row[first], short])
        order = np.argsort(rows, kind="stable")
        return rows[order], np.concatenate([first, begin])[order], np.concatenate([value, few])[order]
    return row[first], first, value
