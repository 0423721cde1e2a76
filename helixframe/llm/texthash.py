"""Word and shingle hashes of whole texts, computed on Arrow buffers.

Words are ``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z. A text's set holds one 64-bit
hash for each distinct run of ``k`` words; a text of 1 to k-1 words gives one hash of
the whole sequence, a text without words (or null) the empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_MULT = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 18


def _tables():
    rng = np.random.RandomState(20240229)
    byte = rng.randint(0, 1 << 32, 256).astype(np.uint64) << np.uint64(32) | rng.randint(0, 1 << 32, 256).astype(np.uint64)
    byte[65:91] = byte[97:123]
    space = np.zeros(256, bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    coef = rng.randint(0, 1 << 32, 16).astype(np.uint64) << np.uint64(32) | rng.randint(0, 1 << 32, 16).astype(np.uint64) | np.uint64(1)
    return byte, space, coef


_CACHE: dict = {}


def _powers(n: int):
    """Powers of the multiplier and of its inverse, 0..n."""
    if _CACHE.get("n", -1) < n:
        size = max(n, _STEP) + 1
        up = np.full(size, _MULT, np.uint64)
        down = np.full(size, pow(_MULT, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _CACHE.update(n=size - 1, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _CACHE["up"], _CACHE["down"]


def mix(x):
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_buffers(column: pa.Array):
    """(bytes, offsets) of a string array; nulls are empty."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64, n + 1 + column.offset)[column.offset:]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Hash of each word in order, and the number of words before each text's end."""
    if "byte" not in _CACHE:
        _CACHE["byte"], _CACHE["space"], _CACHE["coef"] = _tables()
    byte, space = _CACHE["byte"], _CACHE["space"]
    total = len(data)
    cut = np.zeros(total + 1, bool)
    cut[offsets] = True
    hashes, starts = [], []
    at = 0
    while at < total:
        end = min(total, at + _STEP)
        # a slice ends at white space or at a text's end, so no word is split
        while end < total and not cut[end] and not space[data[end - 1]]:
            nxt = min(total, end + 4096)
            stop = np.flatnonzero(space[data[end:nxt]] | cut[end:nxt])
            if len(stop):
                end += int(stop[0])
                break
            end = nxt
        part = data[at:end]
        n = len(part)
        gap = space[part]
        first = ~gap
        first[1:] &= gap[:-1] | cut[at + 1:end]
        last = ~gap
        last[:-1] &= gap[1:] | cut[at + 1:end]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[part] * up[:n], out=run[1:])
        h = (run[e] - run[s]) * down[s]
        hashes.append(mix(h ^ ((e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
        starts.append(s + at)
        at = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return words, np.searchsorted(start, offsets, "left")


def shingle_sets(column: pa.Array, k: int = 5):
    """Yields (row, sorted distinct hashes) for every row of the array."""
    data, offsets = utf8_buffers(column)
    n = len(offsets) - 1
    row = 0
    while row < n:
        # a few megabytes of text at a time bound the working memory
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 2 * _STEP, "right")) - 1)
        stop = min(stop, n)
        words, ends = word_hashes(data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        coef = _CACHE["coef"] if "coef" in _CACHE else None
        m = len(words) - k + 1
        if m > 0:
            sh = np.zeros(m, np.uint64)
            for i in range(k):
                sh += words[i:i + m] * coef[i]
            sh = mix(sh)
        for j in range(stop - row):
            a, b = int(ends[j]), int(ends[j + 1])
            if b - a >= k:
                x = np.sort(sh[a:b - k + 1])
                keep = np.ones(len(x), bool)
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                yield row + j, x[keep]
            elif b > a:
                y = b - a
                for w in words[a:b].tolist():
                    y = int(mix(np.array([(y * _MULT + w) & _MASK], np.uint64))[0])
                yield row + j, np.array([y], np.uint64)
            else:
                yield row + j, np.zeros(0, np.uint64)
        row = stop


def set_key(hashes: np.ndarray) -> int:
    """Order-free 64-bit key of a set of hashes, as a signed integer."""
    with np.errstate(over="ignore"):
        a = int(np.add.reduce(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)) if len(hashes) else 0
    a = (a + len(hashes) * 0xE7037ED1A0B428DB) & _MASK
    a ^= a >> 32
    a = (a * 0xD6E8FEB86659FD93) & _MASK
    a ^= a >> 32
    return a - (1 << 64) if a >= 1 << 63 else a
