"""BLAKE3 and keyed BLAKE3 for a batch of values at once: every 1 KiB chunk of every value is a lane of NumPy vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published function: the initial words, how message words are dealt in each next round, and the flags.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_NEXT = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT, _KEYED = 1, 2, 4, 8, 16
_CHUNK, _BLOCK = 1024, 64


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint32(by) | x << np.uint32(32 - by)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values: cv is (8, lanes), words (16, lanes); counter, size and flags a number for each lane."""
    n = cv.shape[1]
    rest = np.stack([(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)])
    a, b, c, d = cv[:4].copy(), cv[4:].copy(), np.repeat(_IV[:4, None], n, 1), rest
    for r in range(7):
        if r:
            words = words[_NEXT]
        for half in (0, 8):  # columns, then diagonals
            if half:
                b, c, d = b[[1, 2, 3, 0]], c[[2, 3, 0, 1]], d[[3, 0, 1, 2]]
            a = a + b + words[half : half + 8 : 2]
            d = _turn(d ^ a, 16)
            c = c + d
            b = _turn(b ^ c, 12)
            a = a + b + words[half + 1 : half + 8 : 2]
            d = _turn(d ^ a, 8)
            c = c + d
            b = _turn(b ^ c, 7)
            if half:
                b, c, d = b[[3, 0, 1, 2]], c[[2, 3, 0, 1]], d[[1, 2, 3, 0]]
    return np.concatenate([a ^ c, b ^ d])


def digests(values: list[bytes], key: bytes | None = None) -> list[bytes]:
    """The 32-byte digest of each value, keyed where a key of 32 bytes is given."""
    if not values:
        return []
    start = _IV if key is None else np.frombuffer(key, "<u4")
    if len(start) != 8:
        raise ValueError("a key has 32 bytes")
    mode = 0 if key is None else _KEYED
    sizes = np.array([len(v) for v in values], np.int64)
    chunks = np.maximum(-(-sizes // _CHUNK), 1)
    first = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    place = np.arange(total) - np.repeat(first, chunks)  # of each chunk in its value
    length = np.minimum(np.repeat(sizes, chunks) - place * _CHUNK, _CHUNK)
    data = np.zeros(total * _CHUNK, np.uint8)
    for v, at in zip(values, first.tolist(), strict=True):
        data[at * _CHUNK : at * _CHUNK + len(v)] = np.frombuffer(v, np.uint8)
    words = data.view("<u4").reshape(total, 16, 16)
    blocks = np.maximum(-(-length // _BLOCK), 1)
    alone = np.repeat(chunks, chunks) == 1
    cv = np.repeat(start[:, None], total, 1)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = mode | np.where(b == 0, _START, 0) | np.where(last, _END, 0) | np.where(last & alone[on], _ROOT, 0)
        cv[:, on] = _compress(cv[:, on], words[on, b].T, place[on], np.minimum(length[on] - b * _BLOCK, _BLOCK), flags)
    of = np.repeat(np.arange(len(values)), chunks)
    while len(of) > len(values):  # neighbours of one value become their parent; a last one without a neighbour stays
        n = np.bincount(of, minlength=len(values))
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        left = np.flatnonzero((at % 2 == 0) & (at + 1 < n[of]))
        pair = np.concatenate([cv[:, left], cv[:, left + 1]])
        flags = mode | _PARENT | np.where(n[of[left]] == 2, _ROOT, 0)
        cv[:, left] = _compress(np.repeat(start[:, None], len(left), 1), pair, np.zeros(len(left), np.int64), np.full(len(left), _BLOCK), flags)
        keep = at % 2 == 0
        cv, of = cv[:, keep], of[keep]
    out = np.ascontiguousarray(cv.T).astype("<u4")
    return [out[k].tobytes() for k in range(len(values))]


def _within(values: pd.Series, key: bytes | None, most: int = 1 << 24) -> pd.Series:
    """Hexadecimal digests, null for null, some values at a time."""
    out: list[str | None] = [None] * len(values)
    some: list[int] = []
    size, data = 0, [None if v is None else bytes(v) for v in values]
    for k, v in enumerate([*data, None]):
        if v is not None:
            some.append(k)
            size += len(v)
        if some and (size > most or k == len(data)):
            for at, d in zip(some, digests([data[j] for j in some], key), strict=True):
                out[at] = d.hex()
            some, size = [], 0
    return pd.Series(out, dtype=object)


def blake3(data: Column, key: bytes | None = None) -> Column:
    """Lower-case hexadecimal BLAKE3 of a binary column, keyed with a key of 32 bytes; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield _within(values, key)

    return run(data)
