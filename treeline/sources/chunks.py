"""Content-defined chunks, and the frame that carries chunks.

Cut points follow the published FastCDC scheme: a gear hash over the bytes, a stricter mask before the average size and a
looser one after it, bounds on both sides. The gear table is derived from a digest, so cut points are this library's own."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions import blake3

# Least, average and most bytes of a chunk.
MIN_SIZE, AVG_SIZE, MAX_SIZE = 256 * 1024, 1024 * 1024, 4 * 1024 * 1024
_GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear %d" % i).digest()[:8], "little") for i in range(256)], np.uint64)
#: Bytes that a hash depends on: those before have left its 64 bits.
_REACH = 64


def _mask(bits: int) -> np.uint64:
    """`bits` ones spread over the upper part of the hash, which depends on the most bytes."""
    return np.uint64(sum(1 << (63 - 2 * k) for k in range(bits)) if bits < 32 else (1 << 64) - 1)


def _gear_hashes(data: np.ndarray) -> np.ndarray:
    """After each byte, the sum of gear[b] << (bytes since): six steps, each of which doubles how far back it looks."""
    h, step = _GEAR[data], 1
    while step < _REACH:
        h[step:] += h[:-step] << np.uint64(step)
        step *= 2
    return h


def _ends(data: np.ndarray, strict: np.uint64, loose: np.uint64, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Where the hash of the last 64 bytes meets the strict, and the loose, mask; a block of bytes at a time."""
    out: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for lo in range(0, len(data), block):
        before = min(lo, _REACH - 1)
        h = _gear_hashes(data[lo - before : lo + block])[before:]
        for some, mask in zip(out, (strict, loose), strict=True):
            some.append(np.flatnonzero(h & mask == 0) + lo)
    return tuple(np.concatenate([np.zeros(0, np.int64), *some]) for some in out)


def cut(data: bytes, least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE) -> Iterator[bytes]:
    """The chunks of data, in order; concatenated they are data again. A chunk's hash starts anew after its `least` bytes: so
    its first 63 hashes are computed apart, and after them the next place that meets the mask is looked up."""
    bits = max(1, average.bit_length() - 1)
    masks = _mask(bits + 1), _mask(max(1, bits - 1))
    raw = np.frombuffer(data, np.uint8)
    places = _ends(raw, *masks)
    at = 0
    while at < len(data):
        first, normal, end = at + least, min(len(data), at + average), min(len(data), at + most)
        stop = end
        if first < end:
            settled = min(first + _REACH - 1, end)
            h = _gear_hashes(raw[first:settled])
            strict = np.arange(first, settled) < normal
            found = np.flatnonzero(np.where(strict, h & masks[0], h & masks[1]) == 0)
            if len(found):
                stop = first + int(found[0]) + 1
            else:
                for some, lo, hi in ((places[0], settled, normal), (places[1], max(settled, normal), end)):
                    k = int(np.searchsorted(some, lo))
                    if k < len(some) and some[k] < hi:
                        stop = int(some[k]) + 1
                        break
        yield data[at:stop]
        at = stop


def chunked(files: DataFrame, data: str = "data", least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE, with_data: bool = True, names: str = "sha256") -> DataFrame:
    """files: key columns and binary data. A row for each chunk: the keys, idx, hash, length and on request the bytes. names:
    what chunks are called by, sha256 or blake3."""
    keys = [c for c in files.columns if c != data]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keys) + ", idx bigint, hash string, length bigint" + ", chunk binary" * with_data

    name = {"sha256": lambda parts: [hashlib.sha256(c).digest() for c in parts], "blake3": blake3.digests}[names]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys, "idx", "hash", "length"] + ["chunk"] * with_data
        for frame in frames:
            for row in frame[[*keys, data]].itertuples(index=False):
                parts = list(cut(bytes(row[-1] or b""), least, average, most))
                out = [(*row[:-1], k, d.hex(), len(c), *([c] if with_data else [])) for k, (c, d) in enumerate(zip(parts, name(parts), strict=True))]
                if out:
                    yield pd.DataFrame(out, columns=columns)

    return files.select(*keys, data).mapInPandas(run, schema)


def framed(chunks: DataFrame, key: str) -> DataFrame:
    """One frame for each key: the number of chunks (u32, little-endian), then for each its 64-digit name, its length (u64)
    and its bytes. chunks: key, idx, hash, data. Built-in functions only."""
    little = lambda n, size: F.unhex(F.array_join(F.reverse(F.transform(F.sequence(F.lit(1), F.lit(2 * size - 1), F.lit(2)), lambda i: F.substr(F.lpad(F.hex(n), 2 * size, "0"), i, F.lit(2)))), ""))
    piece = F.concat(F.encode("hash", "UTF-8"), little(F.octet_length("data").cast("bigint"), 8), F.col("data"))
    rows = chunks.select(key, "idx", piece.alias("piece")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "piece"))).alias("x"))
    return rows.select(key, F.concat(little(F.size("x").cast("bigint"), 4), F.expr("aggregate(x, X'', (a, p) -> concat(a, p.piece))")).alias("frame"))


def unframe(frame: bytes) -> list[tuple[str, bytes]]:
    """The chunks of a frame; any other bytes are a ValueError."""
    if len(frame) < 4:
        raise ValueError("a frame has four bytes at least")
    at, out = 4, []
    for _ in range(struct.unpack("<I", frame[:4])[0]):
        if len(frame) - at < 72:
            raise ValueError("the frame ends early")
        name, (size,) = frame[at : at + 64], struct.unpack("<Q", frame[at + 64 : at + 72])
        if any(c not in b"0123456789abcdef" for c in name) or len(frame) - at - 72 < size:
            raise ValueError("a damaged entry")
        out.append((name.decode(), frame[at + 72 : at + 72 + size]))
        at += 72 + size
    if at != len(frame):
        raise ValueError("bytes after the last entry")
    return out


def unframed_batches(batches: Iterator[pd.DataFrame], key: str, piece: int = 2 << 20) -> Iterator[pd.DataFrame]:
    """Chunks of frames, given after so many bytes of frames: as rows, small chunks take many times the bytes of a frame."""
    shape = lambda out: pd.DataFrame(out, columns=[key, "idx", "hash", "data", "error"]).astype({"idx": "Int64"})
    for batch in batches:
        out, size = [], 0
        for k, frame in zip(batch[key], batch["frame"], strict=True):
            try:
                out += [(k, i, name, data, None) for i, (name, data) in enumerate(unframe(bytes(frame)))]
            except ValueError as e:
                out.append((k, None, None, None, str(e)))
            size += len(frame)
            if size >= piece:
                yield shape(out)
                out, size = [], 0
        yield shape(out)


def unframed(frames: DataFrame, key: str) -> DataFrame:
    """frames: key, frame. A row for each chunk; a damaged frame gives one row with an error."""
    kind = frames.schema[key].dataType.simpleString()

    return frames.select(key, "frame").mapInPandas(lambda batches: unframed_batches(batches, key), f"`{key}` {kind}, idx bigint, hash string, data binary, error string")
