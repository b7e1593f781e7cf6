"""Words of many texts at once: runs of bytes in an Arrow buffer, found and hashed with array operations."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 22  # bytes looked at in one step
PLACES = 1024  # bytes of a word that the table of random numbers covers

#: Lower case for A-Z, every other byte as it is.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finalizer of a known generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_set(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


def slices(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(from, to) of neighbouring texts with at most ``most`` bytes together; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes.astype(np.int64)), 0
    while lo < len(ends):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right"))
        yield lo, max(hi, lo + 1)
        lo = max(hi, lo + 1)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and where each begins; the last number is the end."""
    texts = pc.fill_null(texts, "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes; no run goes on from one text to the next."""
    starts, ends, inner = [], [], np.unique(offsets)
    for lo in range(0, len(data), BLOCK):
        hi = min(len(data), lo + BLOCK)
        flag = inside[data[lo:hi]]
        first, last = flag.copy(), flag.copy()
        first[1:] &= ~flag[:-1]
        last[:-1] &= ~flag[1:]
        if lo:
            first[0] &= not inside[data[lo - 1]]
        if hi < len(data):
            last[-1] &= not inside[data[hi]]
        cut = inner[(inner >= lo) & (inner < hi)] - lo
        first[cut] = flag[cut]
        cut = inner[(inner > lo) & (inner <= hi)] - lo - 1
        last[cut] = flag[cut]
        starts.append(np.flatnonzero(first) + lo)
        ends.append(np.flatnonzero(last) + lo + 1)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number for each run, never 0; A-Z count as a-z.

    It is the sum of a random number for each byte and its place, so equal words and only by chance
    others have equal numbers.  Words of over ``PLACES`` bytes take a digest.
    """
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    upto, lo = np.cumsum(np.minimum(sizes, PLACES)), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK, "right")))
        size = np.minimum(sizes[lo:hi], PLACES)
        before = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(before, size)
        byte = FOLD[data[np.repeat(starts[lo:hi], size) + place]]
        out[lo:hi] = np.add.reduceat(_TABLE[(place << 8) | byte], before)
        lo = hi
    for i in np.flatnonzero(sizes > PLACES):
        word = FOLD[data[starts[i]:ends[i]]].tobytes()
        out[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    out = mix(out)
    out[out == 0] = 1
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)


def bitmap_slots(n: int) -> int:
    """Binary logarithm of the bits of a bitmap for n hashes: 16 bits a hash, 8 KB to 256 MB in all."""
    return min(31, max(16, (16 * max(n, 1) - 1).bit_length()))


def in_bitmap(bitmap: np.ndarray, bits: int, x: np.ndarray) -> np.ndarray:
    slot = x >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def make_bitmap(hashed, column: str, n: int):
    """(numpy bytes, bits): which slots the hashes in ``column`` of a DataFrame take.

    Its size follows from ``n`` up to 256 MB; a fuller bitmap lets more through and loses nothing.
    """
    from pyspark.sql import functions as F

    bits = bitmap_slots(n)
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = hashed.groupBy(F.shiftright(slot, 15).alias("b")).agg(
        F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767).cast("long"))).alias("bytes")
    ).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in rows:
        out[row["b"] * 4096:(row["b"] + 1) * 4096] = np.frombuffer(row["bytes"], np.uint8)
    return out, bits
