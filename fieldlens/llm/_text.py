"""Vectorised hashing of words and characters over whole Arrow batches of texts.

Everything works on the UTF-8 bytes of a batch at once: a prefix sum of ``T[byte] * r**position``
(modulo 2**64, r odd) gives the hash of any byte range in two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text hashed at a time; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 19

_rng = np.random.Generator(np.random.Philox(20250101))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = U64(0x9E3779B97F4A7C15 | 1)
_BACK = U64(pow(int(_STEP), -1, 1 << 64))
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: 0x20 and 0x09 to 0x0D: what separates words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Every ASCII byte that is no letter or digit separates words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_STEP, _BACK)):
            full = np.full(size, base, U64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique hashes them first, which takes far longer than a sort."""
    out = np.sort(values)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def salt(i: int, place: int) -> np.uint64:
    return U64(i * int(_PLACE[place]) & 0xFFFFFFFFFFFFFFFF)


def fold(values: np.ndarray, place: int) -> np.uint64:
    """Hash of a multiset of hashes and its size."""
    return mix(values.sum(dtype=U64, keepdims=True) + np.full(1, len(values), U64) * _PLACE[place])[0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums from which span_hash reads the hash of any byte range."""
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((_LOWER if lower else _BYTE)[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64) * _PLACE[63])


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run without separators, and the offsets of each text's runs."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = separator[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = sep[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~sep & edge[:n])
    edge = np.empty(n + 1, bool)
    edge[n] = True
    edge[:n] = sep
    edge[offsets] = True
    ends = np.flatnonzero(~sep & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data, offsets, separator=BLANK, lower=True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z where ``lower``), and the offsets of each text's words."""
    starts, ends, at = spans(data, offsets, separator)
    return span_hash(prefix(data, lower), starts, ends), at


def shingles(words: np.ndarray, at: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of n words with the offsets by text; where ``short``, a text of 1 to n - 1 words
    has its whole sequence as one shingle."""
    count = np.diff(at)
    many = np.maximum(count - n + 1, 0)
    few = (count > 0) & (count < n) if short else np.zeros(len(count), bool)
    size = many + few
    out_at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(out_at[-1], U64)
    total = len(words) - n + 1
    if total > 0 and many.any():
        full = words[:total] * _PLACE[0]
        for j in range(1, n):
            full += words[j : total + j] * _PLACE[j]
        text_of = np.repeat(np.arange(len(count)), many)
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[out_at[text_of] + rank] = mix(full[at[text_of] + rank])
    for d in np.flatnonzero(few):
        w = words[at[d] : at[d + 1]]
        out[out_at[d]] = fold(w * _PLACE[: len(w)], 62)
    return out, out_at


def hash_family(functions: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of hash functions x -> (x ^ mask) * factor on well-mixed x."""
    rng = np.random.Generator(np.random.Philox(seed))
    mask, odd = rng.integers(0, 2**63, functions, dtype=np.uint64), rng.integers(1, 2**63, functions, dtype=np.uint64) | U64(1)
    return mask, odd | (rng.integers(0, 2, functions, dtype=np.uint64) << U64(63))


def minhash(values: np.ndarray, at: np.ndarray, functions: int, seed: int = 7) -> np.ndarray:
    """[texts, functions] least values of ``functions`` hash functions; texts without values hold the largest."""
    mask, odd = hash_family(functions, seed)
    out = np.full((len(at) - 1, functions), 2**64 - 1, U64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        block = max(1, int(np.searchsorted(at, 1 << 15)))  # rows of about 256 KB stay in cache
        for k in range(0, len(full), block):
            rows = full[k : k + block]
            lo, hi = at[rows[0]], at[rows[-1] + 1]
            part, starts = values[lo:hi], at[rows] - lo
            buf = np.empty(len(part), U64)
            for i in range(functions):
                np.bitwise_xor(part, mask[i], out=buf)
                np.multiply(buf, odd[i], out=buf)
                out[rows, i] = np.minimum.reduceat(buf, starts)
    return out


def long_list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """list<int64> column from 64-bit values and the number in each row."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values.view(np.int64) if values.dtype == U64 else values))


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: A table for bytes.translate(), A-Z as a-z.
LOWER = _LOW.tobytes()


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOW[data]


def char_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (of ``kind``, uint32 or uint64) of the n characters (A-Z as a-z; n a power of two) from each character on,
    and for each byte range its first window and the one after its last; shorter ranges have none. Ranges are in
    order and hold whole characters."""
    half, odd = (16, 0x9E3779B1) if kind is np.uint32 else (32, 0x9E3779B97F4A7C15)
    first, last = starts, ends
    x = _LOW[data].astype(kind)
    if len(data) and data.max() > 127:
        low, edges = x, np.flatnonzero((data & 0xC0) != 0x80)
        x = low[edges]
        for extra, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            wide = np.flatnonzero(data[edges] >= least)
            x[wide] |= low[edges[wide] + extra] << kind(8 * extra)
        first, last = np.searchsorted(edges, starts), np.searchsorted(edges, ends)
    x *= kind(odd)
    x ^= x >> kind(half)
    step = 1
    while step < n and step < len(x):
        x = x[:-step] * kind(odd * (2 * step + 1) % (1 << 2 * half) | 1) + x[step:]
        step *= 2
    for shift, factor in ((half, 0x85EBCA6B if half == 16 else 0xBF58476D1CE4E5B9), (half - 3, 0xC2B2AE35 if half == 16 else 0x94D049BB133111EB)):
        x ^= x >> kind(shift)
        x *= kind(factor)
    x ^= x >> kind(half)
    return x, first, np.maximum(last - n + 1, first)


def minhash32(values: np.ndarray, first: np.ndarray, end: np.ndarray, functions: int, seed: int = 7) -> np.ndarray:
    """[ranges, functions] least values of ``functions`` hash functions over values[first:end] of each range, with 32-bit
    hashes: values, which are well mixed, times random odd numbers. Empty ranges hold the largest. Ranges are in order."""
    odd = np.random.Generator(np.random.Philox(seed)).integers(0, 2**32, functions, dtype=np.uint32) | np.uint32(1)
    out = np.full((len(first), functions), 2**32 - 1, np.uint32)
    full = np.flatnonzero(end > first)
    if not len(full):
        return out
    for rows in np.split(full, np.flatnonzero(np.diff(first[full] >> 14)) + 1):  # about 64 KB stay in cache
        lo = first[rows[0]]
        part = values[lo : end[rows[-1]]]
        at = np.stack([first[rows], end[rows]], axis=1).reshape(-1)[:-1] - lo
        buf, got = np.empty_like(part), np.empty((functions, len(rows)), np.uint32)
        gaps = (at[1:-1:2] == at[2::2]).any()  # ranges that touch: only their starts are cut points
        for i in range(functions):
            np.multiply(part, odd[i], out=buf)
            got[i] = np.minimum.reduceat(buf, at[::2]) if gaps else np.minimum.reduceat(buf, at)[::2]
        out[rows] = got.T
    return out


def fixed_bitmap(keys, column: str, bits: int = 22) -> np.ndarray:
    """2**bits bits, those set at the top bits of ``keys[column]``: of fixed size however many keys there are."""
    from pyspark.sql import functions as F

    spot = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (
        keys.select(F.shiftright(spot, 6).alias("w"), (spot % 64).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
        .collect()  # 2**(bits - 6) rows at most
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in rows:
        out[r.w] = r.bits
    return out.view(U64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = 6 + int(len(bitmap)).bit_length() - 1
    spot = keys >> U64(64 - bits)
    return ((bitmap[(spot >> U64(6)).astype(np.int64)] >> (spot & U64(63))) & U64(1)).astype(bool)
