"""Columns of whole numbers as compressed blocks of bytes."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """One zstd block; each column has the fewest bytes that hold its values, by byte planes. Negative values take eight."""
    head, body = [len(columns)], []
    for c in columns:
        width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(c) or (c.min() >= 0 and int(c.max()) < 1 << 8 * w))
        narrow = np.ascontiguousarray(c.astype(f"<u{width}") if c.dtype.kind == "u" or width < 8 else c.astype("<i8"))
        head += [len(c), width]
        body.append(np.ascontiguousarray(narrow.view(np.uint8).reshape(-1, width).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def unpack(block: bytes) -> list[np.ndarray]:
    """The columns, as unsigned 64-bit numbers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    head = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for size, width in head:
        planes = raw[at : at + size * width].reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}").astype(np.uint64))
        at += size * width
    return out


def runs(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end of the last."""
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else np.zeros(1, np.int64)
