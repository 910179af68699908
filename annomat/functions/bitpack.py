"""The same integer codecs as :mod:`annomat.functions.codecs`, in numpy, for tasks that read or write packed files."""

from __future__ import annotations

import numpy as np

CHUNK = 128
_MASK = np.uint64(0xFFFFFFFF)


def bits_needed(top: np.ndarray) -> np.ndarray:
    """Bits of unsigned 32-bit values."""
    return np.ceil(np.log2(top.astype(np.float64) + 1)).astype(np.int64)


def _grid(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of 128 values: its lane, the word in the lane and the bit in the word at which it starts."""
    r = np.arange(CHUNK)
    bit = (r // 4) * width
    return r % 4, bit // 32, bit % 32


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Chunks (n, 128) as words (n, 4 * width)."""
    out = np.zeros((len(values), 4 * width), np.uint64)
    lane, word, bit = _grid(width)
    for r in range(CHUNK if width else 0):
        v = values[:, r].astype(np.uint64)
        at = 4 * word[r] + lane[r]
        out[:, at] |= (v << np.uint64(bit[r])) & _MASK
        if bit[r] + width > 32:
            out[:, at + 4] |= v >> np.uint64(32 - bit[r])
    return out.astype(np.uint32)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Words (n, 4 * width) as chunks (n, 128)."""
    if not width:
        return np.zeros((len(words), CHUNK), np.uint32)
    lane, word, bit = _grid(width)
    w = words.astype(np.uint64)
    at = 4 * word + lane
    out = w[:, at] >> bit.astype(np.uint64)
    over = np.flatnonzero(bit + width > 32)
    out[:, over] |= w[:, at[over] + 4] << (32 - bit[over]).astype(np.uint64)
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32)


def zigzag(delta: np.ndarray) -> np.ndarray:
    d = delta.astype(np.int64)
    return np.where(d >= 0, 2 * d, -2 * d - 1).astype(np.uint32)


def unzigzag(value: np.ndarray) -> np.ndarray:
    u = value.astype(np.int64)
    return np.where(u % 2 == 0, u // 2, -((u + 1) // 2))


def chunked(values: np.ndarray) -> np.ndarray:
    """Values in rows of 128, zeros after the last."""
    out = np.zeros((-(-len(values) // CHUNK), CHUNK), np.uint32)
    out.reshape(-1)[: len(values)] = values
    return out


def encode(chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all chunks and where each chunk's begin, one more for the end."""
    width = bits_needed(chunks.max(axis=1)) if len(chunks) else np.empty(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(4 * width)])
    data = np.zeros(int(begin[-1]), np.uint32)
    for b in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == b)
        data[begin[own][:, None] + np.arange(4 * b)] = pack(chunks[own], b)
    return data, begin


def decode(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Chunks from words; ``begin`` is relative to ``data`` and has one more entry than there are chunks."""
    width = np.diff(begin) // 4
    out = np.zeros((len(width), CHUNK), np.uint32)
    for b in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == b)
        out[own] = unpack(data[begin[own][:, None] + np.arange(4 * b)], b)
    return out


def encode_frame(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    less = (values.astype(np.uint32) - np.uint32(1)).astype(np.uint32)
    return encode(chunked(less))


def decode_frame(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return (decode(data, begin) + np.uint32(1)).reshape(-1)


def encode_d1z(values: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = values.astype(np.int64)
    previous = np.concatenate([[before], v[:-1]])[: len(v)]
    data, begin = encode(chunked(zigzag(v - previous)))
    return data, begin, previous[::CHUNK].astype(np.uint32)


def decode_d1z(data: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
    deltas = unzigzag(decode(data, begin))
    return (np.cumsum(deltas, axis=1) + starts.astype(np.int64)[:, None]).astype(np.uint32).reshape(-1)
