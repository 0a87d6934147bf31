"""Patched frame-of-reference blocks for arrays of unsigned 32-bit ids.

Layout, little-endian: "PFR1", u32 count, u32 block length, u32 number of blocks, u32 starts[blocks + 1]
(the index of block starts, in bytes after the index), then the blocks. A block: u32 minimum, u8 width,
u8 exceptions n, u8 positions[n], u32 high bits[n], then block length * width / 8 bytes, into which the low
`width` bits of each value less the minimum are packed. The width is the bit length at `percentile` of the
block's values, and the values that need more bits are its exceptions. The last block repeats its last value.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 0.9


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) -> (blocks, BLOCK * width / 8) bytes."""
    lanes = np.ascontiguousarray(values.T)
    words = np.zeros((BLOCK * width // 64, values.shape[0]), np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8)


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _packed."""
    words = np.ascontiguousarray(np.ascontiguousarray(data).view(np.uint64).T)
    out = np.empty((BLOCK, data.shape[0]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        out[i] = x & mask
    return out.T


def encode(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    ids = np.asarray(ids, np.uint32)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    head = MAGIC + np.array([n, BLOCK, blocks], "<u4").tobytes()
    if not n:
        return head + bytes(4)
    values = np.concatenate([ids, np.full(blocks * BLOCK - n, ids[-1], np.uint32)]).reshape(blocks, BLOCK)
    low = values.min(axis=1)
    rest = (values - low[:, None]).astype(np.uint64)
    lengths = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    width = np.partition(lengths, max(0, int(np.ceil(percentile * BLOCK)) - 1), axis=1)[:, max(0, int(np.ceil(percentile * BLOCK)) - 1)]
    patched = lengths > width[:, None]
    n_exc = patched.sum(axis=1)
    body = 6 + 5 * n_exc
    starts = np.concatenate([[0], np.cumsum(body + BLOCK // 8 * width.astype(np.int64))])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at + 4], out[at + 5] = width, n_exc
    row, col = np.nonzero(patched)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_exc)])[row]
        out[at[row] + 6 + nth] = col
        high = (rest[row, col] >> width[row].astype(np.uint64)).astype("<u4")
        out[(at[row] + 6 + n_exc[row] + 4 * nth)[:, None] + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            out[(at[of] + body[of])[:, None] + np.arange(BLOCK // 8 * int(w))] = _packed(rest[of] & np.uint64((1 << int(w)) - 1), int(w))
    return head + starts.astype("<u4").tobytes() + out.tobytes()


def _read(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    low = data[at[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.uint64)
    width, n_exc = data[at + 4], data[at + 5].astype(np.int64)
    rest = np.zeros((len(at), BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            rest[of] = _unpacked(data[(at[of] + 6 + 5 * n_exc[of])[:, None] + np.arange(BLOCK // 8 * int(w))], int(w))
    row = np.repeat(np.arange(len(at)), n_exc)
    if len(row):
        nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n_exc)])[row]
        col = data[at[row] + 6 + nth]
        high = data[(at[row] + 6 + n_exc[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.uint64)
        rest[row, col] |= high << width[row].astype(np.uint64)
    return (rest + low[:, None]).astype(np.uint32)


def _index(blob: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    if blob[:4] != MAGIC:
        raise ValueError("not a PFR1 array")
    n, block, blocks = np.frombuffer(blob, "<u4", 3, 4)
    if block != BLOCK:
        raise ValueError(f"block length {block}")
    starts = np.frombuffer(blob, "<u4", int(blocks) + 1, 16).astype(np.int64)
    return int(n), starts, np.frombuffer(blob, np.uint8, offset=16 + 4 * (int(blocks) + 1))


def decode(blob: bytes) -> np.ndarray:
    n, starts, data = _index(blob)
    return _read(data, starts[:-1]).reshape(-1)[:n] if n else np.zeros(0, np.uint32)


def decode_block(blob: bytes, block: int) -> np.ndarray:
    """One block by the index, without reading the others."""
    n, starts, data = _index(blob)
    return _read(data, starts[block : block + 1]).reshape(-1)[: n - block * BLOCK]
