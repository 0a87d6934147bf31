"""Values of the pieces of texts, looked up as numpy arrays, many texts at a time.

A piece is a run of bytes between spaces; other classes of bytes may cut it too. Each worker keeps the values of
pieces of up to KEY - 1 bytes in a table that holds the pieces' own bytes, so a hit is exact; a new piece takes the
row of an older one. ASCII capitals count as small letters.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEY = 32  # bytes of a key: a piece, zeros, and its length in the last one
MOST = 8  # values of a piece in the table, unless said otherwise
NONE = np.uint32(0xFFFFFFFF)  # no value (no id, and as a float not a number)
SLICE_BYTES = 1 << 20
SMALL_SLICE = 1 << 18  # where other tables share the worker
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
WITHIN = np.where(np.arange(KEY) < np.arange(KEY)[:, None], 255, 0).astype(np.uint8)  # row n keeps n bytes
_MIX = np.random.default_rng(20240301).integers(0, 1 << 63, KEY // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def give_back() -> None:
    """Return what this worker has freed to the machine: workers serve later stages too, whose own tables come on top."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), then starts[1] and so on."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class Pieces:
    """classes: a class of each byte, 0 for those between pieces. cuts(a, b): does a piece end between bytes of these classes?

    learn(pieces, one_class): (their values as uint32, how many of each piece); one_class has the class that all bytes of
    a piece share, or 0.
    """

    def __init__(self, classes: np.ndarray, cuts, learn, slots: int, most: int = MOST):
        self.classes, self.learn = classes, learn
        self.n = n = int(classes.max()) + 1
        pairs = [(a, b, a != 0 and b != 0 and cuts(a, b)) for a in range(n) for b in range(n)]
        self.ends = np.array([a != 0 and (cut or b == 0) for a, b, cut in pairs])
        self.begins = np.array([b != 0 and (cut or a == 0) for a, b, cut in pairs])
        self.most, self.table = most, np.zeros((slots, KEY // 4 + most), np.uint32)

    def values(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the values of all pieces of the texts in turn, where each text's begin and the last one's end)."""
        data = LOWER[np.frombuffer("\n".join(["", *texts, ""]).encode("utf-8", "surrogatepass") + bytes(KEY), np.uint8)]
        size = len(data) - KEY
        c = self.classes[data[:size]]
        pair = c[:-1] * np.uint8(self.n) + c[1:]
        begin, end = np.flatnonzero(self.begins[pair]) + 1, np.flatnonzero(self.ends[pair]) + 1
        n = end - begin
        short = n < KEY
        keys = np.lib.stride_tricks.as_strided(data, (size, KEY), (1, 1))[begin]
        keys &= WITHIN[np.where(short, n, 0)]
        keys[:, KEY - 1] = np.where(short, n, 255)
        wide = keys.view(np.uint64)
        h = np.zeros(len(n), np.uint64)
        for k in range(KEY // 8):
            h = (h ^ wide[:, k]) * _MIX[k]
            h ^= h >> np.uint64(31)
        slot = (h % np.uint64(len(self.table))).astype(np.int64)
        rows = self.table[slot]
        hit = (rows[:, : KEY // 4] == keys.view(np.uint32)).all(axis=1) & short
        rows[~hit, KEY // 4 :] = NONE
        found = rows[:, KEY // 4 :]
        there = found != NONE
        counts = there.sum(axis=1)
        miss = np.flatnonzero(~hit)
        if len(miss):
            # one of each new piece; those too long for a key, and those whose hash another one has, are taken each for itself
            _, one, same = np.unique(h[miss], return_index=True, return_inverse=True)
            alone = ~short[miss] | (wide[miss] != wide[miss[one[same]]]).any(axis=1)
            new = miss[np.concatenate([one, np.flatnonzero(alone)])]
            where = same.copy()
            where[alone] = len(one) + np.arange(int(alone.sum()))
            raw = data.tobytes()
            pieces = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
            c = self.classes[keys[new, : KEY - 1]]
            one_class = np.where(short[new] & (((c == c[:, :1]) | (WITHIN[np.where(short[new], n[new], 0), : KEY - 1] == 0)).all(axis=1)), c[:, 0], 0)
            flat, sizes = self.learn(pieces, one_class)
            starts = np.cumsum(sizes) - sizes
            fits = np.flatnonzero(short[new] & (sizes <= self.most))
            row = np.full((len(fits), KEY // 4 + self.most), NONE, np.uint32)
            row[:, : KEY // 4] = keys[new[fits]].view(np.uint32)
            row[:, KEY // 4 :][np.arange(self.most) < sizes[fits, None]] = flat[ragged(starts[fits], sizes[fits])]
            self.table[slot[new[fits]]] = row
            counts[miss] = sizes[where]
            out = np.empty(int(counts.sum()), np.uint32)
            from_miss = np.repeat(~hit, counts)
            out[~from_miss] = found[there]
            out[from_miss] = flat[ragged(starts[where], sizes[where])]
        else:
            out = found[there]
        lengths = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
        first = np.searchsorted(begin, np.cumsum(lengths + 1) - lengths)
        return out, np.concatenate([[0], np.cumsum(counts)])[np.append(first, len(begin))]


def slices(column, most: int = SLICE_BYTES):
    """(first row, number of rows, texts) of an Arrow column of texts, in slices of about `most` bytes; a text is never cut."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(lengths):
        held += n
        if held >= most or i == len(lengths) - 1:
            yield at, i + 1 - at, column.slice(at, i + 1 - at).to_pylist()
            at, held = i + 1, 0


def text_batches(batches, text_at: int = 1, most: int = SLICE_BYTES):
    """(batch slice, its texts), each of about `most` bytes of text."""
    for batch in batches:
        for at, n, texts in slices(batch.column(text_at), most):
            yield batch.slice(at, n), texts
