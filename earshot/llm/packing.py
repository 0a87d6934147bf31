"""Packing documents into fixed windows by non-negative least squares over length combinations.

Documents are tokenized once and cut into full windows and one tail. The histogram of tail lengths (fewer
entries than the window has tokens, whatever the input) goes to the driver, which enumerates two to
four lengths that fill a window, solves for their repeat counts, rounds them, and solves again for what is left
while that places more; a greedy pass takes what remains of the combinations. Every tail has a rank among the tails of its length, so its sequence follows from the plan by arithmetic: no group of tails
meets in one task. Tails beyond the rounded counts are laid end to end in one stream that is cut at window
boundaries; what is left of it at the end goes to sequences whose sizes are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm import tokens, words
from earshot.session import bound_batches, stored

WINDOW = 2048
SPREAD = (12, 5)
SWEEPS = 12
SOLVES = 10
PIECES = "part int, doc_id long, start long, length long, crc long, doc_tokens long, rank long, ids binary"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(lengths: np.ndarray, window: int, spread: tuple = SPREAD) -> np.ndarray:
    """(n, depth) lengths that add up to the window, 0 for an unused place.

    Every length begins combinations of two to depth lengths: each further length but the last takes one of
    spread[i] evenly spaced shares of what is still free, and the last takes the rest.
    """
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    depth, found = len(spread) + 2, []
    taken, free = [lengths], window - lengths
    for k in range(2, depth + 1):
        rows = np.sort(np.stack([*taken, free], axis=1), axis=1)[there[free]]
        found.append(np.pad(np.unique(rows, axis=0), ((0, 0), (0, depth - k))))
        if k < depth:
            shares = np.arange(1, spread[k - 2] + 1) / (spread[k - 2] + 1)
            next_one = (free[:, None] * shares).astype(np.int64).ravel()
            taken, free = [np.repeat(t, len(shares)) for t in taken] + [next_one], np.repeat(free, len(shares)) - next_one
            good = there[next_one] & (free > 0)
            taken, free = [t[good] for t in taken], free[good]
    return np.concatenate(found)


def least_squares(combos: np.ndarray, histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that brings the lengths used by x repeats of the combos close to the histogram.

    Cyclic coordinate descent from zero, long combinations of common lengths first: each step is the exact minimum
    along one combination, which leaves most counts zero and the others large enough to survive rounding.
    """
    left = histogram.astype(float).tolist()
    rows = [[int(v) for v in c if v] for c in combos]
    norms = [sum(c.count(v) for v in c) for c in rows]
    order = sorted(range(len(rows)), key=lambda k: (-len(rows[k]), -min(histogram[v] for v in rows[k])))
    x = [0.0] * len(rows)
    for _ in range(sweeps):
        moved = 0.0
        for k in order:
            step = sum(left[v] for v in rows[k]) / norms[k]
            step = max(step, -x[k])
            if step:
                x[k] += step
                moved = max(moved, abs(step))
                for v in rows[k]:
                    left[v] -= step
        if moved < 0.5:
            break
    return np.array(x)


def rounded(combos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole repeats near x: running sums in the order of the combinations' longest lengths are rounded, so that what one loses its neighbours gain."""
    longest_first = -np.sort(-combos, axis=1)
    order = np.lexsort(longest_first.T[::-1])
    sums = np.floor(np.concatenate([[0.0], np.cumsum(x[order])]) + 0.5).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    out[order] = np.diff(sums)
    return out


@dataclass
class Plan:
    """Where the r-th piece of each length goes."""

    window: int
    low: dict  # length -> first ranks of its slots
    slots: dict  # length -> (first sequence, offset) of each slot
    planned: np.ndarray  # pieces of each length that have a slot
    solved: np.ndarray  # those of them that full windows and the least-squares solutions place
    stream: np.ndarray  # where the other pieces of each length begin in the stream
    first: int  # sequence at which the stream begins
    full: int  # full windows of the stream
    tail: np.ndarray  # ends, within the stream's last window, of its sequences

    def place(self, length: int, rank: int):
        """Yield (start in the piece, length, sequence, offset)."""
        if rank < self.planned[length]:
            k = np.searchsorted(self.low[length], rank, "right") - 1
            first, offset = self.slots[length][k]
            yield 0, length, first + rank - int(self.low[length][k]), offset
            return
        at = int(self.stream[length]) + (rank - int(self.planned[length])) * length
        done = 0
        while done < length:
            w, inside = divmod(at + done, self.window)
            if w < self.full:
                sequence, offset, end = self.first + w, inside, self.window
            else:
                k = int(np.searchsorted(self.tail, inside, "right"))
                begin = int(self.tail[k - 1]) if k else 0
                sequence, offset, end = self.first + self.full + k, inside - begin, int(self.tail[k]) - begin
            n = min(length - done, end - offset)
            yield done, n, sequence, offset
            done += n


def plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """The plan for so many pieces of each length (1 to window)."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    total = left.copy()
    low, slots, sequence = {}, {}, 0

    def use(combo, n):
        nonlocal sequence
        offset = 0
        for length in combo:
            if length:
                low.setdefault(length, []).append(int(total[length] - left[length]))
                slots.setdefault(length, []).append((sequence, offset))
                left[length] -= n
                offset += length
        sequence += n

    if left[window]:
        use((window,), int(left[window]))
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window) if len(lengths) else np.zeros((0, 1), np.int64)
    for _ in range(SOLVES):
        there = left.copy()
        there[0] = 1
        combos = combos[(there[combos] > 0).all(axis=1)]
        if not len(combos):
            break
        n, before = rounded(combos, least_squares(combos, left)), int(left.sum())
        for k in np.argsort(-n, kind="stable")[: int((n > 0).sum())]:
            combo = [int(v) for v in combos[k] if v]
            most = min(int(n[k]), *(int(left[v]) // combo.count(v) for v in combo))
            if most:
                use(combo, most)
        if 20 * (before - int(left.sum())) < before:
            break
    solved = total - left
    for c in combos:  # what the solutions leave, greedily
        combo = [int(v) for v in c if v]
        most = min(int(left[v]) // combo.count(v) for v in combo)
        if most > 0:
            use(combo, most)
    stream = np.concatenate([[0], np.cumsum(left * np.arange(window + 1))])
    full, rest = divmod(int(stream[-1]), window)
    sizes = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return Plan(window, {k: np.array(v) for k, v in low.items()}, slots, total - left, solved, stream[:-1], sequence, full, np.cumsum(sizes, dtype=np.int64) if sizes else np.zeros(0, np.int64))


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, text: str = "text", key: str = "doc_id", piecewise: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty, and an empty text is one token (end_id). Rows that repeat a key are packed
    each for itself, also those with a null key. An empty table gives no rows. Other columns are ignored. Long texts are encoded whole
    and cut into windows.
    """
    tokenizer = tokenizer or tokens.tokenizer_path()
    bound_batches(docs.sparkSession)

    def cut(batches):
        words.give_back()
        encoder, part = tokens.encoder(tokenizer, piecewise), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = [0] * (window + 1)
        for batch, texts in words.text_batches(batches, most=words.SMALL_SLICE):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    n = len(piece) // 4
                    rows.append((part, doc, at // 4, n, zlib.crc32(piece), len(ids) // 4, seen[n], None if n == window else piece))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 6, pa.binary()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    pieces = stored(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(cut, PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    layout = plan(histogram, window)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def placed(batches):
        words.give_back()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for at, n, sequence, offset in layout.place(r["length"], r["rank"] + r["before"]):
                    crc = r["crc"] if n == r["length"] else zlib.crc32(r["ids"][4 * at : 4 * (at + n)])
                    rows.append((r["doc_id"], r["start"] + at, n, crc, r["doc_tokens"], sequence, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])

    return pieces.join(before, ["part", "length"]).mapInArrow(placed, PACKED)
