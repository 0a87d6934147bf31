"""Periodic runs of words by online dyadic square catching.

A document's words are appended to a Catcher. Each completed block of 2^k words is a catcher: it waits for the same
words at the distances its size stands for. An appended word completes one window of each size, and at most one
catcher of that size compares itself with it (by hash). A hit is a square's second half: it is compared word by
word to both sides, and the stretch stays open while appended words go on with its period. What several catchers find of
one stretch merges into one run with the smallest period. Every stretch is compared by its words, hashes only say where to look.

A run of period q has at least 4q words, so its first 3q hold a whole aligned block of each size s up to (3q + 1) / 2; the
catchers of the largest such s are responsible for q.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm import words as W
from earshot.session import bound_batches

PERIODS, LEAST = 4, 6  # a run has so many periods and words at least
APPENDED = 4096  # words appended at once; any number gives the same runs
FOUND = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RANDOM = np.random.default_rng(13)
_FACTOR = int(_RANDOM.integers(1 << 62, 1 << 63)) | 1
_MIX = np.uint64(int(_RANDOM.integers(1 << 62, 1 << 63)) | 1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash's base, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(2 * n, 1 << 14), _FACTOR, np.uint64))])
    return _POWERS


class Catcher:
    """Runs of a growing sequence of word ids."""

    def __init__(self, longest: int):
        """longest: words that a run may have at most (any bound will do)."""
        self.longest = longest
        self.ids = np.zeros(0, np.int64)
        self.n = 0
        self.sums = np.zeros(1, np.uint64)  # sums[i]: hash of the first i words
        self.stretches: list[list[int]] = []  # [start, end, period]
        self.open: list[list[int]] = []  # those that reach the last word
        self.recent: list[list[int]] = []  # those that reach a word of the last append()

    def append(self, ids: np.ndarray) -> None:
        u, v = self.n, self.n + len(ids)
        if v > len(self.ids):
            more = max(v, 2 * len(self.ids)) if u else v
            self.ids, self.sums = np.resize(self.ids, more) if u else np.zeros(more, np.int64), np.resize(self.sums, more + 1)
        self.ids[u:v] = ids
        p = powers(v + 1)
        mixed = ids.astype(np.uint64) * _MIX
        mixed ^= mixed >> np.uint64(29)
        self.sums[u + 1 : v + 1] = self.sums[u] + np.cumsum(mixed * p[u:v], dtype=np.uint64)
        self.n = v
        self.recent = list(self.open)
        self.open = [x for x in self.open if self._advance(x)]
        size = 2
        while (2 * size + 1) // 3 + size <= min(v, self.longest):
            self._catch(size, u, p)
            size *= 2

    def _advance(self, stretch: list[int]) -> bool:
        """Follow a stretch through the words it has not seen; does it reach the last one?"""
        end, period, step = stretch[1], stretch[2], 16
        while end < self.n:
            to = min(end + step, self.n)
            same = self.ids[end:to] == self.ids[end - period : to - period]
            if not same.all():
                stretch[1] = end + int(same.argmin())
                return False
            end, step = to, 4 * step
        stretch[1] = end
        return True

    def _before(self, start: int, period: int) -> int:
        """The first word from which words up to `start` repeat at the period's distance."""
        step = 16
        while start > 0:
            to = max(0, start - step)
            same = (self.ids[to:start] == self.ids[to + period : start + period])[::-1]
            if not same.all():
                return start - int(same.argmin())
            start, step = to, 4 * step
        return 0

    def _catch(self, size: int, u: int, p: np.ndarray) -> None:
        """Compare the windows of this size that the words from u on complete with the catchers responsible for their distance."""
        least, most = (2 * size + 1) // 3, (4 * size - 2) // 3  # the periods for which size is the largest block
        at = np.arange(max(u - size + 1, least), self.n - size + 1)
        block = (at - least) // size * size
        near = at - block <= most
        at, block = at[near], block[near]
        s = self.sums
        hit = s[at + size] - s[at] == (s[block + size] - s[block]) * p[at - block]
        at, block = at[hit], block[hit]
        for x, y, q in self.recent:  # parts of what is known
            if not len(at):
                return
            new = (block < x) | (at + size > y) | ((at - block) % q != 0)
            at, block = at[new], block[new]
        while len(at):
            b, q = int(block[0]), int(at[0] - block[0])
            if (self.ids[b : b + size] == self.ids[b + q : b + q + size]).all():
                found = [self._before(b, q), b + q + size, q]
                if self._advance(found):
                    self.open.append(found)
                self.stretches.append(found)
                self.recent.append(found)
                new = (block < found[0]) | (at + size > found[1]) | ((at - block) % q != 0)
                new[0] = False
            else:
                new = np.arange(len(at)) > 0
            at, block = at[new], block[new]

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start and period."""
        best: dict[tuple[int, int], int] = {}
        for x, y, q in self.stretches:
            if y - x >= max(LEAST, PERIODS * q):
                best[x, y] = min(q, best.get((x, y), q))
        return sorted((x, y - x, q) for (x, y), q in best.items())


def runs_of(documents: list[list], appended: int = APPENDED) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words. They are one sequence to the catcher, with a word of its own between two of them."""
    joined: list = []
    for words in documents:
        joined += words
        joined.append(object())
    last = dict(zip(joined, range(len(joined)), strict=True))
    ids = np.fromiter(map(last.__getitem__, joined), np.int64, len(joined))
    sizes = np.array([len(w) for w in documents], np.int64)
    caught = Catcher(int(sizes.max(initial=0)))
    for k in range(0, len(ids), appended):
        caught.append(ids[k : k + appended])
    starts = np.cumsum(sizes + 1) - sizes - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    runs = caught.runs()
    for (x, length, q), k in zip(runs, (np.searchsorted(starts, [r[0] for r in runs], "right") - 1).tolist(), strict=True):
        out[k].append((x - int(starts[k]), length, q))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def words_of(key: int | None, text: str | None) -> list[bytes]:
    """Words are what lies between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def with_repeated_tail(key: int | None, text: str | None) -> list[bytes]:
    """words_of(), for a tenth of the keys with a periodic tail: by h = crc32 of the key as text and g = h // 10, where h
    ends in 0, every word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Null keys have none.
    """
    words = words_of(key, text)
    n = len(words)
    h = crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", words: Callable[[int | None, str | None], list[bytes]] = words_of) -> DataFrame:
    """doc_id, runs (start, length, period by start and period), collapsed text of every row.

    words(key, text) gives a row's words. Null and empty texts have no runs and an empty collapsed text. Each row is taken
    for itself, also those that repeat a key or have none; other columns are ignored; an empty table gives no rows. Long texts
    are taken whole: time grows with n log n of their n words, memory with n.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        for part, texts in W.text_batches(batches):
            own = [words(k, t) for k, t in zip(part.column(0).to_pylist(), texts, strict=True)]
            runs = runs_of(own)
            found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in of_one] for of_one in runs]
            left = [b" ".join(collapsed(w, r)) for w, r in zip(own, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(RUN)), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (ties: first in order; without runs nulls), and SHA-256 of all runs and of the collapsed text."""

    def greater(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    best = found.withColumn("_best", F.aggregate("runs", none, greater))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
