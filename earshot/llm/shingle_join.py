"""N-gram Jaccard join by prefix trees: components of documents with similar shingle sets, exactly.

1. A count-min sketch of all words (two rows of 2**20 cells, merged by Spark) gives every shingle the rarity of its rarest word; shingles are ordered
   by rarity, then hash, in one 64-bit value, so that rare ones come first in every document alike.
2. Equal sets become one representative. Each set's prefix, which every linked set must meet, is shuffled by
   element. Sets that share one are compared by sketches (the parity of how many elements fall to each bit): where sketches
   differ in more bits than the elements that linked sets of these sizes may differ in, there is no link. The other
   pairs are candidates, and the components of candidates are blocks. A shared passage alone so joins no blocks.
3. Each block's texts (smaller than their sets) meet once and are linked by tries (trie.py). A block over CHUNK elements is dealt into
   chunks that all hold the block's few pivots; documents that do not end up with the block's main component
   are then compared with every chunk. No pair list is made anywhere, and no task holds more than a chunk and
   those documents.
4. Links between representatives are closed by connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm import blooms, trie, words
from earshot.operators.components import connected_components
from earshot.session import bound_batches, forget, stored

CELLS = 1 << 20
SLICE = 1 << 14
SALTS = 4
SEGMENT = 1 << 20
HASHED = 1 << 18
CHUNK = 1_000_000
LEAST_BITS, MOST_BITS = 64, 1 << 17  # of a sketch; it has up to twice as many as its set has elements
TILE = 8_192  # sets with one element that are compared at once; an element's sets meet in at most TILES blocks by TILES
TILES = 64
MIX = np.uint64(0x9E3779B97F4A7C15)


_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_VALUE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the base, or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        x = np.full(max(n, 1 << 16), _BASE if kind == "up" else pow(_BASE, -1, 1 << 64), np.uint64)
        x[0] = 1
        _powers[kind] = np.cumprod(x)
    return _powers[kind][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (cut at ASCII white space, A-Z lower-cased) of the texts in turn, and word counts.

    A polynomial hash over random byte values, from differences of one running sum per HASHED bytes.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        first = begin[at]
        upto = max(at + 1, int(np.searchsorted(end, first + HASHED, "right")))
        own = data[first : end[upto - 1]]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_VALUE[own] * _power("up", len(own)), out=sums[1:])
        x, y = begin[at:upto] - first, end[at:upto] - first
        h = (sums[y] - sums[x]) * _power("down", len(own))[x]
        h ^= h >> np.uint64(32)
        out[at:upto] = h * MIX
        at = upto
    starts = np.cumsum([1, *(len(p) + 1 for p in parts)])
    return out, np.diff(np.searchsorted(begin, starts))


def text_slices(batches, text_at: int = 1):
    """(rows, their texts) in slices of about SEGMENT characters."""
    for batch in batches:
        texts, at, held = batch.column(text_at).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= SEGMENT or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, held = i + 1, 0


def shingle_sets(levels: np.ndarray, texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted shingle values of each text: 8 bits of rarity over 56 bits of hash."""
    h, sizes = word_hashes(texts)
    level = np.minimum(levels[_cell(h, 0)], levels[_cell(h, 1)]).astype(np.uint64)

    def rolled(h: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
        size = len(h) - k + 1
        x, r = np.full(size, k, np.uint64), np.full(size, 255, np.uint64)
        for i in range(k):
            x = (x ^ h[i : i + size]) * MIX
            x ^= x >> np.uint64(29)
            r = np.minimum(r, level[i : i + size])
        x *= MIX
        return (r << np.uint64(56)) | (x >> np.uint64(8))

    every = rolled(h, level, n) if len(h) >= n else None
    out, at = [], 0
    for size in sizes.tolist():
        if size >= n:
            out.append(np.unique(every[at : at + size - n + 1]))
        elif size:
            out.append(rolled(h[at : at + size], level[at : at + size], size))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def _cell(h: np.ndarray, row: int) -> np.ndarray:
    """The cell of a word hash in one of the sketch's two rows."""
    return (h % np.uint64(CELLS)).astype(np.int64) if row == 0 else ((h >> np.uint64(40)) % np.uint64(CELLS)).astype(np.int64) + CELLS


def rarity_levels(docs: DataFrame, text: str) -> np.ndarray:
    """8 * log2 of the number of occurrences of all words in a cell, for each cell of both rows; over all rows of docs."""

    def count(batches):
        total = np.zeros(2 * CELLS, np.int32)
        for _, texts in text_slices(batches, text_at=0):
            h = word_hashes(texts)[0]
            for row in (0, 1):
                total += np.bincount(_cell(h, row), minlength=2 * CELLS).astype(np.int32)
        for k in np.flatnonzero(total.reshape(-1, SLICE).any(axis=1)):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "salt": pa.array([int(total.sum()) % SALTS], pa.int32()), "counts": pa.array([total[k * SLICE : (k + 1) * SLICE].tobytes()], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.int32 if len(c) == 4 * SLICE else np.int64).astype(np.int64)
        for k, c in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([c.tobytes()], pa.binary())})

    schema = "slice int, salt int, counts binary"
    parts = docs.select(text).mapInArrow(count, schema).repartition(16, "slice", "salt").mapInArrow(add, schema)
    total = np.zeros(2 * CELLS, np.int64)
    for r in parts.collect():  # at most 2 * CELLS / SLICE slices for each salt and partition
        total[r.slice * SLICE : (r.slice + 1) * SLICE] += np.frombuffer(r.counts, np.int64)
    return np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)


def sketch(elements: np.ndarray) -> bytes:
    """One bit for each of so many remainders of the elements: is it that of an odd number of them?

    Sets differ in at least as many elements as their sketches in bits. Halves of a sketch, one XOR the other, are the sketch with half the bits.
    """
    bits = min(max(LEAST_BITS, 1 << max(len(elements) - 1, 1).bit_length()), MOST_BITS)
    return np.packbits((np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def near_sets(sizes: np.ndarray, sketches: list[bytes], num: int, den: int, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set, in ascending order of size, the least place in its component of pairs that sizes and sketches allow to be linked.

    sides: only pairs of different sides count.
    """
    n = len(sizes)
    label = np.arange(n)
    widths = np.array([len(x) for x in sketches])
    tables: dict[tuple[int, int], np.ndarray] = {}
    spans = {w: (int(np.searchsorted(widths, w)), int(np.searchsorted(widths, w, "right"))) for w in np.unique(widths).tolist()}  # widths grow with sizes

    def table(width: int, folded: int) -> np.ndarray:
        if (width, folded) not in tables:
            if width == folded:
                lo, hi = spans[width]
                tables[width, folded] = np.frombuffer(b"".join(sketches[lo:hi]), np.uint64).reshape(hi - lo, -1)
            else:
                wide = table(width, 2 * folded)
                tables[width, folded] = wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]
        return tables[width, folded]

    upto = np.searchsorted(sizes * num, sizes * den, "right")
    for i in range(n - 1):
        w = int(widths[i])
        own = table(w, w)[i - spans[w][0]]
        for other, (lo, hi) in spans.items():
            first, last = max(lo, i + 1), min(hi, int(upto[i]))
            if other < w or first >= last:
                continue
            wanted = label[first:last] != label[i]
            if sides is not None:
                wanted &= sides[first:last] != sides[i]
            j = np.flatnonzero(wanted) + first
            if not len(j):
                continue
            differ = np.bitwise_count(table(other, w)[j - lo] ^ own).sum(axis=1, dtype=np.int64)
            both = sizes[i] + sizes[j]
            j = j[differ <= both - 2 * -(-num * both // (num + den))]
            if len(j):
                joined = np.unique(np.append(label[j], label[i]))
                label[np.isin(label, joined)] = joined[0]
    return label


def _signatures(docs: DataFrame, levels: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, key, prefix, sketch) of each row of docs (doc_id, text)."""

    def run(batches):
        for part, texts in text_slices(batches):
            sets = shingle_sets(levels, texts, n)
            prefixes = [s[: trie.prefix_size(len(s), num, den)] if len(s) else s for s in sets]
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)), pa.array(flat))
            keys, sketches = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), lists, pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "key", "prefix", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, prefix array<long>, sketch binary")


def _meetings(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(meeting, reps array<long>): the representatives, by size, that share a prefix element; once for each such list.

    No link crosses a step between sizes whose ratio is below num / den, so lists end there.
    """

    def rows(found: dict[bytes, np.ndarray]):
        at = np.cumsum([0, *(len(r) for r in found.values())]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(list(found.values()))))
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), lists], names=["meeting", "reps"])

    def run(batches):
        open_, last, size = [], None, 0  # the list that goes on
        seen: set[bytes] = set()
        for batch in batches:
            e, s, r = (batch.column(i).to_numpy() for i in range(3))
            if not len(e):
                continue
            new = np.concatenate([[e[0] != last or size * den < num * s[0]], (e[1:] != e[:-1]) | (s[:-1] * den < num * s[1:])])
            last, size = e[-1], s[-1]
            start = np.flatnonzero(new)
            if not len(start):
                open_.append(r)
                continue
            lists = [np.concatenate([*open_, r[: start[0]]])]
            several = np.flatnonzero(np.diff(start) > 1)
            lists += [r[a:b] for a, b in zip(start[several].tolist(), start[several + 1].tolist(), strict=True)]
            open_ = [r[start[-1] :]]
            found = {xxhash.xxh3_128_digest(x.tobytes()): x for x in lists if len(x) > 1}
            found = {k: x for k, x in found.items() if k not in seen}
            if found:
                yield rows(found)
            if len(seen) > 200_000:
                seen.clear()
            seen.update(found)
        whole = np.concatenate(open_) if open_ else ()
        if len(whole) > 1:
            yield rows({xxhash.xxh3_128_digest(whole.tobytes()): whole})

    each = reps.select(F.explode("prefix").alias("element"), "size", "rep").repartition("element").sortWithinPartitions("element", "size", "rep")
    return each.mapInArrow(run, "meeting binary, reps array<long>").groupBy("meeting").agg(F.first("reps").alias("reps"))


def _candidates(reps: DataFrame, num: int, den: int, tile: int = TILE) -> DataFrame:
    """(a, b): edges that join representatives with a common prefix element whose sizes and sketches allow a link; for each list a forest.

    A list of over `tile` representatives is cut into blocks, and each pair of blocks is compared by itself.
    """

    def solve(sides, ids, sizes, sketches):
        sides = np.array(sides)
        label = near_sets(np.array(sizes, np.int64), sketches, num, den, sides if sides.any() else None)
        return [(ids[i], ids[k]) for i, k in enumerate(label.tolist()) if i != k]

    def edges(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    def run(batches):
        at, group, found = None, [], []
        for batch in batches:
            for m, x, y, second, rep, size, own in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (m, x, y) != at:
                    found += solve(*zip(*group, strict=True)) if len(group) > 1 else []
                    at, group = (m, x, y), []
                group.append((second, rep, size, own))
            if len(found) > 10_000:
                yield edges(found)
                found = []
        found += solve(*zip(*group, strict=True)) if len(group) > 1 else []
        if found:
            yield edges(found)

    size = F.greatest(F.lit(tile), F.ceil(F.size("reps") / TILES).cast("int"))
    met = _meetings(reps, num, den).withColumn("_size", size).select("meeting", (F.ceil(F.size("reps") / F.col("_size")) - 1).cast("int").alias("_last"), "_size", F.posexplode("reps").alias("_i", "rep"))
    met = met.withColumn("_own", F.floor(F.col("_i") / F.col("_size")).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    x, y = F.least("_own", "_with"), F.greatest("_own", "_with")
    rows = met.select("meeting", x.alias("x"), y.alias("y"), (F.col("_own") > F.col("_with")).alias("second"), "rep").join(reps.select("rep", "size", "sketch"), "rep")
    rows = rows.select("meeting", "x", "y", "second", "rep", "size", "sketch").repartition("meeting", "x", "y").sortWithinPartitions("meeting", "x", "y", "size", "rep")
    return rows.mapInArrow(run, "a long, b long")


def _linked(rows: DataFrame, levels: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """(a, b): links that join the components inside each (block, chunk) of rows (block, chunk, rep, label, text)."""

    def solve(group):
        ids, labels, texts = zip(*group, strict=True)
        sets, at, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t or "")
            if held >= SEGMENT or i == len(texts) - 1:
                sets += shingle_sets(levels, list(texts[at : i + 1]), n)
                at, held = i + 1, 0
        own = trie.components(sets, num, den, None if labels[0] is None else list(labels))
        return [(ids[i], ids[r]) for i, r in enumerate(own) if ids[i] != ids[r]]

    def run(batches):
        words.give_back()
        at, group, found = None, [], []
        for batch in batches:
            for block, chunk, rep, label, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (block, chunk) != at:
                    found += solve(group) if len(group) > 1 else []
                    at, group = (block, chunk), []
                group.append((rep, label, text))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
                found = []
        found += solve(group) if len(group) > 1 else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        group = found = None
        words.give_back()

    ordered = rows.select("block", "chunk", "rep", "label", "text").repartition("block", "chunk").sortWithinPartitions("block", "chunk")
    return ordered.mapInArrow(run, "a long, b long")


def _chunk(rep: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(rep, F.lit("chunk")), chunks).cast("int")


def _in_chunks(rows: DataFrame, everywhere: Column, label: Column) -> DataFrame:
    """Each row in its own chunk, and rows that are `everywhere` in all chunks of their block."""
    own = _chunk(F.col("rep"), F.col("chunks"))
    return rows.select("block", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)).otherwise(F.array(own))).alias("chunk"), "rep", label.cast("long").alias("label"), "text")


def _tiles(rows: DataFrame) -> DataFrame:
    """Every chunk of a block with every part of the documents outside its main component, each pair in a task of its own."""
    own, part = _chunk(F.col("rep"), F.col("chunks")), F.pmod(F.xxhash64("rep", F.lit("rest")), F.col("rests")).cast("int")
    shown = ["block", "chunk", "rep", F.col("own").alias("label"), "text"]
    base = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("chunk", own * F.col("rests") + F.col("_r")).select(*shown)
    other = rows.filter("own <> main").withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1)))
    other = other.filter(F.col("_i") != own).withColumn("chunk", F.col("_i") * F.col("rests") + part).select(*shown)
    return base.unionByName(other)


def _repeats(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): links of documents with several texts to each text's representative."""
    pairs = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "key").distinct()
    several = pairs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    return pairs.join(several, "doc_id").join(reps.select("key", "rep"), "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def jaccard_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when den * intersection >= num * union.

    A document's set is its distinct n-word shingles; with fewer words, the whole sequence as one; without words or
    text it is empty and linked with nothing. component_id is the smallest key reachable by links, itself included.
    Rows that repeat a key are one document with several texts, linked with each other. Rows with a null key link with nothing and have a
    null component_id. An empty table gives no rows; other columns are ignored. Long texts are taken whole.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    levels = rarity_levels(docs, "text")
    whole_signed = stored(_signatures(docs, levels, n, num, den), "signatures")
    reps = whole_signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles", "prefix", "sketch")).alias("r"))
    reps = stored(reps.select("key", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("size"), F.col("r.prefix").alias("prefix"), F.col("r.sketch").alias("sketch")), "reps")
    signed = stored(whole_signed.select("doc_id", "n_shingles", "key"), "signed")
    forget(whole_signed)
    near = connected_components(_candidates(reps, num, den)).select(F.col("node").alias("rep"), F.col("component").alias("block"))
    nodes = near.join(reps.select("rep", "size"), "rep")
    blocks = nodes.groupBy("block").agg(F.ceil(F.sum("size") / chunk).alias("chunks"), F.array(F.min("rep"), F.max("rep"), F.min_by("rep", F.xxhash64("rep")), F.max_by("rep", F.xxhash64("rep"))).alias("pivots"))
    large = F.broadcast(blocks.filter("chunks > 1"))  # at most a row for every `chunk` elements of the input
    nodes = stored(nodes.join(large, "block", "left").fillna({"chunks": 1}), "nodes")
    bits = blooms.n_blocks(docs.count())
    marks = blooms.repeated_bits(nodes.select(F.xxhash64("rep").alias("_h")), "_h", bits, least=1)
    some = blooms.flag_repeated(docs.withColumn("_h", F.xxhash64("doc_id")), "_h", marks, bits, "_some").filter("_some").select("doc_id", "text")
    placed = nodes.join(some.withColumnRenamed("doc_id", "rep"), "rep")
    none = F.lit(None)
    links = _linked(placed.filter("chunks = 1").select("block", F.lit(0).alias("chunk"), "rep", none.cast("long").alias("label"), "text"), levels, n, num, den)
    if nodes.filter("chunks > 1").limit(1).count():
        hot = stored(placed.filter("chunks > 1"), "hot")
        first = stored(_linked(_in_chunks(hot, F.array_contains("pivots", F.col("rep")), none), levels, n, num, den), "links")
        found = connected_components(first).select(F.col("node").alias("rep"), F.col("component").alias("_c"))
        hot = stored(hot.join(found, "rep", "left").withColumn("own", F.coalesce("_c", "rep")).drop("_c"), "labelled")
        n_own = hot.groupBy("block", "own").agg(F.count("*").alias("_n"), F.sum("size").alias("_m"))
        best = n_own.groupBy("block").agg(F.max_by("own", "_n").alias("main"), (F.sum("_m") - F.max_by("_m", "_n")).alias("_rest"))
        best = best.select("block", "main", F.greatest(F.ceil(F.col("_rest") / chunk), F.lit(1)).cast("int").alias("rests"))
        again = hot.join(F.broadcast(best), "block")  # a row for each large block
        second = _linked(_tiles(again), levels, n, num, den)
        links = links.unionByName(first).unionByName(second)
    final = connected_components(links.unionByName(_repeats(signed, reps)))
    whole = reps.select("key", "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    whole = stored(whole, "whole")
    forget(reps, nodes)
    out = signed.select("doc_id", "n_shingles", "key").join(whole, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but the smallest key of each group of linked documents.

    Rows with a null key stay, and so do all rows that repeat a key that stays; an empty table gives no rows; other columns stay as they are.
    """
    groups = jaccard_groups(docs, n, num, den, key, text)
    gone = stored(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return blooms.drop_rows(docs, key, gone)
