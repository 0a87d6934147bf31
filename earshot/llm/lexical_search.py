"""Ranked lexical search with norm buckets.

Pass one cuts every text into terms and keeps, for each document, its length and the counts of the terms that some item holds
(looked up in a table of the pieces' own bytes). Counts over all documents give term weights and every document's
integer impacts. Documents are then vectors of weighted impacts over the items' terms. In each slice of documents they are ordered by
length (norm) and cut into buckets. An item visits the buckets from the longest on and stops when, by Cauchy-Schwarz, no vector
of a bucket can reach its k-th best score. Inside a bucket the item's heaviest coordinates are summed first; the rest of
both vectors bounds what is missing, and documents that cannot reach the score are left. Survivors are
scored exactly in integers. A SEEDS-th of the documents is searched first; its k-th best scores are the first thresholds of all others.

Items are taken in blocks of BLOCK_BYTES of text, so what is sent to the tasks is bounded whatever the number of items.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm import words
from earshot.session import bound_batches, forget, stored

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM_BYTES = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)]).astype(np.uint8)
BLOCK_BYTES = 8 << 20  # of items' text searched at once
SLOTS = 1 << 18
SEEDS = 64
SLICE, ENTRIES = 1 << 14, 1 << 21  # documents, and their terms, ordered by length at once (or one batch)
BUCKET = 1024
FOCUS = 0.98  # share of an item's squared norm that its heaviest coordinates hold
VECTORS = "doc_id long, n long, terms array<int>, counts array<int>, seed boolean"
FOUND = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Each document's number of terms, and the numbers and counts of its terms of the vocabulary (numbers from 0)."""

    def learn(pieces: list[str], _) -> tuple[np.ndarray, np.ndarray]:
        ids = [vocabulary.get(p.encode("utf-8", "surrogatepass"), -1) + 1 for p in pieces]
        return np.array(ids, np.uint32), np.ones(len(ids), np.int64)

    def run(batches):
        known = words.Pieces(TERM_BYTES, lambda a, b: False, learn, SLOTS, 1)
        size = len(vocabulary) + 1
        for part, texts in words.text_batches(batches):
            ids, at = known.values([t or "" for t in texts])
            row = np.repeat(np.arange(len(texts)), np.diff(at))
            hit = ids > 0
            both, counts = np.unique(row[hit] * size + ids[hit].astype(np.int64) - 1, return_counts=True)
            offsets = pa.array(np.searchsorted(both, np.arange(len(texts) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (both % size, counts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), *lists, part.column(2)], names=["doc_id", "n", "terms", "counts", "seed"])

    seed = F.pmod(F.xxhash64(key), F.lit(SEEDS)) == 0
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string"), seed.alias("seed")).mapInArrow(run, VECTORS)


def document_counts(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary; a task gives one row for each term at most."""

    def run(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(own, pa.int32()), "df": pa.array(n[own])})

    out = np.zeros(size, np.int64)
    for r in found.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Slice:
    """Impact vectors of some documents, longest first, in buckets with the documents of each term."""

    def __init__(self, keys, n, lengths, terms, counts, n_docs: int, all_terms: int, weight: np.ndarray, bucket: int = BUCKET):
        row = np.repeat(np.arange(len(n)), lengths)
        m = 100 - 75 + (75 * n * n_docs) // max(all_terms, 1)
        impact = (1_000_000_000 * counts) // (1000 * counts + 8 * m[row])
        x = impact * np.sqrt(weight[terms])
        norm2 = np.bincount(row, x * x, len(n))
        order = np.argsort(-norm2, kind="stable")
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        self.keys, self.norm2 = keys[order], norm2[order]
        row = place[row]
        by = np.lexsort((row, terms, row // bucket))
        self.row, self.terms, self.impact, self.x = row[by], terms[by], impact[by], x[by]
        self.starts = np.arange(0, len(n), bucket)
        size = len(weight)
        self.index = np.searchsorted((self.row // bucket) * size + self.terms, np.arange(len(self.starts) * size + 1))
        self.size, self.bucket = size, bucket

    def search(self, own: np.ndarray, times: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of an item's k best documents with a score of at least `least`, and how many were scored.

        own, times: the item's terms and how often each occurs. Ties at the end keep all that share the last score.
        """
        q = times * np.sqrt(weight[own])
        heavy = np.argsort(-q, kind="stable")
        own, times, q = own[heavy], times[heavy], q[heavy]
        share = np.cumsum(q * q)
        norm = math.sqrt(share[-1]) if len(q) else 0.0
        focus = int(np.searchsorted(share, FOCUS * share[-1])) + 1 if len(q) else 0
        rest = np.sqrt(np.maximum(share[-1] - share[focus - 1], 0)) if len(q) else 0.0
        factor = times * weight[own]
        places, scores, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for b, start in enumerate(self.starts.tolist()):
            if norm * math.sqrt(self.norm2[start]) * (1 + 1e-9) < least:
                break  # nor can any later bucket
            width = min(self.bucket, len(self.keys) - start)
            lists = self.index[b * self.size + own], self.index[b * self.size + own + 1]
            at = words.ragged(lists[0][:focus], (lists[1] - lists[0])[:focus])
            qs = np.repeat(q[:focus], (lists[1] - lists[0])[:focus])
            local = self.row[at] - start
            part = np.bincount(local, qs * self.x[at], width)
            left2 = np.maximum(self.norm2[start : start + width] - np.bincount(local, self.x[at] ** 2, width), 0)
            able = (part + rest * np.sqrt(left2 + 1e-9 * self.norm2[start : start + width])) * (1 + 1e-9) >= least
            if not able.any():
                continue
            at = words.ragged(lists[0], lists[1] - lists[0])
            f = np.repeat(factor, lists[1] - lists[0])
            local = self.row[at] - start
            keep = able[local]
            exact = np.zeros(width, np.int64)
            np.add.at(exact, local[keep], f[keep] * self.impact[at[keep]])
            scored += int(able.sum())
            good = np.flatnonzero(exact >= least)
            places, scores = np.concatenate([places, start + good]), np.concatenate([scores, exact[good]])
            if len(scores) > k:
                least = max(least, int(np.partition(scores, -k)[-k]))
                keep = scores >= least
                places, scores = places[keep], scores[keep]
        return places, scores, scored


def _search(found: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, all_terms: int, weight: np.ndarray, k: int, least: list[int]) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each slice, if they score at least its threshold."""

    def run(batches):
        held: list = []

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keys = t.column("doc_id").combine_chunks()
            terms, counts = (t.column(c).combine_chunks() for c in ("terms", "counts"))
            lengths = np.diff(terms.offsets.to_numpy())
            places = Slice(np.arange(len(keys)), t.column("n").to_numpy(), lengths, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64), n_docs, all_terms, weight)
            out = []
            for i, (own, times) in enumerate(items):
                p, s, _ = places.search(own, times, weight, k, now[i])
                if len(s):
                    names = np.array([x if x is not None else np.iinfo(np.int64).max for x in keys.take(pa.array(places.keys[p])).to_pylist()], np.int64)
                    best = np.lexsort((names, -s))[:k]
                    out.append((np.full(len(best), i), places.keys[p[best]], s[best]))
                    if len(best) == k:
                        now[i] = max(now[i], int(s[best[-1]]))
            if out:
                i, p, s = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), keys.take(pa.array(p)), pa.array(s)], names=["item", "doc_id", "score"])

        now = list(least)
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= SLICE or sum(len(x.column(2).flatten()) for x in held) >= ENTRIES:
                yield from flush()
        if held:
            yield from flush()

    return found.filter("n > 0").select("doc_id", "n", "terms", "counts").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[str | None], k: int, key: str, text: str) -> DataFrame:
    """(item, rank, doc_id, score) for these items, numbered from 0."""
    counted = [Counter(terms_of(t)) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
    found = stored(vectors(docs, vocabulary, key, text), "vectors")
    n_docs, all_terms = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(found, len(vocabulary)) if vocabulary else np.zeros(0, np.int64)
    weight = weights(df, n_docs)
    items = []
    for c in counted:
        own = np.array([vocabulary[t] for t in c], np.int64)
        times = np.array(list(c.values()), np.int64)
        some = (df[own] > 0) & (weight[own] > 0)
        items.append((own[some], times[some]))
    seeds = stored(_best(_search(found.filter("seed"), items, n_docs, all_terms, weight, k, [1] * len(items)), k), "seeds")
    least = [1] * len(items)
    for r in seeds.filter(F.col("rank") == k).select("item", "score").collect():
        least[r.item] = r.score
    others = _search(found.filter("not seed"), items, n_docs, all_terms, weight, k, least)
    out = stored(_best(seeds.drop("rank").unionByName(others), k), "found")
    forget(found, seeds)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, ties to the smaller key.

    Null and empty texts have no terms: such documents are never found and such items find none. Rows of docs that repeat a
    key or have none (last in ties) are documents of their own. Of items that repeat an id, the one with the smallest text counts, null first; a null id
    is an id. Without documents or items there are no rows; other columns are ignored. Long texts are taken whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    asked = items.select(F.col(item).alias("item_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).groupBy("item_id").agg(F.min("t").alias("t"))
    asked = stored(asked, "items")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    kind = dict(asked.dtypes)["item_id"]
    out = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()  # about block_bytes
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {kind}")
        found = _search_block(docs, [r["t"] for r in own], k, key, text)
        found = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")  # a row for each item of the block
        out = found if out is None else out.unionByName(found)
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
c AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id), g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM n),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY t, n_docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // l)))))::BIGINT AS score FROM q JOIN w USING (t) JOIN c USING (t) JOIN n USING (doc_id), g GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
