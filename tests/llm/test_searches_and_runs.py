"""Lexical search, pivot search and periodic runs beside brute force, with nulls, ties, repeats, long and empty texts."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import lexical_search, periodic_runs, pivot_search, queries

# --- periodic runs ---


def brute_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, length, q) for (a, length), q in out.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=9), st.sampled_from([1, 5, 64, 4096]))
def test_runs(parts, appended):
    words = [x for block, times in parts for x in block * times]
    assert periodic_runs.runs_of([words], appended) == [brute_runs(words)]


def test_many_documents_are_apart():
    r = random.Random(2)
    docs = [[r.randrange(2) for _ in range(r.randrange(60))] for _ in range(200)] + [[], [1], [1] * 50_000]
    assert periodic_runs.runs_of(docs, 100) == [brute_runs(d) if len(d) < 99 else [(0, 50_000, 1)] for d in docs]


def planted(key, text):
    w = (text or "").encode().split()
    h, n = crc32(str(key).encode()), len(w)
    if key is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query_13(spark, tmp_path):
    r = random.Random(5)
    texts = [" ".join(r.choice(["la", "lo", "é", "x y", "a b"]) for _ in range(r.randrange(80))) for _ in range(300)]
    texts += [None, "", " \n\t ", "la " * 30_000, "a b\x0bc\r\n" * 9, "la " * 5]
    rows = [(k, t, "x", 0) for k, t in enumerate(texts)] + [(None, "la " * 40, None, None), (7, texts[7], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, start int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, t, *_ in rows:
        w = planted(k, t)
        runs = brute_runs(w) if len(w) < 5000 else periodic_runs.runs_of([w])[0]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        drop = {i for a, length, q in runs for i in range(a + q, a + length)}
        text = b" ".join(x for i, x in enumerate(w) if i not in drop)
        lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
        want.append((k, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(x[1] > 0 for x in want) > 20
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# --- pivot search ---


def brute_top(rows, k, step):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            x = [math.floor(256 * c) for c in x]
            v[i] = min(v.get(i, x), x)
    out = []
    for q in v:
        if q % step == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], x, strict=False)), i) for i, x in v.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(s)]
    return sorted(out)


def test_pivot_search(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + 0.1 * r.normal(size=6)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(2000, None), (2005, [None] * 6), (2010, [math.nan] * 6), (2015, [math.inf] * 6), (None, rows[0][1]), (10, rows[10][1]), (10, [9.0] * 6), (2020, [0.0] * 6), (2025, [1.0, 2.0]), (2030, []), (-5, rows[5][1])]
    df = spark.createDataFrame([(*x, 1, "a") for x in rows], "vec_id long, embedding array<double>, score int, d string")
    for block in (40, 4096):
        got = sorted(map(tuple, pivot_search.top_k(df, F.col("vec_id") % 5 == 0, 3, block=block).collect()))
        assert got == brute_top(rows, 3, 5)
    assert pivot_search.top_k(df.limit(0), F.col("vec_id") % 5 == 0, 3).count() == 0
    assert sorted(map(tuple, pivot_search.top_k(df.filter("vec_id in (0, 1)"), F.col("vec_id") % 5 == 0, 3).collect())) == brute_top([x for x in rows if x[0] in (0, 1)], 3, 5)


def test_pivots_leave_most_candidates_alone():
    r = np.random.default_rng(4)
    v = np.floor(256 * (r.normal(size=(20, 8))[r.integers(0, 20, 3000)] + 0.02 * r.normal(size=(3000, 8))))
    pivots = v[:24]
    side = {"v": v, "d": pivot_search.distances(v, pivots).astype(np.float32), "size2": (v * v).sum(axis=1)}
    asked = {k: x[:30] for k, x in side.items()} | {"least": np.full(30, -np.inf)}
    q, x, s, evaluated = pivot_search.best_in_block(asked, side | {"first": np.arange(3000)}, 5)
    exact = (v[:30] @ v.T).astype(np.int64)
    for i in range(30):
        assert x[q == i].tolist() == np.lexsort((np.arange(3000), -exact[i]))[:5].tolist()
    assert evaluated < 30 * 3000 / 4
    assert (s == exact[q, x]).all()


# --- lexical search ---


def brute_search(docs, items, k):
    terms = [(d, Counter(lexical_search.terms_of(t))) for d, t in docs]
    n = sum(bool(c) for _, c in terms)
    total = sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    texts = {}
    for i, t in items:
        texts[i] = min(texts.get(i, t or ""), t or "")
    out = []
    for i, t in texts.items():
        found = []
        for d, c in terms:
            m = 100 - 75 + (75 * c.total() * n) // max(total, 1)
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x, times in Counter(lexical_search.terms_of(t)).items() if c[x])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_lexical_search(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "A1", "naïve", "日本"]
    docs = [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(65)], k=r.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(3, docs[3][1]), (None, docs[4][1]), (5000, None), (5001, ""), (5002, "-- !?"), (5003, "w1 " * 20_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 12))) + " w3-W3_w50") for i in range(20)] + [(20, None), (21, "none of these"), (22, docs[3][1]), (0, "a second text"), (23, "")]
    a = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, n int, terms int").repartition(5)
    b = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, rank int")
    want = brute_search(docs, items, 5)
    assert sorted(map(tuple, lexical_search.search(a, b, 5).collect()), key=repr) == want
    monkeypatch.setattr(lexical_search, "SLICE", 40)
    assert sorted(map(tuple, lexical_search.search(a, b, 5, block_bytes=300).collect()), key=repr) == want
    assert lexical_search.search(a.limit(0), b, 5).count() == 0 and lexical_search.search(a, b.limit(0), 5).count() == 0


def test_buckets_and_bounds_leave_documents_unscored():
    r = np.random.default_rng(8)
    n, size = 5000, 300
    lengths = r.integers(1, 40, n)
    often = 1 / np.arange(1, size + 1)
    terms = np.concatenate([np.sort(r.choice(size, k, replace=False, p=often / often.sum())) for k in lengths])
    counts = r.integers(1, 4, len(terms))
    words = np.bincount(np.repeat(np.arange(n), lengths), counts).astype(np.int64)
    weight = lexical_search.weights(np.bincount(terms, minlength=size), n)
    part = lexical_search.Slice(np.arange(n), words, lengths, terms, counts, n, int(words.sum()), weight, 128)
    own, times = np.arange(0, 300, 25), np.ones(12, np.int64)
    m = 25 + (75 * words * n) // words.sum()
    row = np.repeat(np.arange(n), lengths)
    impact = (10**9 * counts) // (1000 * counts + 8 * m[row])
    exact = np.bincount(row, np.isin(terms, own) * impact * weight[terms], n).astype(np.int64)
    places, scores, scored = part.search(own, times, weight, 10, 1)
    best = np.sort(scores)[::-1][:10]
    assert best.tolist() == np.sort(exact)[::-1][:10].tolist()
    assert (exact[part.keys[places]] == scores).all()
    assert scored < n / 2
