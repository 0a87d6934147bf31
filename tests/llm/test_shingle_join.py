import itertools
import random
import re

import numpy as np
import pytest

from earshot.llm import shingle_join, trie


def brute(rows, n, num, den):
    """Components by comparing all pairs of shingle sets of strings."""
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(k, []).append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    flat = [(k, s) for k, ss in sets.items() for s in ss if s]
    for (a, x), (b, y) in itertools.combinations(flat, 2):
        if den * len(x & y) >= num * len(x | y):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {k: root(k) for k in sets}


def corpus(seed, docs=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "and", "of"] * 40
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, k = [], 0
    while k < docs:
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.3:
            words += passage
        for _ in range(rng.choice([1, 1, 1, 2, 9])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                own = own[: max(1, len(own) - rng.randint(0, 8))]
            rows.append((k, rng.choice([" ", "\n", "\t "]).join(own).replace("w1", "W1")))
            k += 1
    return rows


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("similar", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_trie_components(seed, similar):
    n, num, den = similar
    rows = corpus(seed)
    levels = (np.arange(2 * shingle_join.CELLS) % 7).astype(np.uint8)
    sets = shingle_join.shingle_sets(levels, [t for _, t in rows], n)
    seen, keys = {}, []
    for (k, _), s in zip(rows, sets, strict=True):
        if s.tobytes() not in seen:
            seen[s.tobytes()] = k
    for k in seen.values():
        keys.append(k)
    own = trie.components([sets[k] for k in keys], num, den)
    least = {}
    for k, r in zip(keys, own, strict=True):
        least[r] = min(least.get(r, k), k)
    by_set = {sets[k].tobytes(): least[r] for k, r in zip(keys, own, strict=True)}
    want = brute(rows, n, num, den)
    assert {k: by_set[s.tobytes()] for (k, _), s in zip(rows, sets, strict=True)} == want


def test_word_hashes_do_not_depend_on_the_batch(monkeypatch):
    texts = ["The cat\tsat", None, "", "  the CAT ", "é É cat", "sat the"]
    h, n = shingle_join.word_hashes(texts)
    assert n.tolist() == [3, 0, 0, 2, 3, 2]
    assert h[0] == h[3] == h[9] and h[1] == h[4] == h[7] and h[2] == h[8] and h[5] != h[6]
    monkeypatch.setattr(shingle_join, "SEGMENT", 3)
    assert (shingle_join.word_hashes(texts)[0] == h).all()


def test_trie_labels_start_together():
    a, b, c = (np.array(x, np.uint64) for x in ([1, 2, 3], [7, 8, 9], [7, 8, 9, 10]))
    assert len(set(trie.components([a, b, c], 1, 2, [5, 5, 6]))) == 1


@pytest.mark.parametrize("chunk", [2_000_000, 700])
def test_jaccard_groups(spark, chunk):
    rows = [(int(k), t) for k, t in corpus(11, 150)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One  two"), (905, "two one"), (906, rows[3][1]), (906, rows[40][1]), (907, "x " * 3000)]
    df = spark.createDataFrame([(k, t, 0, b"", 1) for k, t in rows] + [(None, rows[5][1], 0, b"", 1)], "doc_id long, text string, rep int, key binary, component_id int")
    got = shingle_join.jaccard_groups(df, 3, 90, 100, chunk=chunk).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows, 3, 90, 100)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    size = {r.doc_id: r.n_shingles for r in got}
    assert (size[900], size[901], size[902], size[903], size[907]) == (0, 0, 0, 1, 1)
    assert shingle_join.jaccard_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("similar", [(90, 100), (80, 100), (30, 100)])
@pytest.mark.parametrize("most", [1 << 17, 128])
def test_sketches_lose_no_link(monkeypatch, similar, most):
    monkeypatch.setattr(shingle_join, "MOST_BITS", most)
    num, den = similar
    rng = np.random.default_rng(most)
    sets = []
    for size in rng.integers(1, 700, 60):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        for gone in (0, 0.03, 0.06, 0.12, 0.3):
            sets.append(np.unique(np.concatenate([base[rng.random(size) >= gone], rng.integers(0, 1 << 63, int(size * gone / 3), np.uint64)])))
    sets = sorted((x for x in sets if len(x)), key=len)
    sizes, sketches = np.array([len(x) for x in sets]), [shingle_join.sketch(x) for x in sets]
    label = shingle_join.near_sets(sizes, sketches, num, den)
    sides = np.arange(len(sets)) % 2
    across = shingle_join.near_sets(sizes, sketches, num, den, sides)
    for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
        if den * len(np.intersect1d(x, y)) >= num * len(np.union1d(x, y)):
            assert label[i] == label[j]
            assert sides[i] == sides[j] or across[i] == across[j]
    assert most < 1 << 17 or num < 80 or len(set(label.tolist())) >= 55


@pytest.fixture(scope="module")
def sharing(spark):
    """(representatives, their number of groups): documents of own words about a shared passage, one of three near copies."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for k in range(40):
        own = [f"d{k}x{i}" for i in range(rng.randint(60, 80))]
        texts.append(" ".join(own[:30] + passage + own[30:]))
        if k % 2:
            texts += [texts[-1] + " more", "less " + texts[-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels = np.zeros(2 * shingle_join.CELLS, np.uint8)
    signed = shingle_join._signatures(df, levels, 5, 80, 100)
    return signed.selectExpr("doc_id AS rep", "n_shingles AS size", "prefix", "sketch"), 40


@pytest.mark.parametrize("tile", [8_192, 7])
def test_a_shared_passage_joins_no_blocks(sharing, tile):
    from earshot.operators.components import connected_components

    reps, groups = sharing
    shared = [r.reps for r in shingle_join._meetings(reps, 80, 100).collect()]
    assert max(map(len, shared)) > 20  # the passage's elements are in prefixes
    found = connected_components(shingle_join._candidates(reps, 80, 100, tile=tile))
    blocks = {}
    for r in found.collect():
        blocks.setdefault(r.component, []).append(r.node)
    assert len(blocks) == groups // 2 and all(sorted(b) == list(range(min(b), min(b) + 3)) for b in blocks.values())
