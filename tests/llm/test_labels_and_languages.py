import random

import numpy as np

from earshot.llm import chain, language, samples, toxicity, tokens


def brute_marginals(odds, start, step):
    """All labelings of one short chain."""
    import itertools

    n, total, ones = len(odds), 0.0, np.zeros(len(odds))
    for y in itertools.product((0, 1), repeat=n):
        w = start[y[0]] * np.prod([odds[i] if y[i] else 1 for i in range(n)]) * np.prod([step[y[i - 1], y[i]] for i in range(1, n)])
        total += w
        ones += w * np.array(y)
    return ones / total


def test_marginals_against_all_labelings():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 9, 2, 7, 1, 1, 8]
    odds, first = rng.gamma(1, 2, sum(sizes)), np.zeros(sum(sizes), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    start, step = np.array([1.0, 0.3]), np.array([[1.0, 0.2], [0.7, 3.0]])
    got = chain.marginals(odds, first, start, step)
    at = 0
    for n in sizes:
        assert np.allclose(got[at : at + n], brute_marginals(odds[at : at + n], start, step))
        at += n
    assert len(chain.marginals(np.zeros(0), np.zeros(0, bool), start, step)) == 0


def corpus(n=400):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = k % 4 == 0
        for _ in range(3 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(["grobian", "grobiane", "Grobianix"]))
        rows.append((k, " ".join(t), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = corpus()
    extra = [(9001, None, None), (9002, "", None), (9003, "clean " * 40_000 + "grobian", None), (9003, "clean", None)]
    docs = spark.createDataFrame([(k, t, 0.5, "x") for k, t, _ in rows + extra], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(0, None), (77777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got if r.doc_id < 9000}
    held = [(by[k].predicted, y) for k, _, y in rows if by[k].held_out]
    assert len(held) > 40 and sum(p == y for p, y in held) >= 0.97 * len(held)
    text = {k: t for k, t, _ in rows}
    spans = [text[k][s.start : s.end] for k in by if by[k].predicted for s in by[k].spans]
    assert spans and all("grobian" in s.lower() for s in spans)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.predicted for r in got if r.doc_id in (9001, 9002)} == {0}
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in got if not r.predicted}
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert [r.score for r in toxicity.score(docs.limit(3), None).collect()] == [0.0] * 3
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    model = language.train([("ab ba", "x"), ("bb", "y")], pieces)
    p = {w: model.p[i] for i, w in enumerate(pieces)}

    def total(w):
        if not w:
            return np.ones(2)
        return sum((p[w[:n]] * total(w[n:]) for n in range(1, len(w) + 1) if w[:n] in p), np.zeros(2))

    for w in ("ab", "ba", "abab", "b"):
        assert np.allclose(np.exp(model.logs([w])[0]), total("▁" + w))
    for w in ("ab" * 31, "abba" * 40, "a" * 500, "abc" * 100):  # in exact steps of logarithms
        text = "▁" + w
        for k in range(2):
            logs = [0.0]
            for j in range(1, len(text) + 1):
                x = [logs[i] + np.log(p[text[i:j]][k] if text[i:j] in p else language.UNKNOWN) for i in range(max(0, j - 2), j) if text[i:j] in p or j == i + 1]
                logs.append(np.logaddexp.reduce(x))
            assert np.isclose(model.logs([w])[0][k], logs[-1], rtol=1e-9)


def test_words_are_letters_with_their_marks(spark):
    assert language.WORD.findall("½ ² ① Ⅷ _ 7 a½b") == ["a", "b"]
    assert language.WORD.findall("e\u0301t\u0301a नमस्ते") == ["e\u0301t\u0301a", "नमस्ते"]
    rows = [(k, t, g) for k, (t, g) in enumerate([("the cat", "en"), ("der hund", "de")] * 20)] + [(100, "½ ² ①", None), (101, "\u0301 42", None), (102, "d" * 70 + "er", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, language.fit(docs, language.vocabulary(tokens.tokenizer_path(language.PIECES)))).collect()}
    assert got[100] == got[101] == "und" and got[102] in ("en", "de")


def test_pieces_give_the_values_of_all_texts():
    from earshot.llm import words

    rng = random.Random(4)
    calls = []

    def learn(pieces, one_class):
        calls.extend(pieces)
        found = [[len(p), sum(map(ord, p)) % 1000][: 1 + len(p) % 2] * (9 if p == "nine" else 1) for p in pieces]
        return np.array([x for v in found for x in v], np.uint32), np.array([len(v) for v in found], np.int64)

    table = words.Pieces(np.array([b > 32 for b in range(256)]).astype(np.uint8), lambda a, b: False, learn, 64)
    for _ in range(20):
        texts = ["", "nine " * 3, " ".join("".join(rng.choice("abдé") for _ in range(rng.choice([1, 2, 3, 31, 32, 40]))) for _ in range(rng.randint(0, 60)))]
        values, at = table.values(texts)
        for k, t in enumerate(texts):
            flat, _ = learn(t.split(), None) if t.split() else (np.zeros(0), 0)
            assert values[at[k] : at[k + 1]].tolist() == flat.tolist()
    assert calls


def test_language(spark):
    rng = random.Random(1)
    stems = {"en": ["the", "thing", "there", "ing"], "de": ["der", "schaft", "ung", "über"], "es": ["los", "ción", "que", "ado"]}
    rows = [(k, " ".join(rng.choice(stems[g]) + rng.choice(stems[g]) for _ in range(20)), g) for k, g in enumerate(["en", "de", "es"] * 80)]
    rows += [(1001, None, "en"), (1002, "12 !? \n", "de"), (1003, "the " * 50_000, None), (1004, "x" * 200_000, None), (1004, "der schaft", None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.fit(docs, language.vocabulary(tokens.tokenizer_path(language.PIECES)))
    got = language.predict(docs, model).collect()
    want = {k: g for k, _, g in rows}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert len(held) > 20 and all(r.lang_pred == want[r.doc_id] and r.score > 0.5 for r in held)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1001, 1002)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id == 1003} == {"en"} and len(got) == len(rows)
    assert language.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.filter("lang = 'none'"), ["a"])).collect()} == {"und"}


def test_samples_are_bounded_and_repeat(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    labels = docs.selectExpr("doc_id", "IF(doc_id % 100 = 0, 'rare', 'common') AS label")
    a = samples.labelled_texts(docs, labels, 50, 100)
    assert a == samples.labelled_texts(docs.repartition(7), labels.repartition(3), 50, 100)
    assert sum(y == "common" for _, y in a) == 50 and sum(y == "rare" for _, y in a) == 30
