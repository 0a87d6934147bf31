"""Words of any length: scaled forward sums beside logarithms, and one strange word in a text."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import language, tokens

PIECES = ["▁", "a", "b", "ab", "ba", "aab", "▁a", "▁ab", "漢"]


@pytest.fixture(scope="module")
def model():
    return language.train([("ab aab ba", "x"), ("b b ba 漢", "y")], PIECES)


def brute(model, word):
    text, p = "▁" + word, {w: model.p[i] for i, w in enumerate(PIECES)}
    logs = [np.zeros(2)]
    for j in range(1, len(text) + 1):
        parts = []
        for i in range(max(0, j - 3), j):
            if text[i:j] in p:
                parts.append(logs[i] + np.log(p[text[i:j]]))
            elif j == i + 1:
                parts.append(logs[i] + np.log(language.UNKNOWN))
        logs.append(np.logaddexp.reduce(parts))
    return logs[-1]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab漢ħก", min_size=1, max_size=200))
def test_any_word(model, word):
    got = model.logs([word, word + "a"])
    assert np.isfinite(got).all()
    assert np.allclose(got[0], brute(model, word), rtol=1e-9)


@pytest.mark.parametrize("letter", ["漢", "ก", "ꠀ", "a", "é"])
def test_every_length_is_finite_and_falls(model, letter):
    logs = model.logs([letter * n for n in range(1, 201)])
    assert np.isfinite(logs).all()
    assert np.allclose(logs, [brute(model, letter * n) for n in range(1, 201)], rtol=1e-9)


def test_a_strange_word_changes_nothing():
    english = "the reader found that there was nothing in the thing which he had thought of before and the house was still"
    german = "der leser fand dass nichts an der sache war woran er vorher gedacht hatte und das haus war noch immer still"
    model = language.train([(english, "en"), (german, "de")] * 3, language.vocabulary(tokens.tokenizer_path(language.PIECES)))
    for letter in "漢한กកአગ":
        texts = [f"{t} {letter * n}" for n in range(1, 201, 3) for t in (english, german)]
        names, scores = model.predict(texts)
        assert names == ["en", "de"] * (len(texts) // 2)
        assert np.isfinite(scores).all() and (scores >= 0).all() and (scores <= 1).all()
        _, alone = model.predict([letter * n for n in range(1, 201)])
        assert np.isfinite(alone).all()
