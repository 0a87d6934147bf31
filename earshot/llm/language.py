"""Language of a text by unigram piece models, summed over all segmentations.

The pieces come from a fixed public vocabulary. Expectation-maximisation on a bounded sample of labelled
documents (PER_LANGUAGE of each, texts up to MAX_CHARS, words up to MAX_LETTERS) gives each language its piece
probabilities. A word's probability is the sum over all its segmentations into pieces (forward algorithm), however
long the word is; a text's is the product over its words; the language of the largest one is predicted.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import samples, tokens, words
from earshot.session import bound_batches

PIECES = "piece_bpe_32k.model"
PER_LANGUAGE = 400
MAX_CHARS = 20_000
MAX_LETTERS = 64
ROUNDS = 4
UNKNOWN = 1e-7  # probability of a letter outside the vocabulary
SLOTS = 1 << 18
SURE_AFTER = 20  # words that count in full towards the score
SCALED, BLOCK = 8, 1 << 15  # letters after which forward sums are scaled, and of which tables are made at once for long words
BASE = 0x9E3779B97F4A7C15
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Bytes of words: ASCII letters, and all of other scripts, which WORD cuts further.
WORD_BYTES = np.array([chr(b).isalpha() or b >= 128 for b in range(256)]).astype(np.uint8)
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def vocabulary(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({p for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and (p := model.id_to_piece(i))})


def codes(some: list[str]) -> np.ndarray:
    """Words of one length as a (words, length) array of code points."""
    return np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), -1).astype(np.uint64)


def prefix_hashes(c: np.ndarray) -> np.ndarray:
    h = np.zeros((c.shape[0], c.shape[1] + 1), np.uint64)
    for i in range(c.shape[1]):
        h[:, i + 1] = h[:, i] * np.uint64(BASE) + c[:, i] + np.uint64(1)
    return h


@dataclass
class Pieces:
    """Vocabulary lookup by rolling hash."""

    hashes: np.ndarray
    ids: np.ndarray
    size: int
    powers: list  # of the base, up to the longest piece

    @staticmethod
    def of(pieces: list[str]) -> Pieces:
        by = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append((p, i))
        h = np.concatenate([prefix_hashes(codes([p for p, _ in x]))[:, -1] for x in by.values()])
        i = np.concatenate([[i for _, i in x] for x in by.values()])
        order = np.argsort(h)
        return Pieces(h[order], i[order], len(pieces), [np.uint64(pow(BASE, n, 1 << 64)) for n in range(max(by) + 1)])

    def spans(self, some: list[str]):
        """(start, end, piece id of each word's span or `size`) for words of one length, by end."""
        h = prefix_hashes(codes(some))
        for j in range(1, h.shape[1]):
            for i in range(max(0, j - len(self.powers) + 1), j):
                yield i, j, self.find(h[:, j] - h[:, i] * self.powers[j - i])

    def find(self, x: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, `size` where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        return np.where(self.hashes[at] == x, self.ids[at], self.size)


def by_length(some: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(some):
        out.setdefault(len(w), []).append(k)
    return out


def chances(p: np.ndarray, i: int, j: int, piece: np.ndarray) -> np.ndarray:
    """(words, languages) probabilities of the pieces of spans i to j; a letter that is no piece has UNKNOWN."""
    x = p[piece]
    return np.where((piece == len(p) - 1)[:, None], UNKNOWN, x) if j == i + 1 else x


def forward(spans, p: np.ndarray, rows: int, n: int) -> np.ndarray:
    """(n + 1, rows, languages): the summed probability of all segmentations of each prefix."""
    f = np.zeros((n + 1, rows, p.shape[1]))
    f[0] = 1
    for i, j, piece in spans:
        f[j] += f[i] * chances(p, i, j, piece)
    return f


def log_forward(spans, p: np.ndarray, rows: int, n: int, window: int) -> np.ndarray:
    """(rows, languages) logs of the summed probability of all segmentations of whole words, without underflow.

    Sums are divided by the newest one every SCALED letters; only those of the last `window` letters, the longest piece, are needed again.
    """
    f, logs = np.zeros((n + 1, rows, p.shape[1])), np.zeros((rows, p.shape[1]))
    f[0], done = 1, 0
    for i, j, piece in spans:
        if j > done + 1:
            done = j - 1
            if done % SCALED == 0:
                scale = f[done].copy()
                f[max(0, done - window) : done + 1] /= scale
                logs += np.log(scale)
        f[j] += f[i] * chances(p, i, j, piece)
    return logs + np.log(f[n])


def long_forward(pieces: Pieces, p: np.ndarray, word: str) -> np.ndarray:
    """(languages,) log probabilities, summed over all segmentations of a word of any length.

    Letter by letter over a window of the longest piece, in blocks of BLOCK letters; sums are scaled every SCALED letters.
    """
    k, q = len(pieces.powers) - 1, np.vstack([p, np.full((1, p.shape[1]), UNKNOWN)])
    f, logs = np.zeros((k + BLOCK, p.shape[1])), np.zeros(p.shape[1])
    f[k - 1] = 1
    h = [0]
    for at in range(0, len(word), BLOCK):
        own = word[at : at + BLOCK]
        for c in codes([own])[0].tolist():
            h.append((h[-1] * BASE + c + 1) & 0xFFFFFFFFFFFFFFFF)
        own_h = np.array(h, np.uint64)
        before = len(h) - len(own) - 1  # letters of earlier blocks that are still needed
        ids = np.full((len(own), k), pieces.size)
        for n in range(1, k + 1):
            start = max(0, n - before - 1)  # the first letter of the block at which n letters end
            if start < len(own):
                ends = np.arange(start, len(own)) + before + 1
                ids[start:, n - 1] = pieces.find(own_h[ends] - own_h[ends - n] * pieces.powers[n])
        ids[:, 0][ids[:, 0] == pieces.size] = pieces.size + 1
        for t in range(len(own)):
            f[k + t] = (f[t : k + t][::-1] * q[ids[t]]).sum(axis=0)
            if t % SCALED == 0:
                scale = f[k + t].copy()
                f[t + 1 : k + t + 1] /= scale
                logs += np.log(scale)
        f[:k] = f[len(own) : k + len(own)].copy()
        h = h[-k - 1 :]
    return logs + np.log(f[k - 1])


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    p: np.ndarray  # (pieces + 1, languages), the last row 0
    known: words.Pieces | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def logs(self, some: list[str]) -> np.ndarray:
        """(words, languages) log probabilities."""
        some = ["▁" + w for w in some]
        out = np.zeros((len(some), len(self.languages)))
        for n, at in by_length(some).items():
            if n > MAX_LETTERS:
                for i in at:
                    out[i] = long_forward(self.pieces, self.p, some[i])
                continue
            for k in range(0, len(at), 4096):
                own = [some[i] for i in at[k : k + 4096]]
                out[at[k : k + 4096]] = log_forward(self.pieces.spans(own), self.p, len(own), n, len(self.pieces.powers) - 1)
        return out

    def _learn(self, pieces: list[str], one_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [WORD.findall(p.lower()) for p in pieces]
        logs = self.logs([w for ws in found for w in ws]).astype(np.float32)
        return logs.reshape(-1).view(np.uint32), np.array([len(ws) for ws in found], np.int64) * len(self.languages)

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) summed log probabilities, and word counts."""
        if self.known is None:
            self.known = words.Pieces(WORD_BYTES, lambda a, b: False, self._learn, SLOTS, len(self.languages))
        logs, at = self.known.values([t or "" for t in texts])
        logs, at = logs.view(np.float32).astype(float).reshape(-1, len(self.languages)), at // len(self.languages)
        sizes, out = np.diff(at), np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(logs, at[some], axis=0)
        return out, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, n = self.totals(texts)
        if not len(texts):
            return [], np.zeros(0)
        x = total * (np.minimum(n, SURE_AFTER) / np.maximum(n, 1))[:, None]
        x = np.exp(x - x.max(axis=1, keepdims=True))
        best = total.argmax(axis=1)
        score = x[np.arange(len(x)), best] / x.sum(axis=1)
        return ["und" if not k else self.languages[b] for k, b in zip(n.tolist(), best.tolist(), strict=True)], np.where(n > 0, score, 0.0)


def train(rows: list[tuple[str, str]], pieces: list[str], rounds: int = ROUNDS) -> Model | None:
    """A model from (text, language) rows by expectation-maximisation; None without rows."""
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    counts = [Counter() for _ in languages]
    for t, y in rows:
        counts[languages.index(y)].update("▁" + w for w in WORD.findall((t or "").lower()) if len(w) < MAX_LETTERS)
    found = sorted(set().union(*counts))
    weight = np.array([[c[w] for c in counts] for w in found], float).reshape(len(found), len(languages))
    table = Pieces.of(pieces)
    p = np.vstack([np.full((table.size, len(languages)), 1 / table.size), np.zeros((1, len(languages)))])
    groups = [([found[i] for i in at], weight[at], n) for n, all_at in by_length(found).items() for k in range(0, len(all_at), 8192) for at in [all_at[k : k + 8192]]]
    for _ in range(rounds):
        expected = np.full((table.size + 1, len(languages)), 0.02)
        for own, w, n in groups:
            spans = list(table.spans(own))
            f = forward(spans, p, len(own), n)
            b = np.zeros_like(f)
            b[n] = 1
            for i, j, piece in reversed(spans):
                x = chances(p, i, j, piece)
                share = f[i] * x * b[j] * w / (f[n] + 1e-300)
                for k in range(len(languages)):
                    expected[:, k] += np.bincount(piece, share[:, k], table.size + 1)
                b[i] += x * b[j]
        p = np.vstack([expected[:-1] / expected[:-1].sum(axis=0), np.zeros((1, len(languages)))])
    return Model(languages, table, p)


def fit(docs: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> Model | None:
    """Train on rows outside the held-out fold whose language is not null. Of rows that repeat a key, the smallest language counts."""
    labels = docs.filter(F.col(lang).isNotNull() & ~samples.held_out(key)).groupBy(key).agg(F.min(lang).alias("label"))
    return train(samples.labelled_texts(docs, labels, per_language, max_chars, key, text), pieces)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; `und` with score 0 for null texts, texts without a letter, or without a model.

    Rows that repeat a key are judged each for itself; other columns are ignored; an empty table gives no rows. Words and texts may be
    of any length: sums are scaled, so scores are finite.
    """

    bound_batches(docs.sparkSession)

    def run(batches):
        for part, texts in words.text_batches(batches, text_at=2):
            languages, s = model.predict(texts) if model else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(languages, pa.string()), pa.array(s, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long"), samples.held_out(key), F.col(text)).mapInArrow(run, PREDICTED)


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Train on docs and predict all of them. path: the vocabulary's file."""
    if path is None:
        path = tokens.tokenizer_path(PIECES)
    return predict(docs, fit(docs, vocabulary(path)))
