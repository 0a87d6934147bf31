"""Toxic spans and document scores from a linear-chain conditional random field.

Training takes a bounded sample of labelled documents (PER_LABEL for each label, texts up to MAX_CHARS). A
token of a toxic document is labelled toxic when one of its spelling features is far commoner in toxic
documents than in others (see weak_labels); of copies in the sample one votes. The field has two states, hashed spelling features and learned
transitions. Scoring runs forward-backward over whole texts of any length inside Arrow batches; a document's
score is a logistic function of its largest and its mean token marginal.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import chain, samples, words
from earshot.session import bound_batches

PER_LABEL = 1000
MAX_CHARS = 20_000
BUCKETS = 1 << 18
ROUNDS = 40
SLOTS = 1 << 18
WORD = re.compile(r"\w+")
#: Bytes of tokens: ASCII letters, digits and underscores, and all of other scripts, which WORD cuts further.
WORD_BYTES = np.array([chr(b).isalnum() or b == 95 or b >= 128 for b in range(256)]).astype(np.uint8)
SCORED = "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"


def spellings(token: str) -> list[str]:
    """The features of a token: itself, its first four to nine letters and its last three."""
    w = token.lower()
    return [f"w{w}", *(f"{n}{w[:n]}" for n in range(4, 10) if len(w) > n), f"s{w[-3:]}"]


def codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit codes of the spellings of all tokens in turn, how many of each token)."""
    found = [[zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in spellings(t)] for t in tokens]
    return np.array([c for x in found for c in x], np.uint32), np.array([len(x) for x in found], np.int64)


def one_of_copies(documents: list[np.ndarray], hashes: int = 4, n: int = 3) -> np.ndarray:
    """Places of documents (word numbers) that share no minimum hash of their n-word shingles with one before: copies must not vote again."""
    seen, keep = set(), []
    rng = np.random.default_rng(11)
    a = rng.integers(1, 1 << 62, hashes).astype(np.uint64) | np.uint64(1)
    for i, ids in enumerate(documents):
        size = max(1, len(ids) - n + 1)
        x = np.zeros(size, np.uint64)
        for k in range(min(n, len(ids))):
            x = (x ^ (ids[k : k + size].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        least = {(k, int((x * m).min())) for k, m in enumerate(a)}
        if seen.isdisjoint(least):
            keep.append(i)
        seen |= least
    return np.array(keep, np.int64)


def weak_labels(documents: list[np.ndarray], toxic: np.ndarray, code: np.ndarray, sizes: np.ndarray, odds: float = 3.0) -> np.ndarray:
    """For each word: is it to be labelled toxic in toxic documents, as the log odds of one of its spellings (but the last) are over `odds`?"""
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    use = np.ones(len(code), bool)
    use[starts + sizes - 1] = False
    distinct, code = np.unique(code, return_inverse=True)
    found = np.zeros((2, len(distinct)), np.int64)
    for ids, t in zip(documents, toxic.tolist(), strict=True):
        some = np.unique(ids)
        at = words.ragged(starts[some], sizes[some])
        found[int(t), np.unique(code[at[use[at]]])] += 1
    yes, no = int(toxic.sum()), int((~toxic).sum())
    marked = (found[1] >= min(8, max(2, 0.05 * yes))) & (np.log((found[1] + 0.5) / (yes + 1)) - np.log((found[0] + 0.5) / (no + 1)) >= odds)
    return np.bincount(owner, marked[code] & use, len(sizes)) > 0


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    start: np.ndarray
    step: np.ndarray
    document: np.ndarray  # of (1, logit of the largest marginal, log of the mean one)
    pieces: words.Pieces | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"pieces": None}

    def odds(self, tokens: list[str]) -> np.ndarray:
        """exp(score of toxic - score of not) of tokens, by themselves."""
        code, sizes = codes(tokens)
        flat = self.weights[code % BUCKETS].astype(float)
        sums = np.add.reduceat(flat, np.cumsum(sizes) - sizes) if len(flat) else flat
        return np.exp(np.clip(sums + self.bias, -30, 30)).astype(np.float32)

    def _learn(self, pieces: list[str], one_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [WORD.findall(p) for p in pieces]
        return self.odds([t for ts in found for t in ts]).view(np.uint32), np.array([len(ts) for ts in found], np.int64)

    def tag(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Token marginals of each text, and the texts' scores."""
        if not len(texts):
            return [], np.zeros(0)
        if self.pieces is None:
            self.pieces = words.Pieces(WORD_BYTES, lambda a, b: False, self._learn, SLOTS)
        odds, at = self.pieces.values([t or "" for t in texts])
        first = np.zeros(len(odds), bool)
        first[at[:-1][at[1:] > at[:-1]]] = True
        p = np.split(chain.marginals(odds.view(np.float32).astype(float), first, self.start, self.step), at[1:-1])
        return p, 1 / (1 + np.exp(-features(p) @ self.document))


def features(p: list[np.ndarray]) -> np.ndarray:
    top = np.clip([x.max() if len(x) else 0 for x in p], 1e-9, 1 - 1e-9)
    mean = np.array([x.sum() / (len(x) + 20) for x in p]) + 1e-9
    return np.stack([np.ones(len(p)), np.log(top / (1 - top)), np.log(mean)], axis=1)


def train(rows: list[tuple[str, int]], rounds: int = ROUNDS) -> Model | None:
    """A model from (text, label) rows; None if they do not have both labels."""
    toxic = np.array([bool(y) for _, y in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    vocabulary: dict[str, int] = {}
    documents = [np.array([vocabulary.setdefault(w.lower(), len(vocabulary)) for w in WORD.findall(t or "")], np.int64) for t, _ in rows]
    keep = one_of_copies(documents)
    rows, documents, toxic = [rows[i] for i in keep], [documents[i] for i in keep], toxic[keep]
    if not toxic.any() or toxic.all():
        return None
    code, n_code = codes(list(vocabulary))
    per_word = len(vocabulary)
    del vocabulary
    ids, sizes = np.concatenate(documents), np.array([len(x) for x in documents])
    y = weak_labels(documents, toxic, code, n_code)[ids] & np.repeat(toxic, sizes)
    first = np.zeros(len(ids), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    owner, feature = np.repeat(np.arange(per_word), n_code), (code % BUCKETS).astype(np.int64)
    theta, grads = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    small, small_grads = np.array([-4.0, 0.0, 0.0, 0.0, 0.0]), np.full(5, 1e-2)  # bias, start of 1, steps 01, 10, 11
    inner = np.flatnonzero(~first[1:]) + 1
    seen = np.array([(y[first]).sum(), (~y[inner - 1] & y[inner]).sum(), (y[inner - 1] & ~y[inner]).sum(), (y[inner - 1] & y[inner]).sum()], float)
    for _ in range(rounds):
        word = np.bincount(owner, theta[feature], per_word) + small[0]
        step = np.exp(np.array([[0, small[2]], [small[3], small[4]]]))
        p, pairs, starts = chain.marginals(np.exp(np.clip(word[ids], -30, 30)), first, np.exp([0, small[1]]), step, pairs=True)
        by_word = np.bincount(ids, y - p, per_word)
        g = np.bincount(feature, by_word[owner], BUCKETS) - 0.02 * theta
        grads += g * g
        theta += 0.7 * g / np.sqrt(grads)
        g = np.array([by_word.sum(), *(seen - [starts[1], pairs[0, 1], pairs[1, 0], pairs[1, 1]])]) - 0.02 * small
        small_grads += g * g
        small = np.clip(small + 0.3 * g / np.sqrt(small_grads), -12, 12)
    model = Model(theta.astype(np.float32), float(small[0]), np.exp([0, small[1]]), np.exp(np.array([[0, small[2]], [small[3], small[4]]])), np.zeros(3))
    x = np.concatenate([features(model.tag([t for t, _ in rows[at : at + 100]])[0]) for at in range(0, len(rows), 100)])
    for _ in range(25):  # Newton steps of a ridge logistic fit
        q = 1 / (1 + np.exp(-x @ model.document))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        model.document = model.document + np.clip(np.linalg.solve(h, x.T @ (toxic - q) - 0.1 * model.document), -2, 2)
    model.pieces = None
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Model | None:
    """Train on labelled rows outside the held-out fold. Of labels that repeat a key the largest counts; null labels are left out."""
    rows = labels.select(F.col(key), F.col(label).cast("int").alias("label")).dropna().filter(~samples.held_out(key)).groupBy(key).agg(F.max("label").alias("label"))
    return train(samples.labelled_texts(docs, rows, per_label, max_chars, key, text))


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens of marginal 0.5 or more: character offsets, and their largest marginal."""
    out, last = [], None
    for i, m in enumerate(WORD.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1]["end"], out[-1]["score"] = m.end(), max(out[-1]["score"], float(p[i]))
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(p[i])})
            last = i
    return out


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and toxic spans of every row.

    Null and empty texts have no token and score low. Without a model (no labels of both kinds) every score is 0.
    Rows that repeat a key are scored each for itself; other columns are ignored; an empty table gives no rows. Texts are scored
    whole, in time and memory in proportion to their length.
    """

    bound_batches(docs.sparkSession)

    def run(batches):
        for part, texts in words.text_batches(batches, text_at=2):
            p, s = model.tag(texts) if model else ([np.zeros(0)] * len(texts), np.zeros(len(texts)))
            spans = [spans_of(t, x) if len(x) and x.max() >= 0.5 else [] for t, x in zip(texts, p, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                names=["doc_id", "held_out", "score", "predicted", "spans"],
            )

    return docs.select(F.col(key).cast("long"), samples.held_out(key), F.col(text)).mapInArrow(run, SCORED)


def keep_clean(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns; null and empty texts stay.

    Rows that repeat a key are judged each for itself; an empty table gives no rows. Without a model all rows stay.
    """
    if model is None:
        return docs
    bound_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0, bool), *(model.tag(some)[1] < 0.5 for _, _, some in words.slices(texts, words.SMALL_SLICE))]))

    return docs.filter(clean(F.col(text)))
