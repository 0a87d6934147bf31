"""Whole-text token ids from the tokenizers library, looked up by pieces of bytes.

A tokenizer that drops white space and folds ASCII case (such as word_bpe_49k) gives a text the ids of its pieces in
turn: a piece ends at white space and where ASCII letters, digits and marks meet. Each worker keeps the ids of pieces
it has met in a table (words.Pieces). New words of small letters are encoded together in one joined string; the
model's end-of-word tokens part the ids again, and their number is compared with the number of words. Everything else
goes to the tokenizer piece by piece, and a text that holds a special token goes to it whole. An encoder first
compares its own ids of TRIAL with the tokenizer's and leaves all this aside if they differ.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from earshot.llm import words
from earshot.llm.words import ragged

WORD_BPE = "word_bpe_49k.json"
SLOTS = 1 << 19
JOINED = 2_000
MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_{}~"  # marks that no special token or contraction has
TRIAL = ["Az bC, d.e!? 12a b34 it's (x_y) don't. Ça да, ДА é≠ 2⃣ «q» – a\tb\r\nc\x0bd '' 'S. x' 's, ½ 1½ İstanbul ΟΔΟΣ", "", " \n "]
_LETTER, _MARK, _DIGIT, _OTHER = range(1, 5)
_encoders: dict = {}


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[list(b" \n")] = 0
    out[list(range(65, 91)) + list(range(97, 123))] = _LETTER
    out[list(range(48, 58))] = _DIGIT
    out[list(MARKS)] = _MARK
    return out


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_ends(tokenizer) -> np.ndarray | None:
    """For each id, does it end a word? None if the tokenizer's model marks no ends of words."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return out


class Encoder:
    def __init__(self, path: str, piecewise: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.pieces = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = word_ends(self.tokenizer)
        if piecewise and self.ends is not None:
            # the same model for words in their normal form, without the normaliser and the pattern that cuts words
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.pieces = words.Pieces(_classes(), lambda a, b: a != b and _OTHER not in (a, b), self._learn, SLOTS)
            if self._by_pieces(TRIAL) != self._whole(TRIAL):
                self.pieces = None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters in their normal form, and how many of each; one by one if the ends of words do not show where to cut."""
        x = np.array(self.plain.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends[x])
        if len(ends) == len(some):
            return x, np.diff(ends, prepend=-1)
        each = [np.frombuffer(b, "<u4") for b in self._whole(some)]
        return np.concatenate(each), np.array([len(e) for e in each])

    def _learn(self, pieces: list[str], one_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain, rest = [], []
        for k, (piece, letters) in enumerate(zip(pieces, (one_class == _LETTER).tolist(), strict=True)):
            normal = letters or piece.isalpha() and piece.lower() == piece and unicodedata.is_normalized("NFC", piece)
            (plain if normal else rest).append(k)
        parts = [self._joined([pieces[k] for k in plain[at : at + JOINED]]) for at in range(0, len(plain), JOINED)]
        others = [np.frombuffer(b, "<u4") for b in self._whole([pieces[k] for k in rest])]
        flat = np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in parts), *others])
        sizes = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts), np.array([len(x) for x in others], np.int64)])
        order = np.argsort(np.array(plain + rest, np.int64), kind="stable")
        starts = np.cumsum(sizes) - sizes
        return flat[ragged(starts[order], sizes[order])], sizes[order]

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        ids, at = self.pieces.values(texts)
        ids, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; None counts as empty."""
        texts = [t or "" for t in texts]
        if self.pieces is None:
            return self._whole(texts)
        special = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        whole = self._whole([texts[k] for k in special])
        for k in special:
            texts[k] = ""
        out = self._by_pieces(texts)
        for k, ids in zip(special, whole, strict=True):
            out[k] = ids
        return out


def encoder(path: str, piecewise: bool = True) -> Encoder:
    """This worker's encoder for the path."""
    if (path, piecewise) not in _encoders:
        _encoders[path, piecewise] = Encoder(path, piecewise)
    return _encoders[path, piecewise]
