import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import packing, pfor, token_files, tokens

SCHEMA = "doc_id long, text string, start string, ids binary"
ROWS = [(3, "Hello wörld, it's 42 — ok\n\nnew\tline x é <|endoftext|>z", "a", b""), (1, None, None, None), (2, "", "", b""), (7, "la " * 9000, "b", b""), (5, "abc" * 500, "b", b""), (5, "abc" * 500, "b", b"")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=400), st.integers(0, 3))
def test_pfor_round_trip(ids, kind):
    a = np.array(ids, np.uint64).astype(np.uint32)
    a = (a if kind == 0 else a % np.uint32(50_000) if kind == 1 else np.where(a % 9 == 0, a, a % np.uint32(3)) if kind == 2 else a * 0 + 7).astype(np.uint32)
    blob = pfor.encode(a)
    assert (pfor.decode(blob) == a).all() and len(pfor.decode(blob)) == len(a)
    for b in range(-(-len(a) // pfor.BLOCK)):
        assert (pfor.decode_block(blob, b) == a[b * 128 : b * 128 + 128]).all()


def test_pfor_patches_outliers():
    a = np.arange(1280, dtype=np.uint32) % 8
    a[::100] = 4_000_000_000
    assert len(pfor.encode(a)) < 1280 * 3 / 8 + 10 * 6 + 13 * 5 + 16 + 44 + 1


def direct(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids


def test_piecewise_ids_are_the_tokenizers_own():
    texts = [r[1] for r in ROWS] + ["a\r\nb\x0bc d  ́e", "don't 'S", " \n ", "İstanbul ΟΔΟΣ ß", "x" * 300 + " y", "Thing, thing. THING!! thing's \"Thing\" (a.b) É, É. é?! ² ²,  x_ x__, _, don't, can't. l'été, ... .a", "<|STARTOFTEXT|> <|startoftext|>, a<|endoftext|>."]
    for t, ids in zip(texts, tokens.Encoder(tokens.tokenizer_path()).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == direct(t)


def test_token_files(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [tuple(r) for r in token_files.token_files(df).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    at, want = 0, []
    for r in sorted(ROWS, key=lambda r: r[0]):
        ids = np.array([*direct(r[1]), 2], "<u4")
        want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.token_files(df.limit(0)).count() == 0


def test_packing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = [r.asDict() for r in packing.pack(df).collect()]
    check_packed(rows)
    for r in ROWS[:4]:
        ids = np.array([*direct(r[1]), 1], "<u4")
        own = sorted((x for x in rows if x["doc_id"] == r[0]), key=lambda x: x["start"])
        assert [x["start"] for x in own] == np.cumsum([0, *[x["length"] for x in own]])[:-1].tolist()
        assert sum(x["length"] for x in own) == len(ids) == own[0]["doc_tokens"]
        assert all(x["ids_crc32"] == zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) for x in own)
    assert packing.pack(df.limit(0)).count() == 0


def check_packed(rows, window=2048):
    by = {}
    for x in rows:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    padding = 0
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist()
        size = sum(n for _, n in parts)
        assert size <= window
        padding += 0 if size & (size - 1) == 0 else window - size
    assert padding == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(1 / 500, 60_000), 2048) if seed else np.full(3000, 700)
    counts = {int(k): int((lengths == k).sum()) for k in np.unique(lengths)}
    layout = packing.plan(counts)
    rows = [{"sequence_id": s, "offset": o, "length": n} for k, c in counts.items() for r in range(c) for _, n, s, o in layout.place(k, r)]
    check_packed(rows)
    assert sum(r["length"] for r in rows) == int(lengths.sum())
    if seed:
        assert layout.planned.sum() > 0.5 * len(lengths)
