import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import media, webp


def image(width, height, body):
    """A WebP file from a function that writes all bits after the header."""
    w = webp.Writer()
    for x, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(x, n)
    body(w)
    data = b"\x2f" + w.value.to_bytes(-(-w.size // 8), "little")
    data += bytes(len(data) & 1)
    return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


FLAT = [8] * 256


def put_plain(w, pixels, top=True, cache=0, alphabet=280, tail=None):
    """Pixels with 8-bit codes (green has 9 bits: 280 symbols and more), no references."""
    if cache:
        w.put(1, 1)
        w.put(cache, 4)
        alphabet += 1 << cache
    else:
        w.put(0, 1)
    if top:
        w.put(0, 1)
    green = [9] * (2 * alphabet - 512) + [8] * (512 - alphabet) if alphabet <= 512 else None
    assert sum(2.0 ** -n for n in green) == 1
    webp.put_code(w, green)
    for _ in range(3):
        webp.put_code(w, FLAT)
    webp.put_code(w, [5] * 24 + [6] * 16)
    g, gn = webp._codes(green)
    c, _ = webp._codes(FLAT)

    def pixel(p):
        w.put(int(g[p >> 8 & 255]), int(gn[p >> 8 & 255]))
        for x in (p >> 16 & 255, p & 255, p >> 24 & 255):
            w.put(int(c[x]), 8)

    for p in pixels:
        pixel(p)
    if tail:
        tail(w, g, gn)


def pixels_of(seed, n):
    return [int(x) for x in np.random.default_rng(seed).integers(0, 2**32, n)]


def test_plain_image():
    p = pixels_of(1, 35)
    got = webp.decode(image(7, 5, lambda w: (w.put(0, 1), put_plain(w, p))))
    assert got.ravel().tolist() == p and got.shape == (5, 7)


def test_back_reference_and_cache():
    p = pixels_of(2, 6)
    d, dn = webp._codes([5] * 24 + [6] * 16)

    def tail(w, g, gn):
        s = 256 + 4  # lengths 5 and 6, one extra bit
        w.put(int(g[s]), int(gn[s]))
        w.put(1, 1)
        w.put(int(d[0]), int(dn[0]))  # distance code 1: the pixel above
        s = 280 + ((webp.HASH * p[3] & 0xFFFFFFFF) >> 32 - 4)
        w.put(int(g[s]), int(gn[s]))

    got = webp.decode(image(4, 4, lambda w: (w.put(0, 1), put_plain(w, p[:6] + p[:3], cache=4, tail=tail)))).ravel().tolist()
    base = p[:6] + p[:3]
    want = list(base)
    for _ in range(6):
        want.append(want[len(want) - 4])
    recent = {}
    for x in want:
        recent[(webp.HASH * x & 0xFFFFFFFF) >> 28] = x
    want.append(recent[(webp.HASH * p[3] & 0xFFFFFFFF) >> 28])
    assert got == want


def forward_predict(p, width, mode):
    out = []
    for i, x in enumerate(p):
        y, c = divmod(i, width)
        if y == 0:
            g = p[i - 1] if c else 0xFF000000
        elif c == 0:
            g = p[i - width]
        else:
            g = webp.predicted(mode, p[i - 1], p[i - width], p[i - width - 1], p[i - width + 1])
        out.append(webp._pixel([a - b for a, b in zip(webp._bytes(x), webp._bytes(g))]))
    return out


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    p = pixels_of(mode, 30)

    def body(w):
        w.put(1, 1)
        w.put(webp.PREDICTOR, 2)
        w.put(2, 3)  # tiles of 16
        put_plain(w, [mode << 8], top=False)
        w.put(0, 1)
        put_plain(w, forward_predict(p, 6, mode))

    assert webp.decode(image(6, 5, body)).ravel().tolist() == p


def test_cross_colour_and_subtract_green():
    p = pixels_of(5, 12)
    red_blue, green_blue, green_red = 200, 17, 130
    sent = []
    for x in p:
        a, r, g, b = webp._bytes(x)
        r, b = r - g & 255, b - g & 255  # subtract green first, then cross colour
        b2 = b - (webp._signed(green_blue) * webp._signed(g) >> 5) - (webp._signed(red_blue) * webp._signed(r) >> 5)
        sent.append(webp._pixel((a, r - (webp._signed(green_red) * webp._signed(g) >> 5), g, b2)))

    def body(w):
        w.put(1, 1)
        w.put(webp.SUBTRACT_GREEN, 2)
        w.put(1, 1)
        w.put(webp.CROSS_COLOUR, 2)
        w.put(0, 3)
        put_plain(w, [red_blue << 16 | green_blue << 8 | green_red], top=False)
        w.put(0, 1)
        put_plain(w, sent)

    assert webp.decode(image(4, 3, body)).ravel().tolist() == p


@pytest.mark.parametrize("n", [2, 4, 9, 40])
def test_palette(n):
    colours = pixels_of(n, n)
    index = [int(x) for x in np.random.default_rng(n).integers(0, n, 33)]
    shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    packed = []
    for y in range(3):
        row = index[11 * y : 11 * y + 11]
        for i in range(0, 11, 1 << shift):
            packed.append(sum(v << k * (8 >> shift) for k, v in enumerate(row[i : i + (1 << shift)])) << 8)
    deltas = [webp._pixel([a - b for a, b in zip(webp._bytes(x), webp._bytes(y))]) for x, y in zip(colours, [0, *colours])]

    def body(w):
        w.put(1, 1)
        w.put(webp.PALETTE, 2)
        w.put(n - 1, 8)
        put_plain(w, deltas, top=False)
        w.put(0, 1)
        put_plain(w, packed)

    assert webp.decode(image(11, 3, body)).ravel().tolist() == [colours[i] for i in index]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=200), st.tuples(st.integers(0, 255), st.integers(1, 9000)).map(lambda x: bytes([x[0]]) * x[1])), min_size=1, max_size=8))
def test_encode_and_both_decoders(parts):
    payloads = [p + bytes(-len(p) % 64 if p else 64) for p in parts]
    images = webp.encode_many(payloads)
    many = webp.decode_many(images)
    for p, i, m in zip(payloads, images, many, strict=True):
        one = webp.decode(i)
        assert (one == m).all() and ((m >> 8) & 255).astype(np.uint8).tobytes() == p
        g = (m & 255).astype(np.uint32)
        assert (m == (0xFF000000 | g << 16 | g << 8 | g)).all()


def test_bad_images_fail():
    i = webp.encode_many([b"abc" + bytes(61)])[0]
    with pytest.raises(ValueError):
        webp.decode(i[:60])
    with pytest.raises(ValueError):
        webp.decode(b"x" + i[1:])


def test_media_columns(spark):
    rows = [(1, "Hello", "x", b""), (2, None, None, None), (3, "", "", b""), (4, "é" * 30_000 + "\n\x00\x00", "", b""), (5, "Hello", "y", b""), (5, "Hello", "y", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string, media binary")
    got = {r.doc_id: r for r in media.media_columns(df).collect()}
    for k, t, *_ in rows:
        p = media.payload(t)
        assert (got[k].n_bytes, got[k].payload_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[1][2:] == got[5][2:] and got[2][1:] == got[3][1:]
    assert media.media_columns(df.limit(0)).count() == 0


#: Fixed values of the format: the near pixels (columns to the left, rows up) that the first 120 distance codes stand for.
NEAR_PIXELS = """
0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3
2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1
2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7
7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7
"""


def test_near_pixels_are_the_formats():
    want = [tuple(map(int, x.split(","))) for x in NEAR_PIXELS.split()]
    assert len(want) == 120 and webp.NEAR == want


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 9, 16, 17])
def test_palettes_and_codes_of_scripts_come_back(colours):
    rng = np.random.default_rng(colours)
    own = np.sort(rng.choice(256, colours, replace=False)).astype(np.uint8)
    payloads = [own[rng.integers(0, colours, 64 * rows)].tobytes() for rows in (1, 2, 64)]
    payloads += [media.payload(t * 20)[:4096] for t in ("Привет, как дела? ", "日本語の文章です。", "中文文本例子。", "مرحبا كيف حالك ", "γειά σου κόσμε ", "שלום עולם ", "नमस्ते आप कैसे हैं ", "안녕하세요 ", "42 17 0x7f ", "plain words ")]
    images = webp.encode_many(payloads)
    for p, i, pixels in zip(payloads, images, webp.decode_many(images), strict=True):
        assert (pixels == webp.decode(i)).all() and ((pixels >> 8) & 255).astype(np.uint8).tobytes() == p
        assert (pixels >> 24 == 255).all() and ((pixels & 255) == (pixels >> 8 & 255)).all() and ((pixels >> 16 & 255) == (pixels & 255)).all()
    assert all(len(i) < len(p) for p, i in zip(payloads[3:], images[3:], strict=True) if len(p) > 1000)
    assert colours > 4 or len(images[2]) < 0.4 * len(payloads[2]) + 400
    assert images[:2] == webp.encode_many(payloads[:2])  # the bytes depend on the payload alone


def test_a_long_text_is_one_image_that_any_reader_takes():
    rng = np.random.default_rng(8)
    payloads = [media.payload(t) for t in ("aé " * 3_000, "x" * 20_000, "".join(map(chr, rng.integers(32, 400, 9_000))), "ab" * 2_048, "ab" * 2_049, "")]
    stored = webp.encode_many(payloads)
    for p, image, pixels in zip(payloads, stored, webp.decode_many(stored), strict=True):
        assert 8 + int.from_bytes(image[4:8], "little") == len(image)
        assert (len(p) > 4_096) == (webp.MARKS in image) == (image[12:16] == b"VP8X")
        whole = webp.decode(image)  # does not look at the marks
        assert np.array_equal(whole, pixels) and (whole & 255).astype(np.uint8).tobytes() == p
        bare = image[: image.index(webp.MARKS)] if webp.MARKS in image else image
        assert np.array_equal(webp.decode_many([bare])[0], whole)  # marks lost: read in one piece
    for at in (-1, -4):  # marks that cannot be right are left aside
        bad = stored[0][: at] if at == -4 else stored[0][:-4] + b"\xff" * 4
        assert np.array_equal(webp.decode_many([bad])[0], webp.decode(stored[0]))
