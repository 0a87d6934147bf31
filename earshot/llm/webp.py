"""Lossless WebP images: a decoder of all the format's means, and an encoder for byte payloads.

decode() reads prefix codes (simple, normal, and one group per tile), back-references, the colour cache, and
inverts predictor, cross-colour, subtract-green and palette transforms. decode_many() gives the same pixels for
many images at once: images with one group of codes, no colour cache and only green symbols of non-zero length
are read symbol by symbol in lockstep with numpy, others by decode(). encode_many() stores bytes as grey pixels: green
holds the byte, subtract-green makes red and blue constant, runs of a byte become back-references, few colours a palette.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Fixed values of the format.
LENGTH_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
HASH = 0x1E35A7BD
WIDTH = 64
MIN_RUN = 16
MAX_RUN = 4096
MAX_PIXELS = 16383 * WIDTH
PART = 64  # rows that are read by themselves
MARKS = b"ROWS"  # own chunk after the image's: where in it each further PART of rows begins, in bits
#: Near pixels, nearest first: the meaning of the first 120 distance codes.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Least-significant-bit-first reader."""

    def __init__(self, data: bytes):
        self.value, self.at, self.size = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.data = data

    def read(self, n: int) -> int:
        first = self.at >> 3
        x = int.from_bytes(self.data[first : first + (n + 14 >> 3) + 1], "little") >> (self.at & 7)
        self.at += n
        if self.at > self.size:
            raise ValueError("image data ends early")
        return x & ((1 << n) - 1)


def canonical(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code with the first bit highest) -> symbol."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {(0, 0): used[0]}
    code, last, out = 0, 0, {}
    for n, s in sorted((lengths[s], s) for s in used):
        code <<= n - last
        out[n, code] = s
        code, last = code + 1, n
    if code != 1 << last:
        raise ValueError("a prefix code is not full")
    return out


def symbol(bits: Bits, code: dict) -> int:
    n = x = 0
    while (n, x) not in code:
        x, n = x << 1 | bits.read(1), n + 1
        if n > 15:
            raise ValueError("no such prefix code")
    return code[n, x]


def read_code(bits: Bits, alphabet: int) -> dict:
    if bits.read(1):
        n = bits.read(1) + 1
        own = [bits.read(8 if bits.read(1) else 1)]
        if n == 2:
            own.append(bits.read(8))
        lengths = [0] * max(alphabet, max(own) + 1)
        for s in own:
            lengths[s] = 1
        return canonical(lengths)
    of_lengths = [0] * 19
    for i in range(4 + bits.read(4)):
        of_lengths[LENGTH_CODE_ORDER[i]] = bits.read(3)
    code = canonical(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, previous = [], 8
    while len(lengths) < alphabet and left:
        left -= 1
        s = symbol(bits, code)
        if s < 16:
            lengths.append(s)
            previous = s or previous
        else:
            value, extra, base = {16: (previous, 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}[s]
            lengths += [value] * (base + bits.read(extra))
    if len(lengths) > alphabet:
        raise ValueError("too many code lengths")
    return canonical(lengths + [0] * (alphabet - len(lengths)))


def extended(bits: Bits, s: int) -> int:
    """The value of a length or distance symbol and its extra bits."""
    if s < 4:
        return s + 1
    n = s - 2 >> 1
    return (2 + (s & 1) << n) + bits.read(n) + 1


def read_groups(bits: Bits, n: int, cache: int) -> list[list[dict]]:
    return [[read_code(bits, a) for a in (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)] for _ in range(n)]


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, top: bool) -> list[int]:
    """Pixels as 0xAARRGGBB, before transforms are inverted."""
    cache = bits.read(4) if bits.read(1) else 0
    shift, tiles, across = 0, None, 0
    if top and bits.read(1):
        shift = bits.read(3) + 2
        across = width + (1 << shift) - 1 >> shift
        tiles = [p >> 8 & 0xFFFF for p in read_image(bits, across, height + (1 << shift) - 1 >> shift, False)]
    groups = read_groups(bits, max(tiles) + 1 if tiles else 1, cache)
    recent, out, total = [0] * (1 << cache), [], width * height
    while len(out) < total:
        y, x = divmod(len(out), width)
        group = groups[tiles[(y >> shift) * across + (x >> shift)]] if tiles else groups[0]
        s = symbol(bits, group[0])
        if s < 256:
            new = [symbol(bits, group[1]) << 16 | s << 8 | symbol(bits, group[2]) | symbol(bits, group[3]) << 24]
        elif s < 280:
            n = extended(bits, s - 256)
            back = distance_of(extended(bits, symbol(bits, group[4])), width)
            if back > len(out) or len(out) + n > total:
                raise ValueError("a back-reference leaves the image")
            new = [out[len(out) - back + k % back] for k in range(n)]
        else:
            new = [recent[s - 280]]
        out += new
        if cache:
            for p in new:
                recent[(HASH * p & 0xFFFFFFFF) >> 32 - cache] = p
    return out


def _bytes(p: int) -> tuple[int, int, int, int]:
    return p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255


def _pixel(c) -> int:
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def _average(a: int, b: int) -> int:
    return _pixel([x + y >> 1 for x, y in zip(_bytes(a), _bytes(b), strict=True)])


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def predicted(mode: int, left: int, above: int, above_left: int, above_right: int) -> int:
    """The format's predictors 0 to 13."""
    if mode == 11:
        l, t, tl = _bytes(left), _bytes(above), _bytes(above_left)
        to_left = sum(abs(b - c) for b, c in zip(t, tl, strict=True))
        to_above = sum(abs(a - c) for a, c in zip(l, tl, strict=True))
        return left if to_left < to_above else above
    if mode == 12:
        return _pixel([min(255, max(0, a + b - c)) for a, b, c in zip(_bytes(left), _bytes(above), _bytes(above_left), strict=True)])
    if mode == 13:
        m = _bytes(_average(left, above))
        return _pixel([min(255, max(0, a + int((a - c) / 2))) for a, c in zip(m, _bytes(above_left), strict=True)])
    choices = {
        1: lambda: left, 2: lambda: above, 3: lambda: above_right, 4: lambda: above_left,
        5: lambda: _average(_average(left, above_right), above), 6: lambda: _average(left, above_left), 7: lambda: _average(left, above),
        8: lambda: _average(above_left, above), 9: lambda: _average(above, above_right), 10: lambda: _average(_average(left, above_left), _average(above, above_right)),
    }
    return choices.get(mode, lambda: 0xFF000000)()


def invert(kind: int, data: tuple, out: list[int], width: int, height: int) -> list[int]:
    if kind == SUBTRACT_GREEN:
        return [_pixel((a, r + g, g, b + g)) for a, r, g, b in map(_bytes, out)]
    if kind == PALETTE:
        colours, shift = data
        mask, packed, new = (8 >> shift) and (1 << (8 >> shift)) - 1, width + (1 << shift) - 1 >> shift, []
        for y in range(height):
            for x in range(width):
                i = out[y * packed + (x >> shift)] >> 8 & 255
                i = i >> (x & (1 << shift) - 1) * (8 >> shift) & mask
                new.append(colours[i] if i < len(colours) else 0)
        return new
    tiles, shift = data
    across = width + (1 << shift) - 1 >> shift
    if kind == CROSS_COLOUR:
        new = []
        for i, p in enumerate(out):
            y, x = divmod(i, width)
            _, red_blue, green_blue, green_red = _bytes(tiles[(y >> shift) * across + (x >> shift)])
            a, r, g, b = _bytes(p)
            r = r + (_signed(green_red) * _signed(g) >> 5) & 255
            b = b + (_signed(green_blue) * _signed(g) >> 5) + (_signed(red_blue) * _signed(r) >> 5)
            new.append(_pixel((a, r, g, b)))
        return new
    new = []
    for i, p in enumerate(out):
        y, x = divmod(i, width)
        if y == 0:
            guess = new[i - 1] if x else 0xFF000000
        elif x == 0:
            guess = new[i - width]
        else:
            guess = predicted(tiles[(y >> shift) * across + (x >> shift)] >> 8 & 15, new[i - 1], new[i - width], new[i - width - 1], new[i - width + 1])
        new.append(_pixel([a + b for a, b in zip(_bytes(p), _bytes(guess), strict=True)]))
    return new


def _chunks(image: bytes) -> dict[bytes, bytes]:
    if image[:4] != b"RIFF" or image[8:12] != b"WEBP":
        raise ValueError("not a lossless WebP image")
    out, at = {}, 12
    while at + 8 <= len(image):
        end = at + 8 + int.from_bytes(image[at + 4 : at + 8], "little")
        out.setdefault(image[at : at + 4], image[at + 8 : end])
        at = end + (end & 1)
    return out


def _header(chunks: dict[bytes, bytes]) -> tuple[Bits, int, int]:
    data = chunks.get(b"VP8L", b"")
    if data[:1] != b"\x2f":
        raise ValueError("not a lossless WebP image")
    bits = Bits(data[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return bits, width, height


def _transforms(bits: Bits, width: int, height: int) -> tuple[list, int]:
    found = []
    while bits.read(1):
        kind, data = bits.read(2), ()
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            data = (read_image(bits, width + (1 << shift) - 1 >> shift, height + (1 << shift) - 1 >> shift, False), shift)
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = read_image(bits, n, 1, False)
            for i in range(1, n):
                colours[i] = _pixel([a + b for a, b in zip(_bytes(colours[i]), _bytes(colours[i - 1]), strict=True)])
            data = (colours, _pixel_shift(n))
        found.append((kind, data, width))
        if kind == PALETTE:
            width = width + (1 << data[1]) - 1 >> data[1]
    return found, width


def decode(image: bytes) -> np.ndarray:
    """(height, width) uint32 pixels, 0xAARRGGBB."""
    bits, width, height = _header(_chunks(image))
    found, inner = _transforms(bits, width, height)
    out = read_image(bits, inner, height, True)
    for kind, data, own in reversed(found):
        out = invert(kind, data, out, own, height)
    return np.array(out, np.uint32).reshape(height, width)


# --- encoder -----------------------------------------------------------------------------------------------


def _shares(signs: dict[int, float], continued: float = 0.0, ascii_too: float = 0.0) -> np.ndarray:
    """Expected shares of the green symbols: of some bytes, of UTF-8's 64 continuation bytes and of printable ASCII; all others are rare."""
    share = np.full(280, 0.00002)
    share[0x80:0xC0] += continued / 64
    share[32:127] += ascii_too / 95
    share[256:280] = 0.0002
    for sign, x in signs.items():
        share[sign] += x
    return share


def _spread(signs, first: float, last: float) -> dict[int, float]:
    return dict(zip(signs, np.linspace(first, last, len(signs)).tolist(), strict=True))


_GAPS = {32: 0.09, 10: 0.004, 44: 0.004, 46: 0.004}
#: Rules of thumb for UTF-8 text: Latin, Cyrillic, Greek, Arabic, Hebrew, Indic, kana, Han, Hangul; plain ASCII; any bytes.
SHARES = [
    _shares({32: 0.16, 10: 0.004, 0: 0.0006, 0xC3: 0.006, **_spread(b"etaoinshrdlu", 0.09, 0.03), **_spread(b"cmwfgypbvkjxqz", 0.025, 0.003), **_spread(b".,!'-;:?", 0.004, 0.004), **_spread(range(65, 91), 0.001, 0.001), **_spread(range(48, 58), 0.0006, 0.0006)}, 0.02),
    _shares({**_GAPS, 0xD0: 0.27, 0xD1: 0.19, **_spread(range(0xB0, 0xC0), 0.02, 0.02), **_spread(range(0x80, 0x90), 0.01, 0.01)}, 0.06, 0.02),
    _shares({**_GAPS, 0xCE: 0.28, 0xCF: 0.18, **_spread(range(0xB0, 0xC0), 0.02, 0.02), **_spread(range(0x80, 0x90), 0.01, 0.01)}, 0.06, 0.02),
    _shares({**_GAPS, 0xD8: 0.2, 0xD9: 0.22, 0xDA: 0.02, 0xDB: 0.02, 0xA7: 0.06, 0x84: 0.05}, 0.35, 0.02),
    _shares({**_GAPS, 0xD7: 0.45, **_spread(range(0x90, 0xAB), 0.016, 0.016)}, 0.03, 0.02),
    _shares({**_GAPS, 0xE0: 0.3, 0xA4: 0.17, 0xA5: 0.1, 0xB8: 0.03, 0xB9: 0.02}, 0.3, 0.02),
    _shares({0xE3: 0.3, 0x81: 0.17, 0x82: 0.1, 0x83: 0.06, **_spread(range(0xE4, 0xEA), 0.01, 0.01)}, 0.3, 0.02),
    _shares({**_spread(range(0xE4, 0xEA), 0.055, 0.045), 0xE3: 0.02, 0xEF: 0.015, 0xBC: 0.01, 0x80: 0.01}, 0.6, 0.02),
    _shares({**_GAPS, **_spread(range(0xEA, 0xEE), 0.08, 0.06)}, 0.55, 0.02),
    _shares({32: 0.02, 10: 0.01}, 0.0, 0.96),
    np.full(280, 1 / 280),
]


def code_lengths(share: np.ndarray, longest: int = 15) -> list[int]:
    """Huffman code lengths, flattened until none is over `longest`."""
    import heapq

    while True:
        heap = [(float(s), i, (i,)) for i, s in enumerate(share)]
        heapq.heapify(heap)
        lengths = [0] * len(share)
        while len(heap) > 1:
            (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            for k in (*x, *y):
                lengths[k] += 1
            heapq.heappush(heap, (a + b, i, x + y))
        if max(lengths) <= longest:
            return lengths
        share = share + share.max() / 1000


class Writer:
    def __init__(self):
        self.value = self.size = 0

    def put(self, x: int, n: int) -> None:
        self.value |= x << self.size
        self.size += n


def _reversed(x: int, n: int) -> int:
    return int(f"{x:0{n}b}"[::-1], 2) if n else 0


def _codes(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bits as they are sent, first bit lowest; lengths) of each symbol."""
    sent = np.zeros(len(lengths), np.uint64)
    for (n, x), s in canonical(lengths).items():
        sent[s] = _reversed(x, n)
    return sent, np.array(lengths, np.int64)


def _one(w: Writer, s: int) -> None:
    """A simple code of one symbol."""
    w.put(1, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(s, 8)


def put_code(w: Writer, lengths: list[int]) -> None:
    """A normal code: all code lengths sent with fixed-length codes of 4 bits, without repeats."""
    w.put(0, 1)
    w.put(15, 4)
    for s in LENGTH_CODE_ORDER:
        w.put(4 if s < 16 else 0, 3)
    w.put(0, 1)
    for n in lengths:
        w.put(_reversed(n, 4), 4)


GREEN_LENGTHS = [code_lengths(x) for x in SHARES]
GREEN, GREEN_N = map(np.array, zip(*map(_codes, GREEN_LENGTHS), strict=True))  # (codes, symbols)


def _codes_bits(lengths: list[int]) -> tuple[int, int]:
    """What follows the transforms in an image of the encoder, up to its pixels."""
    w = Writer()
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group of codes
    put_code(w, lengths)
    _one(w, 0)
    _one(w, 0)
    _one(w, 255)
    _one(w, 1)  # distance code 2: the pixel before
    return w.value, w.size


CODES = [_codes_bits(x) for x in GREEN_LENGTHS]
CODES_SIZE = CODES[0][1]


def _transform_bits(colours: list[int] | None = None) -> tuple[int, int]:
    """What follows the image size, up to the codes: subtract-green, then a palette of the greens in ascending order if there is one."""
    w = Writer()
    w.put(0, 1)  # alpha is not used
    w.put(0, 3)
    w.put(1, 1)
    w.put(SUBTRACT_GREEN, 2)
    if colours:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(colours) - 1, 8)
        w.put(0, 1)  # no colour cache
        steps = [b - a for a, b in zip([0, *colours], colours, strict=False)]
        used = sorted(set(steps))
        used += [s for s in range(256) if s not in used][: (1 << max(1, (len(used) - 1).bit_length())) - len(used)] if len(used) > 1 else []
        bits = (len(used) - 1).bit_length()
        place = {s: _reversed(i, bits) for i, s in enumerate(sorted(used))}
        if bits == 0:
            _one(w, used[0])
        else:  # all of them have codes of equal length; the code of lengths has two symbols, 0 and that length
            w.put(0, 1)
            w.put(15, 4)
            for s in LENGTH_CODE_ORDER:
                w.put(1 if s in (0, bits) else 0, 3)
            w.put(0, 1)
            for s in range(280):
                w.put(1 if s in place else 0, 1)
        _one(w, 0)
        _one(w, 0)
        w.put(1, 1)  # alpha steps: 255 once, then 0
        w.put(1 if len(colours) > 1 else 0, 1)
        w.put(1, 1)
        w.put(0 if len(colours) > 1 else 255, 8)
        if len(colours) > 1:
            w.put(255, 8)
        _one(w, 0)
        for i, s in enumerate(steps):
            w.put(place[s], bits)
            if len(colours) > 1:
                w.put(1 if i == 0 else 0, 1)
    w.put(0, 1)  # no more transforms
    return w.value, w.size


PLAIN = _transform_bits()


def _length_symbol(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, how many) of back-reference lengths."""
    d = n - 1
    small = d < 4
    k = np.maximum(np.frexp(np.maximum(d, 1).astype(float))[1] - 2, 0)
    return np.where(small, d, 2 * k + 2 + (d >> np.maximum(k, 0) & 1)), np.where(small, 0, d - ((2 + (d >> k & 1)) << k)), np.where(small, 0, k)


def _runs(data: np.ndarray, breaks: np.ndarray):
    """(literal places, run places, run lengths): runs of MIN_RUN or more equal bytes after a first one, none across a break."""
    n = len(data)
    new = np.ones(n, bool)
    new[1:] = data[1:] != data[:-1]
    new[breaks] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n)) - 1
    keep = size >= MIN_RUN
    if not keep.any():
        return np.arange(n), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, length = start[keep] + 1, size[keep]
    literal = np.ones(n, bool)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, place, 1)
    np.add.at(mark, place + length, -1)
    literal[np.cumsum(mark[:-1]) > 0] = False
    parts = -(-length // MAX_RUN)
    at = np.repeat(place, parts) + MAX_RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return np.flatnonzero(literal), at, np.minimum(MAX_RUN, np.repeat(place + length, parts) - at)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """One image for each payload: rows of WIDTH grey pixels, sizes a positive multiple of WIDTH and at most MAX_PIXELS.

    Each image has the one of the fixed codes that makes it shortest; with 16 colours or fewer it has a palette if that is shorter.
    The bytes depend on the payload alone.
    """
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads])
    if (sizes % WIDTH).any() or not sizes.all() or sizes.max() > MAX_PIXELS:
        raise ValueError("payload size")
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64)
    out = _encoded(data, sizes, sizes // WIDTH, [PLAIN] * len(sizes))
    begin = np.cumsum(sizes) - sizes
    there = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 256 + data, minlength=256 * len(sizes)).reshape(-1, 256) > 0
    few = np.flatnonzero(there.sum(axis=1) <= 16)
    if len(few):
        packed, heads = [], []
        for k in few.tolist():
            colours = np.flatnonzero(there[k])
            shift = _pixel_shift(len(colours))
            index = np.searchsorted(colours, data[begin[k] : begin[k] + sizes[k]]).reshape(-1, 1 << shift)
            packed.append((index << (8 >> shift) * np.arange(1 << shift)).sum(axis=1))
            heads.append(_transform_bits(colours.tolist()))
        small = _encoded(np.concatenate(packed), np.array([len(p) for p in packed]), sizes[few] // WIDTH, heads)
        for k, image in zip(few.tolist(), small, strict=True):
            out[k] = min(out[k], image, key=len)
    return out


def _pixel_shift(colours: int) -> int:
    """log2 of the pixels in one, for so many colours."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _encoded(data: np.ndarray, sizes: np.ndarray, heights: np.ndarray, heads: list[tuple[int, int]]) -> list[bytes]:
    """Images of WIDTH pixels a row, given their green values (packed or not) one after another and what goes before their codes."""
    begin = np.cumsum(sizes) - sizes
    # no run crosses the beginning of a part, so that parts can be read side by side
    parts = -(-heights // PART)
    of = np.repeat(np.arange(len(sizes)), parts)
    part = begin[of] + (np.arange(len(of)) - (np.cumsum(parts) - parts)[of]) * (PART * sizes // heights)[of]
    literal, run, length = _runs(data, part)
    s, extra, n_extra = _length_symbol(length)
    place = np.concatenate([literal, run])
    sign = np.concatenate([data[literal], 256 + s])
    owner = np.searchsorted(begin, place, "right") - 1
    used = np.bincount(owner * 280 + sign, minlength=280 * len(sizes)).reshape(-1, 280)
    best = (used @ GREEN_N.T).argmin(axis=1)[owner]
    width = GREEN_N[best, sign]
    value = GREEN[best, sign]
    value[len(literal) :] |= extra.astype(np.uint64) << width[len(literal) :].astype(np.uint64)
    width[len(literal) :] += n_extra
    order = np.argsort(place, kind="stable") if len(run) else slice(None)
    place, value, width, owner, best = place[order], value[order], width[order], owner[order], best[order]
    ends = np.cumsum(width)
    first = np.searchsorted(place, begin)
    own_bits = np.diff(np.append(ends - width, ends[-1])[np.append(first, len(place))])
    before = np.array([28 + n for _, n in heads]) + CODES_SIZE  # bits of each image up to its pixels
    whole = (before + own_bits + 7) // 8 + 8  # room for a 64-bit store at the end
    base = np.cumsum(whole) - whole
    at = base[owner] * 8 + before[owner] + (ends - width) - (ends - width)[first][owner]
    words = np.zeros(int(whole.sum()) // 8 + 2, np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = value << shift
    spill = np.flatnonzero((at & 63) + width > 64)
    # symbols do not overlap, so sums of their bits are their union; split so that float weights stay exact
    for half in range(4):
        some = (low >> np.uint64(16 * half)) & np.uint64(0xFFFF)
        words[: len(words)] |= np.bincount(word, some.astype(float), len(words)).astype(np.uint64) << np.uint64(16 * half)
    if len(spill):
        words |= np.bincount(word[spill] + 1, (value[spill] >> (np.uint64(64) - shift[spill])).astype(float), len(words)).astype(np.uint64)
    stream = words.view(np.uint8)
    marks = (before[of] + (ends - width)[np.searchsorted(place, part)] - (ends - width)[first][of]).astype("<u4")
    last = np.cumsum(parts)
    out = []
    for k, (head, n_head) in enumerate(heads):
        n = (int(before[k]) + int(own_bits[k]) + 7) // 8
        start = (WIDTH - 1) | (int(heights[k]) - 1) << 14 | head << 28 | CODES[best[first[k]]][0] << 28 + n_head
        body = bytearray(stream[base[k] : base[k] + n].tobytes())
        m = (int(before[k]) + 7) // 8
        body[:m] = (int.from_bytes(body[:m], "little") | start).to_bytes(m, "little")
        chunk = b"\x2f" + bytes(body)
        chunks = [(b"VP8L", chunk)]
        if parts[k] > 1:
            size = (WIDTH - 1).to_bytes(3, "little") + (int(heights[k]) - 1).to_bytes(3, "little")
            chunks = [(b"VP8X", bytes(4) + size), *chunks, (MARKS, marks[last[k] - parts[k] + 1 : last[k]].tobytes())]
        whole = b"WEBP" + b"".join(name + len(c).to_bytes(4, "little") + c + bytes(len(c) & 1) for name, c in chunks)
        out.append(b"RIFF" + len(whole).to_bytes(4, "little") + whole)
    return out


# --- many images at once -----------------------------------------------------------------------------------


class Shared:
    """A group of codes that many images may share, with a lookup table for 15 bits of the green one."""

    def __init__(self, group: list[dict]):
        green, others = group[0], group[1:]
        self.fixed = [next(iter(c.values())) for c in others]
        self.symbol, self.length = np.zeros(1 << 15, np.int16), np.zeros(1 << 15, np.int16)
        for (n, x), s in green.items():
            self.symbol[_reversed(x, n) :: 1 << n], self.length[_reversed(x, n) :: 1 << n] = s, n


@dataclass
class Parsed:
    """An image up to its pixels: where they begin (in bits after the signature), its transforms and its sizes."""

    shared: Shared
    at: int
    found: list
    width: int  # of the image
    inner: int  # of what is stored
    height: int
    data: bytes  # after the signature


def _parts(x: Parsed, marks: bytes) -> list[Parsed]:
    """The image as parts of PART rows, where its marks tell their beginnings; else whole."""
    at = [x.at, *np.frombuffer(marks[: len(marks) // 4 * 4], "<u4").tolist()]
    if len(at) != -(-x.height // PART) or any(a >= b for a, b in zip(at, [*at[1:], 8 * len(x.data) + 1], strict=True)):
        return [x]
    ends = [*((b + 7) // 8 for b in at[1:]), len(x.data)]
    return [Parsed(x.shared, a & 7, x.found, x.width, x.inner, min(PART, x.height - PART * i), x.data[a >> 3 : end]) for i, (a, end) in enumerate(zip(at, ends, strict=True))]


def _parsed(chunks: dict[bytes, bytes], known: dict) -> Parsed | None:
    """The image's header for lockstep reading, or None when it needs decode(). known: codes met before, by their bits."""
    bits, width, height = _header(chunks)
    found, inner = _transforms(bits, width, height)
    if any(kind not in (SUBTRACT_GREEN, PALETTE) for kind, _, _ in found):
        return None
    start = bits.at
    for size, codes in known.items():
        first = start >> 3
        own = int.from_bytes(bits.data[first : first + (size + 14 >> 3)], "little") >> (start & 7) & (1 << size) - 1
        if own in codes:
            return Parsed(codes[own], start + size, found, width, inner, height, bits.data)
    if bits.read(1) or bits.read(1):
        return None
    group = read_groups(bits, 1, 0)[0]
    if (0, 0) in group[0] or any((0, 0) not in c for c in group[1:]):
        return None
    size, first = bits.at - start, start >> 3
    own = int.from_bytes(bits.data[first : first + (size + 14 >> 3)], "little") >> (start & 7) & (1 << size) - 1
    known.setdefault(size, {})[own] = Shared(group)
    return Parsed(known[size][own], bits.at, found, width, inner, height, bits.data)


def decode_many(images: list[bytes], lanes: int = 4096) -> list[np.ndarray]:
    """decode() of each image."""
    out: list = [None] * len(images)
    known: dict = {}
    groups: dict[int, list] = {}
    for k, image in enumerate(images):
        chunks = _chunks(image)
        parsed = _parsed(chunks, known)
        if parsed is None:
            out[k] = decode(image)
            continue
        parts = _parts(parsed, chunks.get(MARKS, b""))
        out[k] = [None] * len(parts)
        for i, x in enumerate(parts):
            groups.setdefault(id(x.shared), []).append((len(x.data), k, i, x))
    for own in groups.values():
        own.sort(key=lambda x: x[:3])
        for at in range(0, len(own), lanes):
            some = own[at : at + lanes]
            for (_, k, i, _), pixels in zip(some, _lockstep([x for _, _, _, x in some]), strict=True):
                out[k][i] = pixels
    out = [np.concatenate(x) if isinstance(x, list) else x for x in out]
    return out


def _lockstep(headers: list[Parsed]) -> list[np.ndarray]:
    """Pixels of images that share their codes, read symbol by symbol side by side."""
    shared = headers[0].shared
    totals = np.array([x.inner * x.height for x in headers], np.int64)
    starts = np.cumsum([0, *(len(x.data) for x in headers)])
    data = np.frombuffer(b"".join(x.data for x in headers) + bytes(8), np.uint8)
    wide = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    at = starts[:-1] * 8 + np.array([x.at for x in headers], np.int64)
    place = np.cumsum(totals) - totals
    end = place + totals
    green = np.zeros(int(totals.sum()), np.uint8)
    width = np.array([x.inner for x in headers], np.int64)
    code = shared.fixed[3]
    lane = np.arange(len(headers))
    copies = []
    while len(lane):
        window = np.ascontiguousarray(wide[at >> 3]).view("<u8")[:, 0] >> (at & 7).astype(np.uint64)
        s = shared.symbol[window & np.uint64(0x7FFF)]
        n = shared.length[window & np.uint64(0x7FFF)]
        at += n
        step = 1
        if s.max() >= 256:
            if s.max() >= 280:
                raise ValueError("no such symbol")
            back = np.flatnonzero(s >= 256)
            x = s[back].astype(np.int64) - 256
            k = np.where(x < 4, 0, x - 2 >> 1)
            extra = (window[back] >> n[back].astype(np.uint64)).astype(np.int64) & (1 << k) - 1
            length = np.where(x < 4, x, (2 + (x & 1) << k) + extra) + 1
            at[back] += k
            if code < 4:
                far = np.full(len(back), code + 1)
            else:
                e = code - 2 >> 1
                bits = np.ascontiguousarray(wide[at[back] >> 3]).view("<u8")[:, 0] >> (at[back] & 7).astype(np.uint64)
                far = (2 + (code & 1) << e) + (bits.astype(np.int64) & (1 << e) - 1) + 1
                at[back] += e
            copies += [(p, m, distance_of(d, w)) for p, m, d, w in zip(place[back].tolist(), length.tolist(), far.tolist(), width[lane[back]].tolist(), strict=True)]
            step = np.ones(len(lane), np.int64)
            step[back] = length
            s = np.where(s < 256, s, 0)
        green[place] = s
        place += step
        more = place < end
        if not more.all():
            if (place > end).any():
                raise ValueError("a back-reference leaves the image")
            lane, at, place, end = lane[more], at[more], place[more], end[more]
    first = np.cumsum(totals) - totals
    for p, m, d in sorted(copies):
        if p - d < first[np.searchsorted(first, p, "right") - 1]:
            raise ValueError("a back-reference leaves the image")
        green[p : p + m] = green[p - d] if d == 1 else green[p - d + np.arange(m) % d]
    red, blue, alpha = shared.fixed[:3]
    out = []
    for k, x in enumerate(headers):
        g = green[first[k] : first[k] + totals[k]].astype(np.uint32).reshape(x.height, x.inner)
        pixels = np.uint32(alpha << 24 | red << 16 | blue) | g << np.uint32(8)
        for kind, data, own in reversed(x.found):
            if kind == PALETTE:
                colours, shift = data
                place = np.arange(own)
                index = (pixels >> np.uint32(8) & np.uint32(255))[:, place >> shift] >> ((place & (1 << shift) - 1) * (8 >> shift)).astype(np.uint32) & np.uint32((1 << (8 >> shift)) - 1)
                pixels = np.append(np.array(colours, np.uint32), np.zeros(256 - len(colours), np.uint32))[index]
            else:
                g = pixels >> np.uint32(8) & np.uint32(255)
                r, b = (pixels >> np.uint32(16)) + g & np.uint32(255), pixels + g & np.uint32(255)
                pixels = pixels & np.uint32(0xFF00FF00) | r << np.uint32(16) | b
        out.append(pixels)
    return out
