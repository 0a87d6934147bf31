"""Media columns: texts as lossless WebP images, stored and read back, with simple image features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import webp
from earshot.session import bound_batches, stored

UNIT = webp.WIDTH
PART = webp.MAX_PIXELS  # bytes in one image; longer payloads are several images in a row
ENCODE_BYTES = 1_000_000
DECODE_BYTES = 3_000_000
STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> bytes:
    """The text in UTF-8, then bytes 0 up to a positive multiple of UNIT."""
    body = (text or "").encode("utf-8", "surrogatepass")
    return body + bytes(-len(body) % UNIT if body else UNIT)


def images_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at:end])
        at = end
    return out


def feature(pixels: np.ndarray) -> str:
    """Rows, mean grey, share of dark pixels, and a hash of which of 16 bands of columns by 4 of rows are above the mean."""
    grey = pixels & np.uint32(255)
    mean = float(grey.mean())
    bands = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), np.arange(0, UNIT, 4), axis=1), np.arange(0, max(4, len(grey)), max(1, -(-len(grey) // 4)))[:4] % len(grey), axis=0)
    bits = (bands > np.median(bands)).ravel()
    return f"rows={len(grey)};mean={mean:.3f};dark={float((grey < 33).mean()):.4f};bands={int(''.join('1' if b else '0' for b in bits), 2):x}"


def _slices(batches, size_of, most):
    """The rows of all batches in batches of about `most` bytes, whatever size they come in."""
    parts, held = [], 0
    for batch in batches:
        at = 0
        sizes = size_of(batch)
        for i, n in enumerate(sizes):
            held += n
            if held >= most or i == len(sizes) - 1:
                parts.append(batch.slice(at, i + 1 - at))
                at = i + 1
            if held >= most:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts, held = [], 0
    if parts:
        yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _sizes(column) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media of every row. Null text counts as empty; other columns are ignored."""

    def run(batches):
        for part in _slices(batches, lambda b: _sizes(b.column(1)), ENCODE_BYTES):
            texts = part.column(1).to_pylist()
            whole = [payload(t) for t in texts]
            n_parts = [-(-len(p) // PART) for p in whole]
            images = iter(webp.encode_many([p[i : i + PART] for p in whole for i in range(0, len(p), PART)]))
            media = [b"".join(next(images) for _ in range(n)) for n in n_parts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    bound_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, STORED)


def read_media(media: DataFrame) -> DataFrame:
    """Payload and media digests and features of rows of to_media(), from the decoded pixels."""

    def run(batches):
        for part in _slices(batches, lambda b: _sizes(b.column(2)), DECODE_BYTES):
            ids, sizes, media = (c.to_pylist() for c in part.columns)
            split = [images_of(m) for m in media]
            pixels = iter(webp.decode_many([i for images in split for i in images]))
            rows = []
            for k, n, m, images in zip(ids, sizes, media, split, strict=True):
                whole = np.concatenate([next(pixels) for _ in images])
                body = (whole >> np.uint32(8)).astype(np.uint8).tobytes()
                rows.append((k, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(whole)))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def media_columns(docs: DataFrame) -> DataFrame:
    """Write documents as images to the shared folder and read them back.

    An empty or null text is one row of black pixels. Rows that repeat a key are stored each for itself; an empty
    table gives no rows. Equal texts have equal media and features. A text is one image, whose rows can be read
    in parts; one of over 1,048,512 bytes is stored whole as several images one after another.
    """
    return read_media(stored(to_media(docs), "media"))
