"""Media columns of lossless WebP images: bytes stored as grey pixels, and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import payloads
from .common import binaries, bound_batches

UNIT = 64
#: Bytes of payload, and payloads, that a task encodes together, and that it decodes.
TO_ENCODE, TO_DECODE, MOST = 2 << 20, 6 << 20, 4000


def padded(text: bytes | None) -> bytes:
    """The text's bytes and zeros up to a positive multiple of UNIT."""
    text = text or b""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def padded_size(n: int) -> int:
    return max(UNIT, n + -n % UNIT)


def _together(rows: Iterator[tuple], size, enough: int) -> Iterator[list[tuple]]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= enough or len(held) >= MOST:
            yield held
            held, total = [], 0
    if held:
        yield held


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media per row of docs (doc_id, text): the padded text as one lossless WebP file.

    Null is as empty: 64 zero bytes. Repeated rows repeat, ids may be null, no rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def each(batches):
        rows = ((i, len(t or b""), padded(t)) for b in batches for i, t in zip(b.column(0).to_pylist(), binaries(b.column(1))))
        for held in _together(rows, lambda r: len(r[2]), TO_ENCODE):
            media = payloads.encode([p for _, _, p in held])
            yield _batch([(i, n, m) for (i, n, _), m in zip(held, media)], schema)

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, n_bytes long, media binary")


def _decoded(batches) -> Iterator[list[tuple]]:
    """(doc_id, n_bytes, media, pixels, payload) of rows (doc_id, n_bytes, media), some together."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for held in _together(rows, lambda r: padded_size(r[1]), TO_DECODE):
        found = payloads.decode([m for _, _, m in held], [padded_size(n) for _, n, _ in held])
        yield [(*row, *own) for row, own in zip(held, found)]


def with_pixels(media: DataFrame) -> DataFrame:
    """media's rows (doc_id, n_bytes, media) with the image's width, height and pixels: four bytes each, alpha, red, green, blue, row by row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])

    def each(batches):
        for held in _decoded(batches):
            yield _batch([(i, n, m, p.shape[1], p.shape[0], p.astype(">u4").tobytes()) for i, n, m, p, _ in held], schema)

    bound_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(each, "doc_id long, n_bytes long, media binary, width int, height int, pixels binary")


def feature(pixels: np.ndarray) -> str:
    """Mean and deviation of the green of an image's pixels, the values it has, and in thousandths how often it rises to the right and downwards."""
    green = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
    n, counts, value = green.size, np.bincount(green.ravel(), minlength=256), np.arange(256)
    total, square = int(counts @ value), int(counts @ (value * value))
    deviation = max(square * n - total * total, 0) ** 0.5 / n
    right, down = (int(np.count_nonzero(a > b)) * 1000 // n for a, b in ((green[:, 1:], green[:, :-1]), (green[1:], green[:-1])))
    return f"{total / n:.3f},{deviation:.3f},{np.count_nonzero(counts)},{right},{down}"


def digests(media: DataFrame) -> DataFrame:
    """What is read back from media (doc_id, n_bytes, media): sizes, digests and the feature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def row(i, n, m, pixels, p):
        return i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)

    def each(batches):
        for held in _decoded(batches):
            yield _batch([row(*r) for r in held], schema)

    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    bound_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(each, out)
