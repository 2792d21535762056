"""Dictionary-compressed WARC archives (.warc.zst).

A Zstandard dictionary is built from records of the archive and embedded in a leading skippable
frame; every record is then a Zstandard frame of its own. Archives are written by Spark's text
writer, so they go to any file system that Spark knows and are committed like any other output:
a frame is a "line", and the line separator is an empty skippable frame, which readers of
Zstandard skip.

Of records with equal payloads the one with the largest page_id is a response and the others are
revisit records that refer to it and carry the HTTP headers only.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, bound_batches, new_path, parts_for

#: Frames of Zstandard that a reader skips: one that holds the dictionary, and empty ones after each record.
DICT_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
#: Payload bytes of records that the dictionary is trained on, its size, and payload bytes of an archive.
TRAIN_BYTES = 1 << 20
DICT_BYTES = 1 << 15
ARCHIVE_BYTES = 32 << 20
LEVEL = 3
#: Revisit rows are spread over so many keys for each payload.
SALTS = 32
DATE = "2000-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PLAN = "page_id long, url string, html string, digest string, refers_to long, is_revisit boolean"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, archive string, payload binary"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _header(fields: list[tuple[str, object]]) -> bytes:
    # A line break in a value would end the field.
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None)


def _one_line(value: str | None) -> str | None:
    return None if value is None else value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record of the page."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http if revisit else http + payload
    head = _header([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_digest(payload)}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ])
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


#: Long records are trained on in pieces of so many bytes, all of them.
PIECE = 1 << 17


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the records; where they are too few or too alike to train on, their last bytes themselves."""
    samples = [r[i : i + PIECE] for r in records for i in range(0, len(r), PIECE)]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-DICT_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The dictionary's frame, then a frame for each record. Holds TRAIN_BYTES of records at most."""
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= TRAIN_BYTES:
            break
    if not held:
        return
    trained = train(held)
    raw = trained.as_bytes()
    yield struct.pack("<II", DICT_MAGIC, len(raw)) + raw
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    for r in held:
        yield compressor.compress(r)
    for r in records:
        yield compressor.compress(r)


def read_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    if not archive:
        return
    magic, n = struct.unpack_from("<II", archive)
    if magic != DICT_MAGIC:
        raise ValueError("an archive begins with its dictionary's frame")
    raw = archive[8 : 8 + n]
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    stream = io.BufferedReader(decompressor.stream_reader(io.BytesIO(memoryview(archive)[8 + n :]), read_across_frames=True), 1 << 16)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            headers[k] = v
        yield headers, stream.read(int(headers["Content-Length"]))
        stream.read(4)


def planned(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """PLAN for every row of pages (page_id, url, html): the payload's digest, and whether the row
    is a revisit and of which page. Only ids and digests are grouped, and rows of one payload are
    spread over SALTS keys by id and address to meet their target, so that a payload of a third of all
    rows is no task of its own, also where ids are null. A task's rows are an archive of about
    ARCHIVE_BYTES: other payloads are spread by their digests, and revisits hold none."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    targets = rows.filter(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(F.count("*").alias("rows"), F.max("page_id").alias("target"))
    targets = targets.filter((F.col("rows") > 1) & F.col("target").isNotNull()).select("digest", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = parts_for(total, ARCHIVE_BYTES, 1)
    revisit = F.coalesce(F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target")), F.lit(False))
    joined = salted.repartition(max(n, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "digest", "salt").join(targets.hint("shuffle_merge"), ["digest", "salt"], "left")
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("target")).alias("refers_to"), revisit.alias("is_revisit"))


def write_archives(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> str:
    """Writes the rows of pages (page_id, url, html) as archives into a new folder and returns its path.

    A null html is an empty payload; texts are whole. Repeated rows are records of their own: among
    equal payloads, all rows with the largest page_id are responses. A null page_id is never
    referred to. No rows give no archive.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    path = path or new_path(spark, "warc")

    def frames(batches):
        def records():
            for b in batches:
                for page_id, url, html, to, revisit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), binaries(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                    yield record(page_id, url, html or b"", to, revisit)

        held, size = [], 0
        for f in archive_frames(records()):
            held.append(f)
            size += len(f)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    plan = planned(pages, min_revisit_bytes).select("page_id", "url", F.col("html").cast("string"), "refers_to", "is_revisit")
    out = plan.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.option("lineSep", SEPARATOR.decode("latin-1")).text(path)
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """READ: a row per record of the archives in a folder. payload is null for revisits; payload_bytes
    and payload_digest are of the full payload, and a response's are computed from what was read."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("archive", pa.string()), ("payload", pa.binary())])
    bound_batches(spark)
    page = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None

    def parse(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for h, block in read_records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if h["WARC-Type"] == "revisit":
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((page(h["WARC-Record-ID"]), length, h["WARC-Payload-Digest"][5:], "revisit", page(h["WARC-Refers-To"]), h.get("WARC-Target-URI"), name, None))
                    else:
                        rows.append((page(h["WARC-Record-ID"]), len(payload), base32_digest(payload), "response", None, h.get("WARC-Target-URI"), name, payload))
                    size += len(block)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, READ)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, upper(sha1(encode(coalesce(html, '')))) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""
