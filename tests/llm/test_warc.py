import hashlib
import struct

import zstandard

from lakewright.llm import warc


def test_archives_hold_whole_payloads(spark):
    html = ["<p>same</p>" * 50, "<p>same</p>" * 50, None, "", "ü\r\n\r\nWARC/1.1\r\n" * 9, "<p>x</p>" * 40000, "<p>same</p>" * 50]
    pages = [(i, f"http://x/{i}\r\nX: y", h, 1) for i, h in enumerate(html)] + [(None, None, "null id", 1), (6, "u", html[6], 1)]
    pages += [(100 + i, "http://y", f"<html>page {i % 40} " + "word " * i + "</html>", 1) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    path = warc.write_archives(df)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(pages)
    top = {}
    for i, _, h, _ in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    own = {i: h or "" for i, _, h, _ in pages}
    for r in rows:
        raw = own[r.page_id].encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == warc.base32_digest(raw)
        response = r.page_id is None or r.page_id == top[own[r.page_id]]
        assert r.record_type == ("response" if response else "revisit")
        assert r.refers_to == (None if response else top[own[r.page_id]])
        assert not response or bytes(r.payload) == raw
    assert {r.url for r in rows if r.page_id == 4} == {"http://x/4%0D%0AX: y"}
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), min_revisit_bytes=0)).count() == 0


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    rows = {r.page_id: r.record_type for r in warc.read_archives(spark, warc.write_archives(df, min_revisit_bytes=4)).collect()}
    assert rows == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_records_are_frames_of_their_own_after_the_dictionary():
    records = [warc.record(i, "http://x", f"<html>some page {i} {hashlib.sha1(bytes(i)).hexdigest()}</html>".encode() * 5, None, False) for i in range(400)]
    frames = list(warc.archive_frames(iter(records)))
    magic, n = struct.unpack_from("<II", frames[0])
    assert magic == warc.DICT_MAGIC and n == len(frames[0]) - 8 > 0
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frames[0][8:]))
    assert [d.decompress(f) for f in frames[1:]] == records
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert sum(map(len, frames)) < sum(len(plain.compress(r)) for r in records)
