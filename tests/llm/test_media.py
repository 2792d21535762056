import hashlib
import zlib

from lakewright.llm import media


def test_digests_are_of_the_padded_text(spark):
    texts = ["", None, "a", "x" * 64, "ünï " * 1000, "\0" * 65, "b" * 300000, "x" * 64]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "n", "clash")], "doc_id long, text string, media string")
    made = media.with_media(docs)
    rows = {r.doc_id: r for r in media.digests(made).collect()}
    for i, t in [*enumerate(texts), (None, "n")]:
        raw = (t or "").encode()
        p = raw + b"\0" * (64 * max(1, -(-len(raw) // 64)) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert rows[3][1:] == rows[7][1:] and rows[0][1:] == rows[1][1:]
    pixels = {r.doc_id: r for r in media.with_pixels(made).collect()}
    green = bytes(pixels[6].pixels)[2::4]
    assert green.rstrip(b"\0") == b"b" * 300000 and (pixels[6].width, pixels[6].height) == (64, len(green) // 64)
    assert len(pixels[6].media) < 1000 and rows[6].media_bytes == len(pixels[6].media)
    assert media.digests(media.with_media(docs.limit(0))).count() == 0
