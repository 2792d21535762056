import base64
import itertools
import random
import struct

import numpy as np
import pytest

from lakewright.llm import payloads, webp


def picture(h, w, colours=None, seed=0):
    rng = np.random.default_rng(seed)
    if colours:
        table = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
        return table[rng.integers(0, colours, (h, w))]
    base = rng.integers(0, 1 << 32, (h, w), dtype=np.uint32)
    base[h // 2 :] = base[: h - h // 2]
    return base


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (2, 0), (1, 0), (0, 1, 2)])
@pytest.mark.parametrize("cache_bits,references,meta_bits", [(0, False, 0), (4, False, 0), (0, True, 0), (5, True, 2)])
def test_round_trip(transforms, cache_bits, references, meta_bits):
    for h, w in ((1, 1), (13, 9), (8, 21)):
        p = picture(h, w)
        assert (webp.decode(webp.encode(p, transforms, cache_bits, references, meta_bits)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palettes(colours):
    p = picture(17, 23, colours)
    for extra, cache in itertools.product(((), (0,)), (0, 3)):
        assert (webp.decode(webp.encode(p, (3, *extra), cache, True)) == p).all()


def test_each_predictor():
    p = picture(9, 11, seed=3)
    for mode in range(14):
        assert (webp.decode(webp.encode(p, (0,), modes=[mode])) == p).all()


def test_neighbours_of_the_format():
    assert webp.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert len(webp.NEAR) == 120 and webp.NEAR[-1] == (8, 7)


def payloads_of(n, values, seed=1):
    rng = random.Random(seed)
    return bytes(rng.choices(range(values), k=n))


def test_payloads():
    words = [w.encode() for w in ("some", "words", "that", "come", "again", "and", "once")]
    rng = random.Random(3)
    text = lambda n: b" ".join(rng.choices(words, k=n))
    listed = [payloads_of(n, v) for n, v in ((64, 1), (64, 2), (128, 3), (4096, 40), (65536, 256), (640, 129), (100, 16), (1, 1))]
    listed += [text(k) for k in (20, 300, 4000)] + [b"\0" * 64, b"ab" * 3200, bytes(range(256)) * 300, b"x" * 20000, bytes(64 * 40) + text(50)]
    listed += [text(60) for _ in range(100)]  # enough to decode together
    media = payloads.encode(listed)
    found = payloads.decode(media, list(map(len, listed)))
    assert [p for _, p in found] == listed
    assert all(pixels.shape[1] == 64 for pixels, _ in found)
    alone = [payloads.encode([p])[0] for p in listed]
    assert [payloads.decode([m], [len(p)])[0][1] for m, p in zip(alone, listed)] == listed
    assert len(media[9]) < len(listed[9]) / 3 and len(media[12]) < 200 and len(media[14]) < 200
    assert payloads.encode([]) == []
    with pytest.raises(ValueError):
        payloads.encode([b""])


def test_width_grows_with_the_payload():
    n = 64 * webp.MAX_SIDE + 777
    payload = payloads_of(n, 50)
    (media,) = payloads.encode([payload])
    ((pixels, got),) = payloads.decode([media], [n])
    assert got == payload and pixels.shape[1] == 128


def test_each_transform_is_chosen():
    kind = lambda p: (lambda b: (b.read(40), b.read(1) and 1 + b.read(2))[1])(webp.Bits(payloads.encode([p])[0][20:]))
    rng = random.Random(5)
    rising = bytes(itertools.accumulate((rng.randrange(3) for _ in range(6400)), lambda a, b: (a + b) % 256))
    assert kind(rising) == 1 + webp.PREDICTOR
    assert kind(bytes(rng.choices(b"01234567", k=640))) == 1 + webp.PALETTE
    assert kind(b"words of a usual text, with more than sixteen letters") == 0


def test_references_are_earlier_bytes():
    rng = random.Random(8)
    for _ in range(30):
        strings = [bytes(rng.choices(b"ab", k=rng.randrange(1, 60))) * rng.randrange(1, 200) for _ in range(4)]
        data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(list(map(len, strings)))
        place, length, distance = payloads.references(data, ends)
        assert (place[1:] >= (place + length)[:-1]).all() and (length <= payloads.LONGEST).all()
        for p, n, d in zip(place.tolist(), length.tolist(), distance.tolist()):
            k = int(np.searchsorted(ends, p, "right"))
            assert p - d >= (ends[k - 1] if k else 0) and p + n <= ends[k]
            assert data[p : p + n].tolist() == [int(data[p - d + i % d]) for i in range(n)]


def test_files_of_another_encoder():
    """Published one-pixel files: those that browsers are tested for lossless WebP with."""
    for text, pixel in (("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=", None), ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", 0)):
        p = webp.decode(base64.b64decode(text))
        assert p.shape == (1, 1) and (pixel is None or int(p[0, 0]) >> 24 == pixel)


def test_images_decoded_together_are_those_decoded_alone():
    pictures = [picture(5 + k % 7, 3 + k % 11, seed=k) for k in range(60)]
    files = [webp.encode(p, ((), (0,), (2,), (1, 0))[k % 4], 0, bool(k % 2), 0) for k, p in enumerate(pictures)] + [webp.encode(pictures[0], (), 4, True, 2)]
    for p, got in zip([*pictures, pictures[0]], webp.decode_many(files)):
        assert (p == got).all()


def test_broken_files():
    media = payloads.encode([bytes(random.Random(4).choices(range(256), k=640))])[0]
    for cut in (media[:10], media[:30], media[:400], b"RIFX" + media[4:]):
        with pytest.raises((webp.FormatError, ValueError, IndexError, struct.error)):
            webp.decode(cut)
    with pytest.raises((webp.FormatError, ValueError, IndexError)):
        webp.decode_many([media[:400]] * 50)
