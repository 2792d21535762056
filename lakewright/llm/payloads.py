"""Byte strings as lossless WebP images, many at a time.

A byte is a grey pixel: its value in green, red and blue zero, opaque. Rows have ROW pixels, and more
where an image would be too high, so a payload is one file whatever its size; the last row ends in
zeros. For each payload the transform is chosen that leaves the fewest bits by the entropy of its
pixels: none, a palette (which packs several pixels into one where they have sixteen values or fewer),
or a prediction from the left or from above. Back-references then stand for bytes that were there
before, by the next earlier place with the same KEY bytes, and the rest are symbols of a prefix code
made for the image. Cross-colour, subtract-green and colour caches save nothing on one channel.
"""

from __future__ import annotations

import numpy as np

from . import webp

ROW = 64
#: Equal bytes that begin a reference; the format's longest reference and farthest distance.
KEY, LONGEST, FARTHEST = 8, 4096, (1 << 20) - 120
_GREEN, _DISTANCE = 280, 40


def _width(n: int) -> int:
    return ROW * max(1, -(-n // (ROW * webp.MAX_SIDE)))


def _entropy(values: np.ndarray) -> float:
    n = np.bincount(values, minlength=1)
    n = n[n > 0]
    return float((n * np.log2(len(values) / n)).sum())


def _left(samples: np.ndarray, mode: int) -> np.ndarray:
    """What a prediction of the format's mode 1 (left) or 2 (above) leaves of the rows of bytes."""
    out = samples.copy()
    out[0, 1:] -= samples[0, :-1]
    out[1:, 0] -= samples[:-1, 0]
    out[1:, 1:] -= samples[1:, :-1] if mode == 1 else samples[:-1, 1:]
    return out


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbols, the extra bits' values, how many) of lengths or distance codes."""
    x = value.astype(np.int64) - 1
    top = np.maximum(np.frexp(np.maximum(x, 1).astype(np.float64))[1] - 1, 1)
    extra = np.where(x < 4, 0, top - 1)
    prefix = np.where(x < 4, x, 2 * top + ((x >> (top - 1)) & 1))
    return prefix, np.where(x < 4, 0, x & ((1 << extra) - 1)), extra


def references(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of the references that a greedy reading takes, in the strings that end at ends of data."""
    none = np.zeros(0, np.int64)
    if len(data) < KEY:
        return none, none, none
    raw, many = data.tobytes(), len(data)
    key = np.ndarray((many - KEY + 1,), "<u8", raw, 0, (1,))
    of = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    whole = np.ones(many, bool)
    for k in range(1, KEY):
        whole[np.maximum(ends - k, 0)] = False
    whole = np.flatnonzero(whole[: len(key)])
    # Places sorted by key and place, as one number.
    bits = np.uint64(max(1, len(key).bit_length()))
    mixed = np.sort(key[whole] * np.uint64(0x9E3779B97F4A7C15) >> bits << bits | whole.astype(np.uint64))
    place = (mixed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int32)
    near = np.flatnonzero(mixed[1:] >> bits == mixed[:-1] >> bits)
    before, here = place[near], place[near + 1]
    back = here - before
    same = (key[before] == key[here]) & (of[before] == of[here]) & (back <= FARTHEST)
    distance = np.zeros(many, np.int32)
    distance[here[same]] = back[same]
    # Places one after the other with one distance are one match.
    last = np.append(np.flatnonzero(distance[:-1] != distance[1:]), many - 1)
    length = np.repeat(last.astype(np.int32), np.diff(last, prepend=-1)) - np.arange(many, dtype=np.int32) + np.int32(KEY)
    some = np.flatnonzero(distance)
    if not len(some):
        return none, none, none
    # The match that a greedy reading takes after each.
    upto = np.append(np.cumsum(distance > 0, dtype=np.int32), len(some))
    after, chain, k = upto[some + length[some] - 1], [], 0
    while k < len(some):
        chain.append(k)
        k = after.item(k)
    p = some[chain]
    n, d = length[p].astype(np.int64), distance[p].astype(np.int64)
    parts = -(-n // LONGEST)
    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    p, d, left = np.repeat(p, parts) + part * LONGEST, np.repeat(d, parts), np.repeat(n, parts) - part * LONGEST
    return p, np.minimum(left, LONGEST), d


def _head(payload: bytes) -> tuple[webp.Writer, np.ndarray, int]:
    """(what stands before the image's codes, the green values of its pixels, the alpha of them all)."""
    n = len(payload)
    if not n:
        raise ValueError("a payload has bytes")
    width = _width(n)
    height = -(-n // width)
    samples = np.frombuffer(payload + bytes(width * height - n), np.uint8).reshape(height, width)
    w = webp.Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no use of alpha, version 0
    used = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    if len(used) <= 16:
        w.put(1 | webp.PALETTE << 1, 3)
        w.put(len(used) - 1, 8)
        colours = (used << 8 | webp.OPAQUE).astype(np.uint32)
        webp.put_image(w, webp.joined(np.diff(webp.channels(colours), axis=0, prepend=0))[None])
        place = np.zeros(256, np.int64)
        place[used] = np.arange(len(used))
        per = 1 << webp.palette_bits(len(used))
        index = place[samples].reshape(height, -1, per)
        return w, (index << (np.arange(per) * (8 // per))).sum(-1).astype(np.uint8).ravel(), 255
    costs = [_entropy(x.ravel()) for x in (samples, _left(samples, 1), _left(samples, 2))]
    mode = int(np.argmin(costs))
    if mode:
        size = 9
        w.put(1 | webp.PREDICTOR << 1, 3)
        w.put(size - 2, 3)
        webp.put_image(w, np.full((webp.side(height, size), webp.side(width, size)), mode << 8, np.uint32))
        samples = _left(samples, mode)
    return w, samples.ravel(), 0 if mode else 255


def _put_own(w: webp.Writer, counts: np.ndarray, values: np.ndarray, bits: np.ndarray) -> None:
    """Writes a code made for the symbols' counts, and sets their bits and how many they are."""
    used = np.flatnonzero(counts)
    own = webp.code_lengths(dict(zip(used.tolist(), counts[used].tolist())), len(counts)) if len(used) else np.zeros(len(counts), np.int64)
    webp.put_code(w, own)
    if len(used) > 1:
        values[:], bits[:] = webp.codes(own), own


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a byte at least, as one file."""
    if not payloads:
        return []
    heads, green, alphas = zip(*map(_head, payloads))
    data, many = np.concatenate(green), len(payloads)
    sizes = np.fromiter(map(len, green), np.int64, many)
    ends = np.cumsum(sizes)
    place, length, distance = references(data, ends)
    # Tokens: the bytes that no reference stands for, and references, in order.
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, place, 1)
    np.add.at(step, place + length, -1)
    plain = np.cumsum(step[:-1]) == 0
    refers = np.zeros(len(data), bool)
    refers[place] = True
    token = np.flatnonzero(plain | refers)
    of = np.searchsorted(ends, token, "right")
    is_reference = refers[token]
    symbol = data[token].astype(np.int64)
    prefix, extra, extra_bits = _prefixes(length)
    symbol[is_reference] = 256 + prefix
    far, far_extra, far_bits = _prefixes(distance + len(webp.NEAR))
    counts = np.bincount(of * _GREEN + symbol, minlength=many * _GREEN).reshape(many, _GREEN)
    of_reference = of[is_reference]
    far_counts = np.bincount(of_reference * _DISTANCE + far, minlength=many * _DISTANCE).reshape(many, _DISTANCE)
    values, bits = np.zeros((many, _GREEN), np.uint64), np.zeros((many, _GREEN), np.int64)
    far_values, far_lengths = np.zeros((many, _DISTANCE), np.uint64), np.zeros((many, _DISTANCE), np.int64)
    zero = np.bincount([0], minlength=256)
    for k, (w, alpha) in enumerate(zip(heads, alphas)):
        w.put(0, 3)  # no more transforms, no colour cache, one group of codes
        _put_own(w, counts[k], values[k], bits[k])
        webp.put_code(w, zero)
        webp.put_code(w, zero)
        webp.put_code(w, np.bincount([alpha], minlength=256))
        _put_own(w, far_counts[k], far_values[k], far_lengths[k])
    # A reference is four entries: its length's symbol and bits, its distance's symbol and bits.
    entries = np.where(is_reference, 4, 1)
    heads_n = np.fromiter((len(w.sizes) for w in heads), np.int64, many)
    first = np.cumsum(entries) - entries + np.cumsum(heads_n)[of]
    total = int(entries.sum() + heads_n.sum())
    all_values, all_bits = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    per = np.bincount(of, entries, many).astype(np.int64) + heads_n
    upto = np.cumsum(per)
    for w, at in zip(heads, (upto - per).tolist()):
        all_values[at : at + len(w.sizes)], all_bits[at : at + len(w.sizes)] = w.values, w.sizes
    all_values[first], all_bits[first] = values[of, symbol], bits[of, symbol]
    at = first[is_reference]
    for k, (v, b) in enumerate(((extra, extra_bits), (far_values[of_reference, far], far_lengths[of_reference, far]), (far_extra, far_bits)), 1):
        all_values[at + k], all_bits[at + k] = v, b
    return [webp.container(b) for b in webp.pack(all_values, all_bits, upto)]


def decode(media: list[bytes], sizes: list[int]) -> list[tuple[np.ndarray, bytes]]:
    """(pixels, payload) of each file; sizes: the payloads' bytes."""
    out = []
    for pixels, n in zip(webp.decode_many(media), sizes):
        out.append((pixels, ((pixels.ravel()[:n] >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes()))
    return out
