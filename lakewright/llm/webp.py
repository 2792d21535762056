"""Lossless WebP (VP8L) in numpy: a decoder of the whole format and a writer.

Format: RFC 9649. The decoder reads prefix codes, back-references and colour caches, groups of
codes over a meta image, and inverts the predictor, cross-colour, subtract-green and palette
transforms. Pixels are ARGB in uint32. ``decode_many`` reads the symbols of grey images together, by
array operations over the images; of others, and of the longest of the grey ones, one by one.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np

#: Order of code length codes, fixed by the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Neighbours that short distance codes name: the nearest first, above before left, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE = 16384
OPAQUE = 0xFF000000
#: Images that are left when decoding goes on one by one: fewer are not worth array operations.
FEW = 40


class FormatError(ValueError):
    pass


def _reverse(value: int, n: int) -> int:
    return int(f"{value:0{n}b}"[::-1], 2) if n else 0


# Reading


class Bits:
    """Bits of a byte string, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        at, self.at = self.at, self.at + n
        if self.at > self.end:
            raise FormatError("the data end early")
        return (int.from_bytes(self.data[at >> 3 : (self.at + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        """The next n bits, zeros after the end."""
        return (int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7)) & ((1 << n) - 1)


_ORDERS: dict[int, np.ndarray] = {}


def _reversed_order(n: int) -> np.ndarray:
    """The numbers of n bits, each with its bits reversed."""
    if n not in _ORDERS:
        _ORDERS[n] = np.array([_reverse(i, n) for i in range(1 << n)])
    return _ORDERS[n]


class Code:
    """A canonical prefix code. table: for the next bits, as many as the longest symbol has, 16 times the symbol plus its length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.bits = 0
        if len(used) <= 1:
            self.table = (used if len(used) else np.zeros(1, np.int64)).astype(np.uint32) << np.uint32(4)
            return
        own = lengths[used]
        order = np.argsort(own, kind="stable")
        own, used = own[order], used[order]
        self.bits = int(own[-1])
        room = 1 << (self.bits - own)
        if room.sum() != 1 << self.bits:
            raise FormatError("an incomplete code")
        self.table = np.repeat((used << 4 | own).astype(np.uint32), room)[_reversed_order(self.bits)]

    def read(self, bits: Bits) -> int:
        entry = int(self.table[bits.peek(self.bits)])
        bits.at += entry & 15
        if bits.at > bits.end:
            raise FormatError("the data end early")
        return entry >> 4


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    kinds = np.zeros(19, np.int64)
    for i in LENGTH_ORDER[: 4 + bits.read(4)]:
        kinds[i] = bits.read(3)
    kind = Code(kinds)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last, table, mask = 0, 8, kind.table.tolist(), (1 << kind.bits) - 1
    # Lengths have 14 bits at most with what follows them; the bits pass through one integer.
    held = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * size + 2], "little") >> (bits.at & 7)
    while at < size and most:
        most -= 1
        entry = table[held & mask]
        symbol, used = entry >> 4, entry & 15
        held >>= used
        if symbol < 16:
            lengths[at] = symbol
            last, at = symbol or last, at + 1
        else:
            extra, n = ((2, 3), (3, 3), (7, 11))[symbol - 16]
            n += held & ((1 << extra) - 1)
            held, used = held >> extra, used + extra
            if at + n > size:
                raise FormatError("too many code lengths")
            lengths[at : at + n] = last if symbol == 16 else 0
            at += n
        bits.at += used
    if bits.at > bits.end:
        raise FormatError("the data end early")
    return Code(lengths)


def _prefixed(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def side(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


@dataclass
class Coded:
    """An entropy-coded image whose codes have been read, and not its pixels."""

    width: int
    n: int
    cache_bits: int
    groups: list[list[Code]]
    meta: np.ndarray | None
    meta_bits: int


def read_codes(bits: Bits, width: int, height: int, main: bool) -> Coded:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise FormatError("too large a colour cache")
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (read_image(bits, side(width, meta_bits), side(height, meta_bits), False) >> 8) & 0xFFFF
        meta, groups = meta.reshape(side(height, meta_bits), -1), int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    return Coded(width, width * height, cache_bits, [[read_code(bits, n) for n in sizes] for _ in range(groups)], meta, meta_bits)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels of an entropy-coded image, before any transform."""
    image = read_codes(bits, width, height, main)
    out = np.zeros(image.n, np.uint32)
    read_pixels(bits, image, out, 0)
    return out


def read_pixels(bits: Bits, image: Coded, out: np.ndarray, at: int) -> None:
    """The image's pixels from place at on, symbol by symbol, into out, which has those before it."""
    n, width, cache_bits, meta, meta_bits = image.n, image.width, image.cache_bits, image.meta, image.meta_bits
    if is_grey(image):
        try:
            _read_grey(bits, image, out, at)
        except IndexError:  # of the words of data
            raise FormatError("the data end early") from None
        return
    cache = [0] * (1 << cache_bits)
    pixels = out.tolist()
    while at < n:
        green, red, blue, alpha, distance = image.groups[meta[(at // width) >> meta_bits, (at % width) >> meta_bits] if meta is not None else 0]
        symbol, start = green.read(bits), at
        if symbol < 256:
            r, b = red.read(bits), blue.read(bits)
            pixels[at] = alpha.read(bits) << 24 | r << 16 | symbol << 8 | b
            at += 1
        elif symbol < 280:
            length = _prefixed(bits, symbol - 256)
            back = _distance(_prefixed(bits, distance.read(bits)), width)
            if back > at or at + length > n:
                raise FormatError("a reference out of the image")
            for _ in range(length):
                pixels[at] = pixels[at - back]
                at += 1
        else:
            pixels[at] = cache[symbol - 280]
            at += 1
        if cache_bits:
            for p in pixels[start:at]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    out[:] = pixels


def _read_grey(bits: Bits, image: Coded, out: np.ndarray, at: int) -> None:
    """read_pixels where red, blue and alpha are the same everywhere and there is no cache: bits pass through one integer."""
    (green, *rest, distance), n, width = image.groups[0], image.n, image.width
    table, mask = green.table.tolist(), (1 << green.bits) - 1
    red, blue, alpha = (int(c.table[0]) >> 4 for c in rest)
    fixed = alpha << 24 | red << 16 | blue
    first = bits.at >> 5
    words = np.frombuffer(bits.data + bytes(-len(bits.data) % 4 + 8), "<u4")[first:].tolist()
    held, have, k = words[0] >> (bits.at & 31), 32 - (bits.at & 31), 1
    run: list[int] = []
    add, left = run.append, n - at
    while left:
        if have < 32:
            held, have, k = held | words[k] << have, have + 32, k + 1
        entry = table[held & mask]
        size = entry & 15
        held, have = held >> size, have - size
        if entry < 4096:  # a symbol below 256
            add(entry)
            left -= 1
            continue
        if run:
            out[at : at + len(run)] = np.array(run, np.uint32) >> np.uint32(4) << np.uint32(8) | np.uint32(fixed)
            at += len(run)
            run.clear()
        bits.at = 32 * (first + k) - have
        length = _prefixed(bits, (entry >> 4) - 256)
        back = _distance(_prefixed(bits, distance.read(bits)), width)
        if back > at or at + length > n:
            raise FormatError("a reference out of the image")
        _repeat(out, at, length, back)
        at, left = at + length, left - length
        k = (bits.at >> 5) - first
        held, have, k = words[k] >> (bits.at & 31), 32 - (bits.at & 31), k + 1
    if run:
        out[at : at + len(run)] = np.array(run, np.uint32) >> np.uint32(4) << np.uint32(8) | np.uint32(fixed)
    bits.at = 32 * (first + k) - have
    if bits.at > bits.end:
        raise FormatError("the data end early")


def _repeat(out: np.ndarray, at: int, length: int, back: int) -> None:
    if back >= length:
        out[at : at + length] = out[at - back : at - back + length]
    else:
        out[at : at + length] = np.resize(out[at - back : at], length)


_NEAR_X, _NEAR_Y = (np.array([0, *(p[k] for p in NEAR)], np.int64) for k in (0, 1))


def is_grey(image: Coded) -> bool:
    """Whether only green varies, by one group of codes and without cache."""
    return image.meta is None and not image.cache_bits and not any(c.bits for c in image.groups[0][1:4])


def read_together(images: list[tuple[Bits, Coded]]) -> list[np.ndarray]:
    """Pixels of grey images. A step reads a symbol of each: pixels are set, and an image whose next symbol is
    a reference waits until a third of them do; then all their references are copied."""
    sizes = np.array([i.n for _, i in images], np.int64)
    # A place after each image takes what is read when it is done.
    first = np.cumsum(sizes + 1) - sizes - 1
    out = np.zeros(int((sizes + 1).sum()), np.uint32)
    parts = [out[f : f + n] for f, n in zip(first.tolist(), sizes.tolist())]
    rest = [(k, 0, b.at) for k, (b, _) in enumerate(images)]
    if len(images) > FEW:
        raw = b"".join(x for b, _ in images for x in (b.data, bytes(16)))
        view = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        shift = 8 * np.cumsum([0, *(len(b.data) + 16 for b, _ in images[:-1])])
        tables = [[i.groups[0][j].table for _, i in images] for j in (0, 4)]
        table, far_table = (np.concatenate(t).astype(np.int64) for t in tables)
        offset, far_offset = (np.cumsum([0, *map(len, t[:-1])]) for t in tables)
        mask, far_mask = (np.array([(1 << i.groups[0][j].bits) - 1 for _, i in images], np.uint64) for j in (0, 4))
        fixed = np.array([sum((int(c.table[0]) >> 4) << s for c, s in zip(i.groups[0][1:4], (16, 0, 24))) for _, i in images], np.int64)
        width = np.array([i.width for _, i in images], np.int64)
        lane, place, end = np.arange(len(images)), first.copy(), first + sizes
        bit, most = np.array([b.at for b, _ in images], np.int64) + shift, 8 * (len(raw) - 8)
        low = lambda b: view[b >> 3] >> (b & 7).astype(np.uint64)

        def prefixed(prefix, b):
            extra = np.maximum(prefix - 2, 0) >> 1
            value = low(b) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))
            return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + value.astype(np.int64)) + 1, b + extra

        while len(lane) > FEW:
            enough = 2 * len(lane) // 3
            while True:
                entry = table[offset + (low(bit) & mask).astype(np.int64)]
                plain = (entry < 4096) & (place < end)  # symbols below 256
                if np.count_nonzero(plain) < enough:
                    break
                out[place] = fixed | entry >> 4 << 8
                bit += (entry & 15) * plain
                place += plain
            c = np.flatnonzero((entry >= 4096) & (place < end))
            if len(c):
                entry, b = entry[c], np.minimum(bit[c], most)  # a broken file ends in an error
                length, b = prefixed((entry >> 4) - 256, b + (entry & 15))
                entry = far_table[far_offset[c] + (low(np.minimum(b, most)) & far_mask[c]).astype(np.int64)]
                code, bit[c] = prefixed(entry >> 4, np.minimum(b + (entry & 15), most))
                near = np.minimum(code, len(NEAR))
                back = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[c]))
                if (back > place[c] - first[c]).any() or (place[c] + length > end[c]).any():
                    raise FormatError("a reference out of the image")
                for p, n, d in zip(place[c].tolist(), length.tolist(), back.tolist()):
                    _repeat(out, p, n, d)
                place[c] += length
            bit = np.minimum(bit, most)
            on = place < end
            if not on.all():
                for k, b in zip(lane[~on].tolist(), (bit - shift)[~on].tolist()):
                    if b > images[k][0].end:
                        raise FormatError("the data end early")
                lane, place, bit, end, first, shift, width, fixed, offset, mask, far_offset, far_mask = (
                    x[on] for x in (lane, place, bit, end, first, shift, width, fixed, offset, mask, far_offset, far_mask)
                )
        rest = zip(lane.tolist(), (place - first).tolist(), (bit - shift).tolist())
    for k, done, b in rest:
        bits, image = images[k]
        bits.at = b
        read_pixels(bits, image, parts[k], done)
    return parts


# Transforms


def channels(pixels: np.ndarray) -> np.ndarray:
    """(..., 4): alpha, red, green, blue."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode, left, top, right, corner):
    """The prediction of format mode 0-13 from neighbours (arrays or rows of four channels); right is the top right."""
    avg = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0]) + 0 * left
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return avg(avg(left, right), top)
    if mode < 10:
        return avg(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return avg(avg(left, corner), avg(top, right))
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = avg(left, top)
        return np.clip(a + np.trunc((a - corner) / 2).astype(np.int64), 0, 255)
    raise FormatError("no such predictor")


def _mode(modes: np.ndarray, size: int, x: int, y: int) -> int:
    return 1 if y == 0 and x else 2 if x == 0 and y else 0 if not (x or y) else int(modes[y >> size, x >> size])


def undo_predictor(c: np.ndarray, modes: np.ndarray, size: int) -> np.ndarray:
    """c: residuals (height, width, 4). The pixel after a row's last is the next row's first."""
    h, w, _ = c.shape
    if (only := set(modes.ravel().tolist())) in ({1}, {2}):
        # Sums along rows or columns, from the first pixel, whose prediction is opaque black.
        c = c.copy()
        c[0, 0, 0] += 255
        if only == {1}:
            c[:, 0] = np.cumsum(c[:, 0], 0)
            return np.cumsum(c, 1) & 255
        c[0] = np.cumsum(c[0], 0)
        return np.cumsum(c, 0) & 255
    flat = c.reshape(-1, 4).copy()
    zero = np.zeros(4, np.int64)
    for i in range(h * w):
        y, x = divmod(i, w)
        near = [flat[i - d] if i >= d else zero for d in (1, w, w - 1, w + 1)]
        flat[i] = (flat[i] + predicted(_mode(modes, size, x, y), *near)) & 255
    return flat.reshape(c.shape)


def do_predictor(c: np.ndarray, modes: np.ndarray, size: int) -> np.ndarray:
    h, w, _ = c.shape
    if (only := set(modes.ravel().tolist())) in ({1}, {2}):
        out = c.copy()
        out[0, 1:] -= c[0, :-1]
        out[1:, 0] -= c[:-1, 0]
        out[0, 0, 0] -= 255
        if only == {1}:
            out[1:, 1:] -= c[1:, :-1]
        else:
            out[1:, 1:] -= c[:-1, 1:]
        return out & 255
    flat, out, zero = c.reshape(-1, 4), c.reshape(-1, 4).copy(), np.zeros(4, np.int64)
    for i in range(h * w):
        y, x = divmod(i, w)
        near = [flat[i - d] if i >= d else zero for d in (1, w, w - 1, w + 1)]
        out[i] = (flat[i] - predicted(_mode(modes, size, x, y), *near)) & 255
    return out.reshape(c.shape)


def _byte(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def cross_colour(c: np.ndarray, elements: np.ndarray, size: int, sign: int) -> np.ndarray:
    """sign 1 inverts the transform, -1 does it. elements: channels of the blocks' image."""
    h, w, _ = c.shape
    e = _byte(np.repeat(np.repeat(elements, 1 << size, 0), 1 << size, 1)[:h, :w])
    out, green = c.copy(), _byte(c[..., 2])
    out[..., 1] = (c[..., 1] + sign * ((e[..., 3] * green) >> 5)) & 255
    red = _byte((out if sign > 0 else c)[..., 1])
    out[..., 3] = (c[..., 3] + sign * (((e[..., 2] * green) >> 5) + ((e[..., 1] * red) >> 5))) & 255
    return out


def palette_bits(n: int) -> int:
    return 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0


def undo_palette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """pixels (height, packed width): indices in green, several to a pixel where the palette is small."""
    bits = palette_bits(len(table))
    green = (pixels >> np.uint32(8)) & np.uint32(255)
    per, depth = 1 << bits, 8 >> bits
    index = np.stack([(green >> np.uint32(i * depth)) & np.uint32((1 << depth) - 1) for i in range(per)], -1).reshape(len(pixels), -1)[:, :width]
    return np.append(table, np.zeros(256, np.uint32))[index]


def _read_head(data: bytes) -> tuple[Bits, Coded, int, list]:
    """(the bits, the main image's codes, its height, the transforms to undo)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise FormatError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + struct.unpack_from("<I", data, 16)[0]])
    if bits.read(8) != 0x2F:
        raise FormatError("no signature")
    full, height = bits.read(14) + 1, bits.read(14) + 1
    if bits.read(4) >> 1:
        raise FormatError("no such version")
    width, undo = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            w, h = side(width, size), side(height, size)
            undo.append((kind, read_image(bits, w, h, False).reshape(h, w), size, width))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = joined(np.cumsum(channels(read_image(bits, n, 1, False)), 0))
            undo.append((kind, table, 0, width))
            width = side(width, palette_bits(n))
        else:
            undo.append((kind, None, 0, width))
    return bits, read_codes(bits, width, height, True), height, undo


def _undone(pixels: np.ndarray, undo: list) -> np.ndarray:
    for kind, image, size, w in reversed(undo):
        if kind == PALETTE:
            pixels = undo_palette(pixels, image, w)
            continue
        c = channels(pixels)
        if kind == PREDICTOR:
            c = undo_predictor(c, (image >> np.uint32(8)) & np.uint32(15), size)
        elif kind == CROSS_COLOUR:
            c = cross_colour(c, channels(image), size, 1)
        else:
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
        pixels = joined(c)
    return pixels


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Pixels (height, width) of each of the lossless WebP files."""
    heads, pixels = [_read_head(f) for f in files], [None] * len(files)
    together = [k for k, (_, image, _, _) in enumerate(heads) if is_grey(image)]
    for k, p in zip(together, read_together([heads[k][:2] for k in together])):
        pixels[k] = p
    for k, (bits, image, height, undo) in enumerate(heads):
        if pixels[k] is None:
            pixels[k] = np.zeros(image.n, np.uint32)
            read_pixels(bits, image, pixels[k], 0)
        pixels[k] = _undone(pixels[k].reshape(height, image.width), undo)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) of one lossless WebP file."""
    return decode_many([data])[0]


# Writing


def pack(values: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The values' low bits, one after the other, as the byte strings that end before the entries ends."""
    sizes = sizes.astype(np.int64)
    at = np.cumsum(sizes) - sizes
    begins = np.concatenate([[0], ends[:-1]])
    total = np.add.reduceat(sizes, begins)
    words = (total + 127) // 64  # whole words for each string, and one that spills
    base = np.cumsum(words) - words
    at += np.repeat(64 * base - at[begins], np.diff(np.append(begins, len(sizes))))
    out = np.zeros(int(words.sum()), np.uint64)
    word, low, values = at >> 6, (at & 63).astype(np.uint64), values.astype(np.uint64)
    # The bits of entries are apart, so adding them is joining them.
    np.add.at(out, word, values << low)
    over = np.flatnonzero((at & 63) + sizes > 64)
    np.add.at(out, word[over] + 1, values[over] >> (np.uint64(64) - low[over]))
    raw = out.astype("<u8").tobytes()
    return [raw[8 * b : 8 * b + (n + 7) // 8] for b, n in zip(base.tolist(), total.tolist())]


class Writer:
    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.values.append(value)
            self.sizes.append(n)

    def bytes(self) -> bytes:
        return pack(np.array(self.values, np.uint64), np.array(self.sizes), np.array([len(self.sizes)]))[0]


def code_lengths(counts: Mapping[int, int], size: int) -> np.ndarray:
    """Huffman code lengths of at most 15 bits."""
    out = np.zeros(size, np.int64)
    symbols, flat = sorted(counts), 0
    if len(symbols) == 1:
        out[symbols[0]] = 1
        return out
    while True:
        heap = [(max(counts[s], 1) + flat, i) for i, s in enumerate(symbols)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(symbols) - 1)
        for node in range(len(symbols), 2 * len(symbols) - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            heapq.heapreplace(heap, (a + b, node))
            parent[i] = parent[j] = node
        depth = [0] * len(parent)
        for i in range(len(parent) - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(symbols)], default=0) <= 15:
            out[symbols] = depth[: len(symbols)]
            return out
        flat = 2 * flat + 1 + sum(counts.values()) // 1000


def codes(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's bits as they are written, of a canonical code of two symbols or more."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    room = 1 << (15 - lengths[used])
    out = np.zeros(len(lengths), np.int64)
    out[used] = _reversed_order(15)[np.cumsum(room) - room]
    return out


def canonical(lengths: np.ndarray) -> dict[int, tuple[int, int]]:
    """symbol -> (bits as they are written, how many)."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1:
        return {s: (0, 0) for s in used}
    return dict(zip(used, zip(codes(lengths)[used].tolist(), lengths[used].tolist())))


def put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and used.max(initial=0) < 256:
        w.put(1, 1)
        w.put(int(len(used) == 2), 1)
        w.put(1, 1)
        for s in used.tolist() or [0]:
            w.put(s, 8)
        return
    w.put(0, 1)
    # Lengths as symbols: runs of zeros are one.
    last = 0
    runs: list[tuple[int, int, int]] = []
    for u in used.tolist():
        gap = u - last
        while gap > 2:
            n = min(gap, 138)
            runs.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            gap -= n
        runs += [(0, 0, 0)] * gap + [(int(lengths[u]), 0, 0)]
        last = u + 1
    counts = Counter(r[0] for r in runs)
    own = code_lengths(counts, 19)
    if own.max() > 7:
        own[:] = 0
        own[[*range(13)]] = 4
        own[[13, 14, 15, 16, 17, 18]] = 5
    n = max(4, max(i for i, k in enumerate(LENGTH_ORDER) if own[k]) + 1)
    w.put(n - 4, 4)
    for k in LENGTH_ORDER[:n]:
        w.put(int(own[k]), 3)
    # Only so many symbols follow, two at least: lengths of zero after them are left out.
    table, many = canonical(own), (len(runs) - 2).bit_length()
    many = max(2, many + many % 2)
    w.put(1, 1)
    w.put((many - 2) // 2, 3)
    w.put(len(runs) - 2, many)
    values, sizes = w.values, w.sizes
    for symbol, extra, size in runs:
        value, bits = table[symbol]
        if bits:
            values.append(value)
            sizes.append(bits)
        if size:
            values.append(extra)
            sizes.append(size)


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits' value, how many)."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    second = (value - 1) >> (top - 1) & 1
    return 2 * top + second, (value - 1) & ((1 << (top - 1)) - 1), top - 1


def _tokens(pixels: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """("l", pixel), ("c", cache index) or ("r", length, distance code)."""
    out, at, seen = [], 0, {}
    cache = [None] * (1 << cache_bits)
    near = {max(1, x + y * width): i for i, (x, y) in reversed(list(enumerate(NEAR, 1)))}
    while at < len(pixels):
        key, length = tuple(pixels[at : at + 3]), 0
        back = at - seen[key] if key in seen else 0
        if references and back and len(key) == 3:
            while at + length < len(pixels) and length < 4096 and pixels[at + length] == pixels[at + length - back]:
                length += 1
        slot = (CACHE_FACTOR * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            out.append(("r", length, near.get(back, back + len(NEAR))))
        elif cache_bits and cache[slot] == pixels[at]:
            out.append(("c", slot))
        else:
            out.append(("l", pixels[at]))
        for i in range(at, at + max(1, length)):
            seen[tuple(pixels[i : i + 3])] = i
            if cache_bits:
                cache[(CACHE_FACTOR * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[i]
        at += max(1, length)
    return out


def put_image(w: Writer, pixels: np.ndarray, cache_bits: int = 0, references: bool = False, main: bool = False, meta_bits: int = 0) -> None:
    height, width = pixels.shape
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    tokens = _tokens([int(p) for p in pixels.ravel()], width, cache_bits, references)
    if main:
        w.put(int(meta_bits > 0), 1)
    groups, group_of = 1, lambda at: 0
    if main and meta_bits:
        h, wide = side(height, meta_bits), side(width, meta_bits)
        w.put(meta_bits - 2, 3)
        meta = (np.arange(h * wide) % 2).reshape(h, wide)
        put_image(w, (meta << 8).astype(np.uint32))
        groups, group_of = int(meta.max()) + 1, lambda at: int(meta[(at // width) >> meta_bits, (at % width) >> meta_bits])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[Counter() for _ in sizes] for _ in range(groups)]
    stream, at = [], 0
    for t in tokens:
        g = group_of(at)
        if t[0] == "l":
            parts = [(0, (t[1] >> 8) & 255), (1, (t[1] >> 16) & 255), (2, t[1] & 255), (3, t[1] >> 24)]
        elif t[0] == "c":
            parts = [(0, 280 + t[1])]
        else:
            (a, ax, an), (b, bx, bn) = _prefix(t[1]), _prefix(t[2])
            parts = [(0, 256 + a), (None, ax, an), (4, b), (None, bx, bn)]
        for p in parts:
            if p[0] is not None:
                counts[g][p[0]][p[1]] += 1
        stream.append((g, parts))
        at += t[1] if t[0] == "r" else 1
    tables = []
    for g in counts:
        own = [code_lengths(c, n) if c else np.zeros(n, np.int64) for c, n in zip(g, sizes)]
        for x in own:
            put_code(w, x)
        tables.append([canonical(x) for x in own])
    for g, parts in stream:
        for p in parts:
            w.put(*(p[1:] if p[0] is None else tables[g][p[0]][p[1]]))


def container(bits: bytes) -> bytes:
    pad = len(bits) % 2
    return b"RIFF" + struct.pack("<I", 12 + len(bits) + pad) + b"WEBPVP8L" + struct.pack("<I", len(bits)) + bits + b"\0" * pad


def _start(width: int, height: int) -> Writer:
    w = Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    return w


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, meta_bits: int = 0, size: int = 2, modes=None, elements=None) -> bytes:
    """A file of the pixels (height, width) with the transforms in the order given; a palette takes 256 colours at most."""
    height, width = pixels.shape
    w = _start(width, height)
    for kind in transforms:
        w.put(1 | kind << 1, 3)
        h, wide = side(height, size), side(pixels.shape[1], size)
        if kind == PREDICTOR:
            own = np.resize(np.arange(14) if modes is None else modes, (h, wide))
            w.put(size - 2, 3)
            put_image(w, (own << 8).astype(np.uint32))
            pixels = joined(do_predictor(channels(pixels), own, size))
        elif kind == CROSS_COLOUR:
            own = np.resize(np.array([0x00123456, 0x00F0E1D2]) if elements is None else elements, (h, wide)).astype(np.uint32)
            w.put(size - 2, 3)
            put_image(w, own)
            pixels = joined(cross_colour(channels(pixels), channels(own), size, -1))
        elif kind == SUBTRACT_GREEN:
            c = channels(pixels)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            pixels = joined(c)
        else:
            table, index = np.unique(pixels, return_inverse=True)
            if len(table) > 256:
                raise ValueError("a palette takes 256 colours at most")
            w.put(len(table) - 1, 8)
            put_image(w, joined(np.diff(channels(table), axis=0, prepend=0))[None])
            per, depth = 1 << palette_bits(len(table)), 8 >> palette_bits(len(table))
            index = index.reshape(pixels.shape)
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(height, -1, per)
            pixels = ((index << (np.arange(per) * depth)).sum(-1) << 8).astype(np.uint32)
    w.put(0, 1)
    put_image(w, pixels, cache_bits, references, True, meta_bits)
    return container(w.bytes())
