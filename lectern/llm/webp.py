"""Lossless WebP (VP8L): a decoder of whole streams, a lockstep decoder of many images, and encoders.

Follows the published specification of the WebP lossless bitstream. Pixels are 32-bit words, alpha, red, green and blue
from the top.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np

#: Fixed values of the specification: order of the code length code, and (x, y) of the 120 short distance codes.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
SHORT = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: The longest code of the lockstep decoder's table, and the sides of an image of samples.
SPAN, WIDTH, HEIGHT = 11, 192, 64


# --- Bits and prefix codes


class Bits:
    """Reads a byte string from the lowest bit of its first byte on; bits behind its end are 0."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.loaded, self.word = data, at, -1, 0

    def peek(self, n: int) -> int:
        start = self.at >> 3
        if not self.loaded <= start or start + 8 > self.loaded + 64 or self.loaded < 0:
            self.loaded, self.word = start, int.from_bytes(self.data[start:start + 64], "little")
        return self.word >> (self.at - 8 * self.loaded) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        return v


def reversed_bits(v: int, n: int) -> int:
    return int(format(v, f"0{n}b")[::-1], 2) if n else 0


def canonical(lengths) -> list[tuple[int, int, int]]:
    """(length, code, symbol) of a canonical prefix code, by code."""
    used = sorted((int(n), s) for s, n in enumerate(lengths) if n)
    out, code, last = [], 0, 0
    for n, s in used:
        code <<= n - last
        out.append((n, code, s))
        code, last = code + 1, n
    return out


class Code:
    """A prefix code: its symbols by reversed code. A code of one symbol takes no bits."""

    def __init__(self, lengths):
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            raise ValueError("a prefix code without symbols")
        if self.only is None:
            codes = canonical(lengths)
            if sum(1 << (15 - n) for n, _, _ in codes) != 1 << 15:
                raise ValueError("a prefix code that is not complete")
            self.most = codes[-1][0]
            self.table: dict[tuple[int, int], int] = {(n, reversed_bits(c, n)): s for n, c, s in codes}
            self.sizes = sorted({n for n, _, _ in codes})

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        word = bits.peek(self.most)
        for n in self.sizes:
            if (s := self.table.get((n, word & ((1 << n) - 1)))) is not None:
                bits.at += n
                return s
        raise ValueError("a code that no symbol has")


@functools.lru_cache(64)
def _length_table(first: tuple[int, ...]) -> list[tuple[int, int]]:
    """(symbol, bits) of the code length code by the next seven bits."""
    used = [s for s, n in enumerate(first) if n]
    if len(used) == 1:
        return [(used[0], 0)] * 128
    if sum(1 << (7 - first[s]) for s in used) != 128:
        raise ValueError("a prefix code that is not complete")
    table = [(0, 0)] * 128
    for n, c, s in canonical(first):
        for rest in range(1 << (7 - n)):
            table[reversed_bits(c, n) | rest << n] = s, n
    return table


def read_lengths(bits: Bits, size: int) -> list[int]:
    """Code lengths of a prefix code over ``size`` symbols."""
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths
    first = [0] * 19
    for i in range(4 + bits.read(4)):
        first[LENGTH_ORDER[i]] = bits.read(3)
    table = _length_table(tuple(first))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last, start = 0, 8, bits.at >> 3
    word = int.from_bytes(bits.data[start:start + 2 * size + 8], "little") >> (bits.at & 7)  # 14 bits a symbol at most
    while at < size and left:
        left -= 1
        s, n = table[word & 127]
        word >>= n
        bits.at += n
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
            continue
        value, n, extra = (last, 3, 2) if s == 16 else (0, 3, 3) if s == 17 else (0, 11, 7)
        n += word & (1 << extra) - 1
        word >>= extra
        bits.at += extra
        if at + n > size:
            raise ValueError("code lengths run past the alphabet")
        if value:
            lengths[at:at + n] = [value] * n
        at += n
    return lengths


def read_group(bits: Bits, cache_bits: int) -> list[Code]:
    """The five codes: green with lengths and cache, red, blue, alpha, distance."""
    return [Code(read_lengths(bits, n)) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]


def prefix_value(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


# --- Decoding one stream


def entropy_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Pixels of an entropy-coded image; only the topmost has groups of codes by tile."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    tiles, tile_bits = None, 0
    if top and bits.read(1):
        tile_bits = 2 + bits.read(3)
        across = (width + (1 << tile_bits) - 1) >> tile_bits
        down = (height + (1 << tile_bits) - 1) >> tile_bits
        tiles = (entropy_image(bits, across, down, False) >> 8 & 0xFFFF).reshape(down, across)
    groups = [read_group(bits, cache_bits) for _ in range(int(tiles.max()) + 1 if tiles is not None else 1)]
    total, out, cache = width * height, [0] * (width * height), [0] * (1 << cache_bits)
    at = seen = 0  # pixels before ``seen`` are in the cache
    group = groups[0]
    while at < total:
        if tiles is not None:
            group = groups[tiles[(at // width) >> tile_bits, (at % width) >> tile_bits]]
        green = group[0].read(bits)
        if green < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            out[at] = alpha << 24 | red << 16 | green << 8 | blue
            at += 1
        elif green < 280:
            n = prefix_value(bits, green - 256)
            d = prefix_value(bits, group[4].read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = SHORT[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            while seen < at:
                cache[(CACHE_FACTOR * out[seen] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[seen]
                seen += 1
            out[at] = cache[green - 280]
            at += 1
    return np.array(out, np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """[..., 4] of alpha, red, green, blue."""
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def joined(parts: np.ndarray) -> np.ndarray:
    p = (parts & 0xFF).astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def predicted(mode: int, left, top, top_right, top_left):
    """The predictor of one pixel from its neighbours' channels."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        p = left + top - top_left
        return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + np.trunc((mean - top_left) / 2).astype(np.int64), 0, 255)
    return {
        0: lambda: np.array([255, 0, 0, 0]), 1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: half(half(left, top_right), top), 6: lambda: half(left, top_left), 7: lambda: half(left, top),
        8: lambda: half(top_left, top), 9: lambda: half(top, top_right), 10: lambda: half(half(left, top_left), half(top, top_right)),
    }.get(mode, lambda: np.array([255, 0, 0, 0]))()


def unpredict(pixels: np.ndarray, modes: np.ndarray, size_bits: int, sign: int = 1) -> np.ndarray:
    """Adds predictions to residuals (sign 1), or takes them from pixels (sign -1)."""
    rest = channels(pixels)
    done = rest.copy()
    h, w = pixels.shape
    for y in range(h):
        for x in range(w):
            if not y:
                p = done[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif not x:
                p = done[y - 1, 0]
            else:
                right = done[y - 1, x + 1] if x + 1 < w else done[y, 0]
                p = predicted(int(modes[y >> size_bits, x >> size_bits]), done[y, x - 1], done[y - 1, x], right, done[y - 1, x - 1])
            if sign > 0:
                done[y, x] = (rest[y, x] + p) & 0xFF
            else:
                rest[y, x] = (done[y, x] - p) & 0xFF
    return joined(done if sign > 0 else rest)


def cross_colour(pixels: np.ndarray, image: np.ndarray, size_bits: int, sign: int = 1) -> np.ndarray:
    """Adds (sign 1) or takes away what a tile's multipliers make of the other channels."""
    h, w = pixels.shape
    c = channels(pixels)
    signed = lambda v: (v + 128 & 0xFF) - 128
    m = signed(channels(np.kron(image, np.ones((1 << size_bits, 1 << size_bits), np.uint32))[:h, :w]))
    delta = lambda k, v: m[..., k] * signed(v) >> 5  # noqa: E731  multipliers: 1 red to blue, 2 green to blue, 3 green to red
    red = c[..., 1] + sign * delta(3, c[..., 2])
    blue = c[..., 3] + sign * (delta(2, c[..., 2]) + delta(1, (red if sign > 0 else c[..., 1]) & 0xFF))
    return joined(np.stack([c[..., 0], red, c[..., 2], blue], axis=-1))


def from_green(pixels: np.ndarray, sign: int = 1) -> np.ndarray:
    c = channels(pixels)
    return joined(np.stack([c[..., 0], c[..., 1] + sign * c[..., 2], c[..., 2], c[..., 3] + sign * c[..., 2]], axis=-1))


def palette_bits(size: int) -> int:
    """How many pixels, as a power of two, share one under a palette of so many colours."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def from_palette(pixels: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    shift = palette_bits(len(colours))
    index = pixels >> 8 & 0xFF
    if shift:
        depth = 8 >> shift
        index = (index[:, :, None] >> (np.arange(1 << shift, dtype=np.uint32) * depth) & ((1 << depth) - 1)).reshape(len(pixels), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[:len(colours)] = colours
    return table[index]


def decode_vp8l(data: bytes) -> np.ndarray:
    """[height, width] pixels of a VP8L stream."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    full, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.read(3) + 2
            across, down = (width + (1 << b) - 1) >> b, (height + (1 << b) - 1) >> b
            image = entropy_image(bits, across, down, False).reshape(down, across)
            undo.append((kind, image, b, width))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0, width))
        else:
            colours = entropy_image(bits, bits.read(8) + 1, 1, False)
            colours = joined(np.cumsum(channels(colours), axis=0))
            undo.append((kind, colours, 0, width))
            shift = palette_bits(len(colours))
            width = (width + (1 << shift) - 1) >> shift
    pixels = entropy_image(bits, width, height, True).reshape(height, width)
    for kind, image, b, w in reversed(undo):
        if kind == PREDICTOR:
            pixels = unpredict(pixels, image >> 8 & 0xF, b)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, image, b)
        elif kind == SUBTRACT_GREEN:
            pixels = from_green(pixels)
        else:
            pixels = from_palette(pixels, image, w)
    assert pixels.shape[1] == full
    return pixels


def streams(data: bytes) -> list[bytes]:
    """The VP8L streams of one or more WebP files behind each other."""
    out, at = [], 0
    while at < len(data):
        if data[at:at + 4] != b"RIFF" or data[at + 8:at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        stop = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
        at += 12
        while at + 8 <= stop:
            name, size = data[at:at + 4], int.from_bytes(data[at + 4:at + 8], "little")
            if name == b"VP8L":
                out.append(data[at + 8:at + 8 + size])
            elif name == b"VP8 ":
                raise ValueError("a lossy image")
            at += 8 + size + (size & 1)
        at = stop
    return out


# --- Decoding many images in lockstep


class _Head:
    """What a stream of green values says before its first pixel: sizes, prefix codes, the constant bits of the pixels, the
    palette if it has one, and the first bit of the pixels."""

    def __init__(self, width, height, green, distance, constant, palette, full, at):
        self.width, self.height, self.green, self.distance, self.constant, self.palette, self.full, self.at = width, height, green, distance, constant, palette, full, at

    def pixels(self, green: np.ndarray) -> np.ndarray:
        image = (green.astype(np.uint32) << 8 | np.uint32(self.constant)).reshape(self.height, self.width)
        return image if self.palette is None else from_palette(image, self.palette, self.full)


def _head_of(data: bytes) -> _Head | None:
    """The head of a stream with literals of green and copies, one group of codes, no cache, and no transform but a
    palette; None for other streams."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        return None
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        return None
    full, palette = width, None
    if bits.read(1):
        if bits.read(2) != PALETTE:
            return None
        colours = entropy_image(bits, bits.read(8) + 1, 1, False)
        palette = joined(np.cumsum(channels(colours), axis=0))
        shift = palette_bits(len(palette))
        width = (width + (1 << shift) - 1) >> shift
        if bits.read(1):
            return None
    if bits.read(1) or bits.read(1):
        return None
    green, rest = read_lengths(bits, 280), []
    for _ in range(3):
        used = [s for s, k in enumerate(read_lengths(bits, 256)) if k]
        if len(used) != 1:
            return None
        rest.append(used[0])
    distance = read_lengths(bits, 40)
    if max(green) > SPAN or max(distance) > SPAN:
        return None
    return _Head(width, height, green, distance if any(green[256:]) else None, rest[2] << 24 | rest[0] << 16 | rest[1], palette, full, bits.at)


_REVERSED = np.array([reversed_bits(i, SPAN) for i in range(1 << SPAN)])
_REVERSED_BY = [[reversed_bits(i, n) for i in range(1 << n)] for n in range(SPAN + 1)]
#: Extra bits and first value of each prefix symbol of lengths and distances.
_EXTRA = np.array([0] * 4 + [(s - 2) >> 1 for s in range(4, 40)], np.uint64)
_BITS, _LOW = _EXTRA.astype(np.int64), (np.uint64(1) << _EXTRA) - np.uint64(1)
_FIRST = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + 1 for s in range(40)], np.int64)
_SHORT_X, _SHORT_Y = np.array([(0, 0), *SHORT], np.int64).T


def _table(lengths: list[int]) -> np.ndarray:
    """symbol | length << 9 by the next SPAN bits."""
    size = np.array(lengths)
    used = np.flatnonzero(size)
    if len(used) == 1:
        return np.full(1 << SPAN, used[0], np.uint16)
    order = used[np.argsort(size[used], kind="stable")]
    if (1 << (SPAN - size[order])).sum() != 1 << SPAN:
        raise ValueError("a prefix code that is not complete")
    return np.repeat((order | size[order] << 9).astype(np.uint16), 1 << (SPAN - size[order]))[_REVERSED]


def _paired(table: np.ndarray) -> np.ndarray:
    """By the next SPAN bits: the first symbol (of copies less 256), a second one << 8, how many literals these are << 16 (none for
    a copy), and the bits that they take << 18. Two literals stand there where the bits hold both."""
    table = table.astype(np.uint32)
    first, size = table & np.uint32(511), table >> np.uint32(9)
    after = table[np.arange(1 << SPAN, dtype=np.uint32) >> size]
    second, both = after & np.uint32(511), size + (after >> np.uint32(9))
    literal = first < 256
    two = literal & (second < 256) & (both <= SPAN)
    return (first & np.uint32(255)) | second * two << np.uint32(8) | (literal.astype(np.uint32) + two) << np.uint32(16) | np.where(two, both, size) << np.uint32(18)


def _lockstep(data: list[bytes], heads: list[_Head]) -> list[np.ndarray]:
    """The green values of each stream. Each step reads one or two literals, or a copy, of every stream that has pixels left;
    literals are put in place, and the copies, which read only what stands before them, are made in order at the end. A place
    behind each stream takes what a step reads past its end."""
    starts = np.cumsum([0, *(len(d) + 8 for d in data)])
    raw = b"".join(d + b"\0" * 8 for d in data) + b"\0" * 8
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each byte on
    green, distance = [], [np.zeros(1 << SPAN, np.uint16)]
    far = np.zeros(len(heads), np.int64)
    for i, h in enumerate(heads):
        green.append(_paired(_table(h.green)))
        if h.distance is not None:
            far[i] = len(distance) << SPAN
            distance.append(_table(h.distance))
    green, distance = np.concatenate(green), np.concatenate(distance)
    sizes = np.array([h.width * h.height for h in heads], np.int64)
    firsts = np.cumsum([0, *(sizes + 2)])
    got, wide = np.zeros(firsts[-1], np.uint8), np.array([h.width for h in heads], np.int64)
    live, pos, out, base = np.arange(len(heads)), starts[:-1] * 8 + np.array([h.at for h in heads], np.int64), firsts[:-1].copy(), np.arange(len(heads)) << SPAN
    end, mask, found = out + sizes, np.uint64((1 << SPAN) - 1), []
    while len(live):
        word = words[pos >> 3] >> (pos & 7).view(np.uint64)
        entry = green[base + (word & mask).view(np.int64)]
        got[out], got[out + 1] = entry.astype(np.uint8), (entry >> np.uint32(8)).astype(np.uint8)
        step, used = (entry >> np.uint32(16) & np.uint32(3)).astype(np.int64), (entry >> np.uint32(18)).astype(np.int64)
        k = np.flatnonzero(step == 0)
        if len(k):
            w, s, which = word[k] >> used[k].view(np.uint64), (entry[k] & np.uint32(255)).astype(np.int64), live[k]
            n = _FIRST[s] + (w & _LOW[s]).view(np.int64)
            w >>= _EXTRA[s]
            to = distance[far[which] + (w & mask).view(np.int64)].astype(np.int64)
            t, size = to & 511, to >> 9
            found.append((which, out[k], n, t, w >> size.view(np.uint64)))
            used[k] += size + _BITS[s] + _BITS[t]
            step[k] = n
        out += step
        pos += used
        if (more := out < end).all():
            continue
        live, pos, out, base, end = live[more], pos[more], out[more], base[more], end[more]
    if found:
        which, at, n, t, w = (np.concatenate(x) for x in zip(*found))
        d = _FIRST[t] + (w & _LOW[t]).view(np.int64)
        near = np.where(d <= 120, d, 0)
        d = np.where(d > 120, d - 120, np.maximum(1, _SHORT_X[near] + _SHORT_Y[near] * wide[which]))
        if (d > at - firsts[which]).any() or (at + n > firsts[which] + sizes[which]).any():
            raise ValueError("a back-reference leaves the image")
        order, whole = np.argsort(at, kind="stable"), bytearray(got.tobytes())
        for o, size, back in zip(at[order].tolist(), n[order].tolist(), d[order].tolist()):
            if back >= size:
                whole[o:o + size] = whole[o - back:o - back + size]
            else:
                whole[o:o + size] = (whole[o - back:o] * (size // back + 1))[:size]
        got = np.frombuffer(whole, np.uint8)
    return [got[a:a + n] for a, n in zip(firsts.tolist(), sizes.tolist())]


def decode_many(data: list[bytes]) -> list[np.ndarray]:
    """[height, width] pixels of each VP8L stream. Streams of green literals and copies, with or without a palette, are
    decoded together; others, as those with a colour cache, groups or other transforms, one by one."""
    out: list[np.ndarray | None] = [None] * len(data)
    together, heads = [], []
    for i, d in enumerate(data):
        if h := _head_of(d):
            together.append(i)
            heads.append(h)
        else:
            out[i] = decode_vp8l(d)
    if together:
        for i, h, green in zip(together, heads, _lockstep([data[i] for i in together], heads)):
            out[i] = h.pixels(green)
    return out


# --- Encoding


def depths_of(weight: list[int], most: int) -> list[int]:
    """Lengths of a prefix code for symbols with weights, which rise, none over ``most``; the weights are flattened until that holds."""
    n, least, never = len(weight), 1, 1 << 62
    if n <= 1:
        return [1] * n
    while True:
        # leaves and joined nodes both come in order of weight, so the two lightest are at the heads of two queues
        leaves, heavy, parent, leaf, node = [*weight, never], [never] * n, [0] * (2 * n - 1), 0, n
        for new in range(n, 2 * n - 1):
            if (x := leaves[leaf]) <= (y := heavy[node - n]):
                parent[leaf], leaf, total = new, leaf + 1, x
            else:
                parent[node], node, total = new, node + 1, y
            if (x := leaves[leaf]) <= (y := heavy[node - n]):
                parent[leaf], leaf, total = new, leaf + 1, total + x
            else:
                parent[node], node, total = new, node + 1, total + y
            heavy[new - n] = total
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= most:
            return depth[:n]
        least *= 2  # in the end all weights are equal, and the code as short as it can be
        weight = [max(w, least) for w in weight]


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of a prefix code for symbols with counts, none over ``most``."""
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")]
    out = np.zeros(len(counts), np.int64)
    out[used] = depths_of(counts[used].tolist(), most)
    return out


@functools.cache
def _codes_of(lengths: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    return {s: (reversed_bits(c, n), n) for n, c, s in canonical(lengths)}


def _canonical_bits(used: list[int], sizes: list[int]) -> dict[int, tuple[int, int]]:
    """(bits as written, length) of the canonical code of the used symbols."""
    out, code, last = {}, 0, 0
    for n, s in sorted((sizes[s], s) for s in used):
        code <<= n - last
        out[s] = _REVERSED_BY[n][code], n
        code, last = code + 1, n
    return out


class Writer:
    """Writes bits from the lowest on."""

    def __init__(self):
        self.word = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.word |= value << self.size
        self.size += n

    def only(self, symbol: int) -> dict[int, tuple[int, int]]:
        """Writes a code of one symbol, which then takes no bits."""
        self.put(1 | int(symbol > 1) << 2, 3)
        self.put(symbol, 8 if symbol > 1 else 1)
        return {symbol: (0, 0)}

    def code(self, lengths) -> dict[int, tuple[int, int]]:
        """Writes a prefix code; returns (bits, length) by symbol."""
        used = np.flatnonzero(lengths).tolist()
        if len(used) <= 1 and (not used or used[0] < 256):
            return self.only(used[0] if used else 0)
        if len(used) == 1:  # a symbol past 255 needs a whole code; another takes its second half
            lengths = list(lengths)
            lengths[0] = lengths[used[0]] = 1
            used = [0, used[0]]
        self.put(0, 1)
        # lengths 0 .. 11 and the two runs of zeros, each in 4 bits; fewer lengths leave the code complete with fillers
        first = [0] * 19
        for s in [*range(14), 17, 18]:
            first[s] = 4
        self.put(15, 4)
        for s in LENGTH_ORDER:
            self.put(first[s], 3)
        coded = _codes_of(tuple(first))
        tokens, at, last = [], 0, used[-1] + 1
        sizes = [int(n) for n in lengths[:last]]
        for s in used:
            n = s - at
            while n >= 3:
                k = min(n, 138)
                tokens.append((18, k - 11, 7) if k >= 11 else (17, k - 3, 3))
                n -= k
            tokens += [(0, 0, 0)] * n
            tokens.append((sizes[s], 0, 0))
            at = s + 1
        if last < len(lengths):
            size = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
            self.put(1, 1)
            self.put((size - 2) // 2, 3)
            self.put(len(tokens) - 2, size)
        else:
            self.put(0, 1)
        word = size = 0
        for s, value, extra in tokens:
            v, n = coded[s]
            word |= (v | value << n) << size
            size += n + extra
        self.put(word, size)
        return _canonical_bits(used, sizes)

    def bytes(self) -> bytes:
        return self.word.to_bytes(-(-self.size // 8), "little")


def value_prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    return 2 * high + (v >> high - 1 & 1), v & (1 << high - 1) - 1, high - 1


def write_pixels(w: Writer, pixels: np.ndarray, top: bool, cache_bits: int = 0, copies: bool = False, tile_bits: int = 0) -> None:
    """Writes an entropy-coded image: literals, colour cache hits, and copies of earlier runs of pixels if asked for."""
    height, width = pixels.shape
    flat = [int(p) for p in pixels.reshape(-1)]
    symbols, at, cache, last = [], 0, [0] * (1 << cache_bits), {}
    slot = lambda p: (CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(flat):
        n = 0
        if copies and (back := last.get(tuple(flat[at:at + 3]))) is not None:
            while at + n < len(flat) and n < 4096 and flat[back + n] == flat[at + n]:
                n += 1
        if n >= 3:
            d = at - back
            short = next((i + 1 for i, (x, y) in enumerate(SHORT) if max(1, x + y * width) == d), d + 120)
            symbols.append((at, "copy", n, short))
        elif cache_bits and cache[slot(flat[at])] == flat[at] and at:
            symbols.append((at, "cache", slot(flat[at]), 0))
            n = 1
        else:
            symbols.append((at, "pixel", flat[at], 0))
            n = 1
        for k in range(at, at + n):
            if cache_bits:
                cache[slot(flat[k])] = flat[k]
            if copies and k + 3 <= len(flat):
                last[tuple(flat[k:k + 3])] = k
        at += n
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups, of = 1, lambda at: 0
    if top:
        w.put(int(tile_bits > 0), 1)
        if tile_bits:
            across, down = (width + (1 << tile_bits) - 1) >> tile_bits, (height + (1 << tile_bits) - 1) >> tile_bits
            groups = 2
            w.put(tile_bits - 2, 3)
            write_pixels(w, (np.indices((down, across)).sum(0) % 2 << 8).astype(np.uint32), False)
            of = lambda at: ((at // width >> tile_bits) + (at % width >> tile_bits)) % 2
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    for at, kind, a, b in symbols:
        c = counts[of(at)]
        if kind == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                c[k][a >> s & 0xFF] += 1
        elif kind == "cache":
            c[0][280 + a] += 1
        else:
            c[0][256 + value_prefix(a)[0]] += 1
            c[4][value_prefix(b)[0]] += 1
    codes = [[w.code(code_lengths(c, SPAN)) for c in g] for g in counts]
    for at, kind, a, b in symbols:
        g = codes[of(at)]
        if kind == "pixel":
            for k, s in enumerate((8, 16, 0, 24)):
                w.put(*g[k][a >> s & 0xFF])
        elif kind == "cache":
            w.put(*g[0][280 + a])
        else:
            for code, first, value in ((g[0], 256, a), (g[4], 0, b)):
                s, extra, n = value_prefix(value)
                w.put(*code[first + s])
                w.put(extra, n)


def _head(w: Writer, width: int, height: int, alpha: int = 0) -> None:
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        w.put(v, n)


def encode_vp8l(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, copies: bool = False, tile_bits: int = 0, mode: int = 11) -> bytes:
    """A VP8L stream of [height, width] pixels, with the transforms in the order in which the decoder reads them."""
    w, (height, width) = Writer(), pixels.shape
    _head(w, width, height, 1)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = 2
            across, down = (pixels.shape[1] + 3) >> b, (height + 3) >> b
            w.put(b - 2, 3)
            if kind == PREDICTOR:
                image = ((np.arange(across * down).reshape(down, across) + mode) % 14 << 8).astype(np.uint32)
                pixels = unpredict(pixels, image >> 8 & 0xF, b, -1)
            else:
                image = (np.arange(across * down).reshape(down, across) * 2654435761 & 0xFFFFFF).astype(np.uint32)
                pixels = cross_colour(pixels, image, b, -1)
            write_pixels(w, image, False)
        elif kind == SUBTRACT_GREEN:
            pixels = from_green(pixels, -1)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette holds at most 256 colours")
            index = index.reshape(pixels.shape).astype(np.uint32)
            w.put(len(colours) - 1, 8)
            c = channels(colours)
            write_pixels(w, joined(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)))[None, :], False)
            if shift := palette_bits(len(colours)):
                per = 1 << shift
                index = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(height, -1, per)
                index = (index << (np.arange(per, dtype=np.uint32) * (8 >> shift))).sum(-1, dtype=np.uint32)
            pixels = index << 8
    w.put(0, 1)
    write_pixels(w, pixels, True, cache_bits, copies, tile_bits)
    return w.bytes()


def riff(stream: bytes) -> bytes:
    """A WebP file of one lossless stream."""
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


#: Bytes that a copy saves at least, the most it copies, and about the bits that the code of distances takes.
LEAST, MOST, CODE_BITS = 6, 4096, 170
#: Steps of eight bytes in which all copies are made longer together, and samples of images that are encoded together.
STEPS, TOGETHER = 8, 1 << 16


def find_copies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance) of copies of LEAST values or more in images that stand behind each other in ``data``, in order
    and without overlaps. Each is of the latest place before it, in its image, at which the same LEAST values begin."""
    raw = data.tobytes() + b"\0" * (LEAST + 8 * STEPS + 8)
    words = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each byte on
    size, first = np.maximum(ends - starts - LEAST + 1, 0), np.repeat(starts, ends - starts)
    keys = words[:len(data)] << np.uint64(64 - 8 * LEAST) | (np.arange(len(data)) - first).view(np.uint64)  # places take the lower 16 bits
    before = np.full(len(data), -1, np.int64)
    for a, n in zip(starts.tolist(), size.tolist()):
        part = keys[a:a + n]
        part.sort()
        at = (part & np.uint64(0xFFFF)).view(np.int64)
        part >>= np.uint64(16)
        same = np.flatnonzero(part[1:] == part[:-1])
        before[a + at[same + 1]] = a + at[same]
    has = before >= 0
    places = np.flatnonzero(has)
    froms = before[places]
    length, live = np.full(len(places), LEAST, np.int64), np.arange(len(places))
    for step in range(LEAST, LEAST + 8 * STEPS, 8):
        differ = words[places[live] + step] ^ words[froms[live] + step]
        length[live] += np.bitwise_count(differ - np.uint64(1) & ~differ) >> 3
        live = live[differ == 0]
    most = np.minimum(MOST, np.repeat(ends, ends - starts)[places] - places)
    length = np.minimum(length, most)
    later = np.cumsum(np.append(0, has))  # the first place with a copy from each place on
    jump = later[places + length]
    jump[live] = -1  # these may be longer; only those that are taken are followed to their end
    jump, taken, k = jump.tolist(), [], 0
    while k < len(jump):
        taken.append(k)
        if jump[k] < 0:
            i, j, n, end = int(places[k]), int(froms[k]), int(length[k]), int(most[k])
            while n < end and raw[j + n] == raw[i + n]:
                n += 1
            length[k] = n
            k = int(later[i + n])
        else:
            k = jump[k]
    return places[taken], length[taken], (places - froms)[taken]


@functools.cache
def _prefixes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_prefixed`` gives for each length or distance of an image of samples."""
    v = np.arange(-1, WIDTH * HEIGHT + 120)
    high = np.frexp(np.maximum(v, 1).astype(float))[1] - 1
    small, less = v < 4, np.maximum(high - 1, 0)
    return np.where(small, v, 2 * high + (v >> less & 1)), np.where(small, 0, v & (1 << less) - 1), np.where(small, 0, less)


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of lengths or distances."""
    return tuple(x[values] for x in _prefixes())


@functools.cache
def _short_codes() -> np.ndarray:
    """The code of each distance in an image of samples of which 1, 2, 4 or 8 share a pixel: the smallest short one if it has one."""
    out = np.tile(np.arange(WIDTH * HEIGHT) + 120, (4, 1))
    for shared, row in enumerate(out):
        for i, (x, y) in reversed([*enumerate(SHORT)]):
            row[max(1, x + y * (WIDTH >> shared))] = i + 1
    return out


@functools.cache
def _weights() -> np.ndarray:
    """n * log2(n) by n, in 65,536ths, so that sums do not depend on their order."""
    n = np.arange(2 * WIDTH * HEIGHT + 1, dtype=float)
    return np.rint(n * np.log2(np.maximum(n, 1)) * 65536).astype(np.int64)


def _bits_of(counts: np.ndarray) -> np.ndarray:
    """About the bits, in 65,536ths, that prefix codes take for symbols with the counts of each row: their entropy."""
    return _weights()[counts.sum(1)] - _weights()[counts].sum(1)


@functools.cache
def _runs() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bits, their number, code lengths that they write) of so many zeros among code lengths, and the bits of each length; every
    code length, and both kinds of runs, have a code of 4 bits."""
    coded = canonical(_FOUR)
    code = {s: reversed_bits(c, n) for n, c, s in coded}
    rows = []
    for n in range(280):
        word = size = tokens = 0
        while n:
            k = min(n, 138) if n >= 3 else 1
            s, more, extra = (18, k - 11, 7) if k >= 11 else (17, k - 3, 3) if k >= 3 else (0, 0, 0)
            word |= (code[s] | more << 4) << size
            size, tokens, n = size + 4 + extra, tokens + 1, n - k
        rows.append((word, size, tokens))
    return *np.array(rows, np.int64).T, np.array([code[s] for s in range(14)], np.int64)


_FOUR = [4] * 14 + [0, 0, 0, 4, 4]
#: What stands before code lengths: a whole code, and the lengths of their own code.
_BEFORE = sum(v << at for at, v in [(1, 15), *((5 + 3 * i, _FOUR[s]) for i, s in enumerate(LENGTH_ORDER))])


def _lengths_of(counts: np.ndarray) -> np.ndarray:
    """``code_lengths`` of each row, none over SPAN."""
    row, symbol = np.nonzero(counts)
    count = counts[row, symbol]
    order = np.argsort(row << 16 | count, kind="stable")
    ends, weight, depths, a = np.cumsum(np.bincount(row, minlength=len(counts))).tolist(), count[order].tolist(), [], 0
    for b in ends:
        depths += depths_of(weight[a:b], SPAN)
        a = b
    out = np.zeros(counts.shape, np.int64)
    out[row[order], symbol[order]] = depths
    return out


def _coded(lengths: np.ndarray):
    """Of a prefix code for each row of ``lengths``: bits and their number by symbol (none where a row has one symbol), and what
    writes the codes, as (row, bits, their number)."""
    n, size = lengths.shape
    row, symbol = np.nonzero(lengths)
    used = np.bincount(row, minlength=n)
    one = used == 1
    only = np.zeros(n, np.int64)
    only[row[one[row]]] = symbol[one[row]]
    many = used > 1
    row, symbol = row[many[row]], symbol[many[row]]
    length = lengths[row, symbol]
    value, bits = np.zeros(lengths.shape, np.int64), np.zeros(lengths.shape, np.int64)
    order = np.argsort(row << 4 | length, kind="stable")
    step = 1 << (SPAN - length[order])
    value[row[order], symbol[order]] = _REVERSED[np.cumsum(step) - step & (1 << SPAN) - 1]  # a row's steps fill its code
    bits[row, symbol] = length
    first = np.diff(row, prepend=-1) > 0
    gap = symbol - np.where(first, -1, np.roll(symbol, 1)) - 1
    run, run_bits, run_tokens, token = _runs()
    tokens = np.bincount(row, run_tokens[gap] + 1, n).astype(np.int64)
    last = np.zeros(n, np.int64)
    last[row] = symbol  # the largest comes last
    wide = np.maximum(2, np.frexp(np.maximum(tokens - 2, 0).astype(float))[1] + 1 & ~1)
    told = np.where(last + 1 < size, 1 | (wide - 2) // 2 << 1 | tokens - 2 << 4, 0)
    whole = [np.where(many, _BEFORE & (1 << 31) - 1, 0), np.where(many, _BEFORE >> 31, 0), np.where(many, told, 1 | (only > 1) << 2 | only << 3)]
    whole_bits = [np.where(many, 31, 0), np.where(many, 31, 0), np.where(many, np.where(last + 1 < size, 4 + wide, 1), np.where(only > 1, 11, 4))]
    rows = np.concatenate([np.repeat(np.arange(n), 3), row])
    written = np.concatenate([np.stack(whole, 1).reshape(-1), run[gap] | token[length] << run_bits[gap]])
    sizes = np.concatenate([np.stack(whole_bits, 1).reshape(-1), run_bits[gap] + 4])
    order = np.argsort(rows, kind="stable")
    return value, bits, (rows[order], written[order], sizes[order])


def _packed(n: int, parts) -> list[bytes]:
    """The bits of ``n`` streams: of each part (row, bits, their number; by row) those of the row, part behind part."""
    sizes = [np.bincount(row, size, n).astype(np.int64) for row, _, size in parts]
    total = sum(sizes)
    first = np.cumsum((total + 15) // 16) - (total + 15) // 16
    at, places = first * 16, []
    for (row, _, size), whole in zip(parts, sizes):
        before = np.cumsum(whole) - whole
        places.append((at - before)[row] + np.cumsum(size) - size)
        at = at + whole
    place, value = np.concatenate(places), np.concatenate([v for _, v, _ in parts])
    value = value << (place & 15)
    place >>= 4
    words = np.zeros(int(first[-1] + (total[-1] + 15) // 16) + 4)
    # every bit is set at most once, so sums are unions
    for shift in range(4):
        if shift > 1:
            more = np.flatnonzero(value >> 16 * shift)
            place, value = place[more], value[more] if shift < 3 else value[more]
        words += np.bincount(place + shift, value >> 16 * shift & 0xFFFF, len(words))
    raw = words.astype("<u2").tobytes()
    return [raw[2 * a:2 * a + b] for a, b in zip(first.tolist(), ((total + 7) // 8).tolist())]


def encode_green(images: list[tuple[np.ndarray, int, np.ndarray | None]]) -> list[bytes]:
    """VP8L streams of images of green values; each image has rows of WIDTH samples, of which 2 ** ``shared`` share a value, and
    maybe a palette, which has the samples that they stand for. Values are literals, or copies of earlier ones where these take
    fewer bits. The images take each step together."""
    n, heads = len(images), []
    for data, shared, palette in images:
        w = Writer()
        _head(w, WIDTH, len(data) // (WIDTH >> shared))
        if palette is not None:
            w.put(1, 1)
            w.put(PALETTE, 2)
            w.put(len(palette) - 1, 8)
            colours = channels(palette.astype(np.uint32) << 8 | np.uint32(0xFF000000))
            write_pixels(w, joined(np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.int64)))[None, :], False)
        w.put(0, 3)  # no further transform, no cache, one group
        heads.append(w)
    data, ends = np.concatenate([d for d, _, _ in images]), np.cumsum([len(d) for d, _, _ in images])
    starts = np.append(0, ends[:-1])
    image = np.repeat(np.arange(n), ends - starts)
    at, size, back = find_copies(data, starts, ends)
    which = image[at]
    n_sym, n_more, n_bits = _prefixed(size)
    d_sym, d_more, d_bits = _prefixed(_short_codes()[np.array([s for _, s, _ in images])[which], back])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[at] = 1
    edge[at + size] -= 1
    literal = np.cumsum(edge[:-1], dtype=np.int8) == 0
    slot = image * 280 + data
    counts = np.bincount(slot, minlength=280 * n).reshape(n, 280)
    both = np.bincount(np.concatenate([slot[literal], which * 280 + 256 + n_sym]), minlength=280 * n).reshape(n, 280)
    far = np.bincount(which * 40 + d_sym, minlength=40 * n).reshape(n, 40)
    extra = np.bincount(which, n_bits + d_bits, n).astype(np.int64) + CODE_BITS
    copied = (np.bincount(which, minlength=n) > 0) & (_bits_of(both) + _bits_of(far) + extra * 65536 < _bits_of(counts))
    value, bits, green = _coded(_lengths_of(np.where(copied[:, None], both, counts)))
    d_value, d_size, distance = _coded(_lengths_of(np.where(copied[:, None], far, 0)))
    kept = copied[which]
    at, which, n_sym, n_more, n_bits, d_sym, d_more, d_bits = (x[kept] for x in (at, which, n_sym, n_more, n_bits, d_sym, d_more, d_bits))
    literal |= ~copied[image]
    literal[at] = True  # a copy stands where it begins
    where = np.flatnonzero(literal)
    place = np.cumsum(literal)[at] - 1
    slot = slot[where]
    v, size = value.reshape(-1)[slot], bits.reshape(-1)[slot]
    n_size = bits[which, 256 + n_sym]
    v[place] = value[which, 256 + n_sym] | n_more << n_size | (d_value[which, d_sym] | d_more << d_size[which, d_sym]) << n_size + n_bits
    size[place] = n_size + n_bits + d_size[which, d_sym] + d_bits
    head = [(i, w.word >> k & 0xFFFFFFFF, min(32, w.size - k)) for i, w in enumerate(heads) for k in range(0, w.size, 32)]
    constants = Writer()
    for constant in (0, 0, 255):
        constants.only(constant)
    every = np.arange(n)
    return _packed(n, [np.array(head, np.int64).T, green, (every, np.full(n, constants.word), np.full(n, constants.size)), distance, (image[where], v, size)])


def _image(data: np.ndarray) -> tuple[np.ndarray, int, np.ndarray | None]:
    """An image of samples as ``encode_green`` takes it; at most 16 different ones get a palette, under which some share a value."""
    palette = np.flatnonzero(np.bincount(data, minlength=256)) if len(set(data[:WIDTH].tolist())) <= 16 else []
    if not 0 < len(palette) <= 16:
        return data, 0, None
    shared = palette_bits(len(palette))
    index = np.searchsorted(palette, data).reshape(-1, 1 << shared) << (np.arange(1 << shared) * (8 >> shared))
    return index.sum(-1).astype(np.uint8), shared, palette


def encode_many(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """For each payload WebP files, behind each other, that hold its bytes as the green samples of rows of WIDTH pixels, HEIGHT
    rows at most.

    The other channels are constant and take no bits. An image of at most 16 different bytes gets a palette, under which
    two to eight pixels share one; back-references are written where they make the image smaller. Images are encoded together
    up to TOGETHER samples; what an image becomes does not depend on the others.
    """
    images, files, count, held = [], [], [], 0
    for payload in payloads:
        count.append(0)
        for first in range(0, len(payload), WIDTH * HEIGHT):
            images.append(_image(np.frombuffer(payload, np.uint8, min(WIDTH * HEIGHT, len(payload) - first), first)))
            count[-1] += 1
            held += len(images[-1][0])
            if held >= TOGETHER:
                files += map(riff, encode_green(images))
                images, held = [], 0
        if not images:
            yield from _by_payload(files, count)
            files, count = [], []
    if images:
        files += map(riff, encode_green(images))
    yield from _by_payload(files, count)


def _by_payload(files: list[bytes], count: list[int]) -> Iterator[bytes]:
    files = iter(files)
    for n in count:
        yield b"".join(itertools.islice(files, n))


def encode_samples(payload: bytes) -> bytes:
    """``encode_many`` of one payload."""
    return next(encode_many([payload]))
