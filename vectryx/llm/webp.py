"""Media columns: lossless WebP, written and read without an image library.

A payload is stored as rows of 64 pixels, a pixel's red, green and blue being three of its bytes; a long one as several
images in a row. The writer weighs by the entropies of what they leave which transforms an image gets: none, palette
(several samples to a pixel where there are 16 colours or fewer), subtract green, or predictor and cross-colour. Then
come back-references to where three pixels were last seen, a colour cache where its hits pay for its codes, and prefix
codes by Huffman's method.

The reader takes any lossless stream: simple and normal prefix codes, entropy images, back-references with the plane of
distances, the colour cache, and the four transforms. Headers and the small images inside them are read one by one; the
prefix codes and the pixels of all images of a batch are read side by side, a symbol of each at a time, so that the cost of
a step is shared.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, texts

#: Bytes and pixels of a row, and the most rows the writer gives an image (the format allows 16384).
WIDTH, PIXELS, MOST_ROWS = 192, 64, 32
#: Code lengths: the format's limit is 15, and 7 for the code of the lengths; shorter ones keep the reader's tables small.
MOST_BITS, MOST_LENGTH_BITS = 12, 7
LEAST_MATCH = 3
#: So many bytes of samples are written or read side by side, which bounds memory whatever a batch holds.
GROUP = 4 << 20
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def _plane() -> list[tuple[int, int]]:
    """The 120 short distances as (dx, dy), nearest first as the format lists them."""
    text = (
        "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 "
        "4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 "
        "8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
    )
    return [tuple(map(int, x.split(","))) for x in text.split()]


_PLANE = _plane()


class Bits:
    """Reads least significant bits first; past the end come zeros."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        p = self.at
        self.at = p + n
        return int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        p = self.at
        return int.from_bytes(self.data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7) & ((1 << n) - 1)


def _order(key: np.ndarray) -> np.ndarray:
    """A stable order, by sorting keys with their places; both together have 63 bits."""
    n = len(key).bit_length()
    return np.sort(key << n | np.arange(len(key))) & ((1 << n) - 1)


@lru_cache
def _reversed(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits in reverse."""
    x = np.zeros(1, np.int64)
    for _ in range(n):
        x = np.concatenate([2 * x, 2 * x + 1])
    return x


def code_tables(lengths: list[bytes | bytearray], shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tables of codes, each given as lengths by symbol, one after another; where each begins, and how many entries it has.

    A table is entered by the next bits (as many as its code's longest word has) and holds length << 32 | symbol << its code's
    shift. Codes are canonical. A lone symbol takes no bits, so its table has one entry; no symbol at all is like a lone 0.
    """
    n, sizes = len(lengths), np.array([len(x) for x in lengths])
    flat, begin = np.frombuffer(b"".join(lengths), np.uint8), np.cumsum(sizes) - sizes
    used = np.flatnonzero(flat != 0)
    until = np.searchsorted(used, begin + sizes)
    count = np.diff(until, prepend=0)
    owner, own = np.repeat(np.arange(n), count), flat[used].astype(np.int64)
    symbol = used - begin[owner] << shifts[owner]
    most = np.zeros(n, np.int64)
    most[count > 0] = np.maximum.reduceat(own, (until - count)[count > 0]) if len(own) else 0
    most[count < 2] = 0
    order = _order(owner << 4 | own)  # the owner stays, the shorter words come first
    symbol, own = symbol[order], own[order]
    lone = count[owner] == 1
    spans = np.where(lone, 1, 1 << np.maximum(most[owner] - own, 0))
    entries = 1 << most
    if (np.bincount(owner, spans, n).astype(np.int64) != np.where(count > 0, entries, 0)).any():
        raise ValueError("the code isn't complete")
    starts = np.cumsum(entries) - entries
    none = np.flatnonzero(count == 0)
    by_first_bit = np.repeat(np.insert(np.where(lone, symbol, own << 32 | symbol), until[none], 0), np.insert(spans, until[none], 1))
    table = np.empty_like(by_first_bit)
    for bits in np.unique(most).tolist():
        at = starts[most == bits][:, None]
        table[at + np.arange(1 << bits)] = by_first_bit[at + _reversed(bits)]
    return table, starts, entries


def _small_table(lengths: list[int]) -> tuple[list[int], int]:
    """The same for the code of the code lengths, of 7 bits at most: the table, and how many bits it goes by."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) < 2:
        return [used[0][1] if used else 0], 0
    most, table = used[-1][0], []
    for n, s in used:
        table += [n << 16 | s] * (1 << most - n)
    if len(table) != 1 << most:
        raise ValueError("the code isn't complete")
    return [table[at] for at in _reversed(most).tolist()], most


def _read_code(bits: Bits, size: int) -> bytearray:
    """Lengths by symbol of the next prefix code."""
    lengths = bytearray(size)
    if bits.take(1):
        count = bits.take(1) + 1
        first = bits.take(8 if bits.take(1) else 1)
        second = bits.take(8) if count == 2 else first
        if max(first, second) >= size:
            raise ValueError("a symbol beyond the alphabet")
        lengths[first] = lengths[second] = 1
        return lengths
    of_lengths = [0] * 19
    for i in range(4 + bits.take(4)):
        of_lengths[_ORDER[i]] = bits.take(3)
    table, most = _small_table(of_lengths)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    mask, data, p = (1 << most) - 1, bits.data, bits.at
    at, previous = 0, 8
    while at < size and left:
        left -= 1
        window = int.from_bytes(data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7)
        x = table[window & mask]
        n = x >> 16
        s = x & 0xFFFF
        p += n
        if s < 16:
            lengths[at] = s
            at += 1
            previous = s or previous
            continue
        base, more = ((3, 2), (3, 3), (11, 7))[s - 16]
        repeat = base + (window >> n & ((1 << more) - 1))
        p += more
        if at + repeat > size:
            raise ValueError("code lengths run over")
        if s == 16:
            lengths[at : at + repeat] = bytes([previous]) * repeat
        at += repeat
    bits.at = p
    return lengths


def _extra(bits: Bits, symbol: int) -> int:
    """Length or distance of a prefix symbol, 1 at least."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.take(n) + 1


def _div(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


@dataclass
class Image:
    """What comes before an image's pixels: codes by group (green, red, blue, alpha, distance) as lengths, and where the pixels' bits begin."""

    bits: Bits
    width: int
    height: int
    cache_bits: int
    groups: list[list[bytes | bytearray]]
    tiles: np.ndarray | None = None
    tile_bits: int = 0
    undo: list[tuple] = field(default_factory=list)


def _sizes_of_codes(cache_bits: int) -> tuple[int, ...]:
    return (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)


def _image_head(bits: Bits, width: int, height: int, top: bool) -> Image:
    """All before the codes; these too but where an image is the top one and has one group of them."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    tile_bits, tiles = 0, None
    if top and bits.take(1):
        tile_bits = bits.take(3) + 2
        tiles = (_small_image(bits, _div(width, tile_bits), _div(height, tile_bits)) >> np.uint32(8)) & np.uint32(0xFFFF)
    if top and tiles is None:
        return Image(bits, width, height, cache_bits, [])
    sizes = _sizes_of_codes(cache_bits)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(1 + (int(tiles.max()) if tiles is not None else 0))]
    return Image(bits, width, height, cache_bits, groups, tiles, tile_bits)


def _small_image(bits: Bits, width: int, height: int) -> np.ndarray:
    """ARGB of an image inside a header, read pixel by pixel."""
    head = _image_head(bits, width, height, False)
    every, starts, entries = code_tables(head.groups[0], _SHIFTS)
    (greens, g), (reds, r), (blues, b), (alphas, a), (distances, d) = ((every[at : at + n].tolist(), n - 1) for at, n in zip(starts.tolist(), entries.tolist()))
    total, shift = width * height, 32 - head.cache_bits
    out, cache = [0] * total, [0] * (1 << head.cache_bits)
    at = cached = 0
    while at < total:
        p = bits.at
        window = int.from_bytes(bits.data[p >> 3 : (p >> 3) + 9], "little") >> (p & 7)  # four codes of 15 bits
        x = greens[window & g]
        s = (x & _SYMBOL) >> 8
        if s < 256:
            y = reds[(window := window >> (x >> 32)) & r]
            z = blues[(window := window >> (y >> 32)) & b]
            x += y + z + alphas[window >> (z >> 32) & a]
            out[at] = x & _SYMBOL
            bits.at = p + (x >> 32)
            at += 1
            continue
        bits.at = p + (x >> 32)
        if s < 280:
            length = _extra(bits, s - 256)
            x = distances[bits.peek(15) & d]
            bits.at += x >> 32
            back = _back(_extra(bits, x & _SYMBOL), width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - back]
            at += length
        else:
            while cached < at:
                cache[(out[cached] * _HASH & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _back(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = _PLANE[code - 1]
    return max(1, dx + dy * width)


_HASH = 0x1E35A7BD


def _start(data: bytes) -> Image:
    """What comes before the codes of a VP8L chunk."""
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (0, 1):
            n = bits.take(3) + 2
            tiles = _small_image(bits, _div(inner, n), _div(height, n)).reshape(_div(height, n), -1)
            undo.append((kind, tiles, n, inner))
        elif kind == 2:
            undo.append((kind, None, 0, inner))
        else:
            n = bits.take(8) + 1
            deltas = _channels(_small_image(bits, n, 1)).reshape(n, 4)
            palette = np.ascontiguousarray(np.cumsum(deltas, 0, dtype=np.uint8)).view("<u4")[:, 0]
            undo.append((kind, palette, 0, inner))
            inner = _div(inner, 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0)
    image = _image_head(bits, inner, height, True)
    image.undo = undo
    return image


def read_heads(chunks: list[bytes]) -> list[Image]:
    """All that comes before the pixels of VP8L chunks."""
    images = [_start(c) for c in chunks]
    for part in _grouped([m for m in images if not m.groups], lambda m: 3 * m.width * m.height):
        _read_codes(part)
    return images


def _joined(images: list[Image], spare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The eight bytes from each byte on of all images' data, where each image's reader stands and where its data ends, in bits."""
    buffer = np.frombuffer(b"".join(m.bits.data for m in images) + bytes(spare), np.uint8)
    words = np.ndarray((len(buffer) - 7,), "<i8", buffer.data, strides=(1,))  # 57 bits at least are used
    ends = 8 * np.cumsum(np.array([len(m.bits.data) for m in images], np.int64))
    return words, np.r_[0, ends[:-1]] + np.array([m.bits.at for m in images], np.int64), ends


#: Of a symbol of the code of lengths: the length it stands for (16: the last one), how many extra bits follow, how many lengths at least.
_LENGTH_OF = np.array([*range(17), 0, 0], np.int64)
_MORE_LENGTH_BITS = np.array([0] * 16 + [2, 3, 7], np.int64)
_LEAST_REPEAT = np.array([1] * 16 + [3, 3, 11], np.int64)


def _read_codes(images: list[Image]) -> None:
    """Reads the five codes of each image, side by side: one symbol of the code of lengths in each step."""
    sizes = np.array([_sizes_of_codes(m.cache_bits) for m in images], np.int64).T
    begin = np.zeros(5 * len(images) + 1, np.int64)  # lengths of all codes one after another, image by image
    np.cumsum(sizes.T.reshape(-1), out=begin[1:])
    lengths = np.zeros(int(begin[-1]), np.uint8)
    # zeros beyond the end for all that a reader gone astray may read in five codes
    words, p, ends = _joined(images, 16 << 10)
    origin = p - np.array([m.bits.at for m in images], np.int64)
    for k in range(5):
        to, size = begin[k:-1:5], sizes[k]
        w = words[p >> 3] >> (p & 7)
        simple = np.flatnonzero(w & 1)
        own = w[simple]
        wide = np.where(own >> 2 & 1, 8, 1)
        first, second, two = own >> 3 & ((1 << wide) - 1), own >> (3 + wide) & 255, own >> 1 & 1
        if (np.maximum(first, second * two) >= size[simple]).any():
            raise ValueError("a symbol beyond the alphabet")
        lengths[to[simple] + first] = 1
        lengths[(to[simple] + second)[two > 0]] = 1
        p[simple] += 3 + wide + 8 * two
        normal = np.flatnonzero(w & 1 == 0)
        if len(normal):
            p[normal] = _read_lengths(words, p[normal] + 1, to[normal], size[normal], lengths)
    if (p > ends).any():
        raise ValueError("the stream ends early")
    for m, moved in zip(images, (p - origin).tolist()):
        m.bits.at = moved
    flat, cuts = lengths.tobytes(), begin.tolist()
    for i, m in enumerate(images):
        m.groups = [[flat[a:b] for a, b in zip(cuts[5 * i : 5 * i + 5], cuts[5 * i + 1 : 5 * i + 6])]]


def _read_lengths(words: np.ndarray, p: np.ndarray, to: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Reads normal codes from p on, each one's lengths by symbol into lengths from its place `to` on; where the readers stand then."""
    n = len(p)
    w = words[p >> 3] >> (p & 7)
    count = 4 + (w & 15)
    p = p + 4
    named = (words[p >> 3] >> (p & 7))[:, None] >> (3 * np.arange(19)) & 7
    own = np.zeros((n, 19), np.int64)
    own[:, _ORDER] = np.where(np.arange(19) < count[:, None], named, 0)
    p = p + 3 * count
    w = words[p >> 3] >> (p & 7)
    width = 2 + 2 * (w >> 1 & 7)
    left = np.where(w & 1, 2 + (w >> 4 & ((1 << width) - 1)), size)
    p = p + np.where(w & 1, 4 + width, 1)
    # tables of seven bits that hold bits << 5 | symbol
    used = (own > 0).sum(1)
    own[used == 0, 0] = 1
    lone = used < 2
    row, symbol = np.nonzero(own)
    own = own[row, symbol]
    order = _order(row << 3 | own)
    symbol, own = symbol[order], own[order]
    spans = np.where(lone[row], 128, 128 >> own)
    if (np.bincount(row, spans, n) != 128).any():
        raise ValueError("the code isn't complete")
    table = np.repeat(np.where(lone[row], symbol, own << 5 | symbol), spans).reshape(n, 128)[:, _reversed(7)].reshape(-1)
    stand, lane, at, end, rows, previous = p.copy(), np.arange(n), to, to + size, np.arange(n) << 7, np.full(n, 8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = 0
    while len(lane):
        step += 1
        w = words[p >> 3] >> (p & 7)
        x = table[rows + (w & 127)]
        s, taken = x & 31, x >> 5
        more = _MORE_LENGTH_BITS[s]
        repeat = _LEAST_REPEAT[s] + (w >> taken & ((1 << more) - 1))
        length = _LENGTH_OF[s]
        length = np.where(length == 16, previous, length)
        previous = np.where(length > 0, length, previous)
        found.append((at, repeat, length))
        at, p = at + repeat, p + taken + more
        over = (at >= end) | (left == step)
        if over.any():
            if (at > end).any():
                raise ValueError("code lengths run over")
            stand[lane[over]] = p[over]
            go = ~over
            p, lane, at, end, rows, previous, left = p[go], lane[go], at[go], end[go], rows[go], previous[go], left[go]
    at, repeat, length = (np.concatenate(x) for x in zip(*found))
    some = np.flatnonzero(length)
    at, repeat, length = at[some], repeat[some], length[some]
    lengths[np.repeat(at - (np.cumsum(repeat) - repeat), repeat) + np.arange(int(repeat.sum()))] = np.repeat(length, repeat)
    return stand


LITERAL, COPY, CACHED = 1, 2, 3
#: Of each prefix symbol of a length or distance: how many extra bits follow, their mask, and its value when they are 0.
_EXTRA_BITS = np.array([max(0, s - 2 >> 1) for s in range(40)], np.int64)
_EXTRA_MASK = (1 << _EXTRA_BITS) - 1
_LEAST_VALUE = np.array([s + 1 if s < 4 else (2 + (s & 1) << (s - 2 >> 1)) + 1 for s in range(40)], np.int64)


#: By code of a group: how far its symbols are shifted in an entry of its table, so that the entries of a literal add up to its ARGB.
_SHIFTS = np.array([8, 16, 0, 24, 0], np.int64)
#: Bits that tell a symbol of 256 or more in an entry of the first code, and the symbol's place in any entry.
_NO_LITERAL, _SYMBOL = 0xF0000, (1 << 32) - 1


def _read_symbols(images: list[Image], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pixel of all images how it is made (LITERAL, COPY, CACHED) and from what (ARGB, distance back, place in the cache).

    Side by side: in each step one symbol of every image that isn't read to its end. Whatever it is, a literal is read; that is
    put right for the few that are none.
    """
    totals = np.array([m.width * m.height for m in images], np.int64)
    everything, over_all = int(totals.sum()), len(images)
    # one place more, for images that are over and wait to be taken out; they read from codes of one symbol, which take no bits
    value = np.zeros(everything + 1, np.uint32)
    words, p, read_to = _joined(images, 16)
    codes = [c for m in images for g in m.groups for c in g]
    table, starts, entries = code_tables([*codes, *[b""] * 5], np.tile(_SHIFTS, len(codes) // 5 + 1))
    starts, masks = np.ascontiguousarray(starts.reshape(-1, 5).T), np.ascontiguousarray((entries - 1).reshape(-1, 5).T)
    n_groups = np.array([*(len(m.groups) for m in images), 1])
    group = np.cumsum(n_groups) - n_groups
    tiled = np.array([*(m.tiles is not None for m in images), False])
    any_tiled, wordy = bool(tiled.any()), bool((masks[3] > 0).any())
    lane = np.arange(over_all)
    #: Of each step the places of symbols that are no literals, and the symbols; and of each back-reference its place, length, code of distance and image.
    others: list[tuple[np.ndarray, ...]] = []
    copies: list[tuple[np.ndarray, ...]] = []

    def read() -> None:
        nonlocal p, lane
        at, mask, here, end = starts[:, group[:-1]], masks[:, group[:-1]], base.copy(), base + totals
        moves, over = np.ones(len(lane), np.int64), 0
        lone = table[at[3]] & _SYMBOL  # alpha where it takes no bits
        while True:
            if any_tiled:
                g = group[lane]
                for i in np.flatnonzero(tiled[lane]):
                    m, q = images[lane[i]], int(here[i] - base[lane[i]])
                    g[i] += m.tiles[((q // m.width) >> m.tile_bits) * _div(m.width, m.tile_bits) + ((q % m.width) >> m.tile_bits)]
                at, mask = starts[:, g], masks[:, g]
                lone = table[at[3]] & _SYMBOL
            w = words[p >> 3] >> (p & 7)
            t = table[at[0] + (w & mask[0])]
            rest = w >> (t >> 32)
            red = table[at[1] + (rest & mask[1])]
            rest >>= red >> 32
            argb = table[at[2] + (rest & mask[2])]
            argb += red
            argb += t
            to = p + (argb >> 32)
            if wordy:
                alpha = table[at[3] + (words[to >> 3] >> (to & 7) & mask[3])]
                to += alpha >> 32
                lone = alpha & _SYMBOL
            argb += lone
            value[here] = argb
            other = (t & _NO_LITERAL).nonzero()[0]
            if len(other):
                t = t[other]
                n, s = t >> 32, t >> 8 & 0xFFF
                to[other] = q = p[other] + n
                others.append((here[other], s))
                far = (s < 280).nonzero()[0]
                if len(far):
                    back, s, n, q = other[far], s[far] - 256, n[far], q[far]
                    rest, more = w[back] >> n, _EXTRA_BITS[s]
                    length = _LEAST_VALUE[s] + (rest & _EXTRA_MASK[s])
                    d = table[at[4][back] + (rest >> more & mask[4][back])]
                    q += more + (d >> 32)
                    d &= _SYMBOL
                    code = _LEAST_VALUE[d] + (words[q >> 3] >> (q & 7) & _EXTRA_MASK[d])
                    to[back] = q + _EXTRA_BITS[d]
                    copies.append((here[back], length, code, lane[back]))
                    here[back] += length - 1
            p = to
            here += moves
            ended = (here >= end).nonzero()[0]
            if len(ended):
                if (p[ended] > read_to[lane[ended]]).any():
                    raise ValueError("the stream ends early")
                here[ended], end[ended], moves[ended], p[ended], lane[ended] = everything, everything + 1, 0, 0, over_all
                at[:, ended], mask[:, ended] = starts[:, -1:], 0
                over += len(ended)
                if 8 * over > len(lane):
                    going = moves.nonzero()[0]
                    lane, p, here, end, moves, lone = lane[going], p[going], here[going], end[going], moves[going], lone[going]
                    at, mask, over = at[:, going], mask[:, going], 0
                    if not len(lane):
                        return

    try:
        read()
    except IndexError as e:
        raise ValueError("the stream ends early") from e
    kind, value = np.full(everything, LITERAL, np.uint8), value[:-1]
    if others:
        place, s = (np.concatenate(x) for x in zip(*others))
        place, s = place[s >= 280], s[s >= 280]
        kind[place], value[place] = CACHED, s - 280
    if copies:
        start, length, code, image = (np.concatenate(x) for x in zip(*copies))
        backs = {m.width: np.array([_back(c, m.width) for c in range(1, 121)], np.int64) for m in {m.width: m for m in images}.values()}
        width_at = {w: i for i, w in enumerate(backs)}
        near, wide = np.stack(list(backs.values())), np.array([width_at[m.width] for m in images])
        distance = np.where(code > 120, code - 120, near[wide[image], np.minimum(code, 120) - 1])
        if (distance > start - base[image]).any() or (start + length > (base + totals)[image]).any():
            raise ValueError("a back-reference leaves the image")
        places = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        kind[places], value[places] = COPY, np.repeat(distance, length)
    return kind, value


def _followed(source: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the places at lead to when each is followed to its source until that is its own."""
    to = source[at]
    while not np.array_equal(further := source[to], to):
        source[at] = to = further
    return to


def _fill_pixels(images: list[Image], kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Copies and cached colours put in: each is followed to the pixel that it repeats.

    A pixel's place in the cache is known before its colour is: a literal's from its hash, a copy's from what it copies,
    and a cached one's is what was read. What was last in that place is what a cached pixel repeats.
    """
    every = np.arange(len(value))
    source = every - np.where(kind == COPY, value, 0)
    cached = np.flatnonzero(kind == CACHED)
    if len(cached):
        totals = np.array([m.width * m.height for m in images], np.int64)
        image = np.repeat(np.arange(len(images)), totals)
        bits = np.repeat(np.array([m.cache_bits for m in images]), totals)
        place = np.where(kind == CACHED, value, value * np.uint32(_HASH) >> (32 - np.maximum(bits, 1)).astype(np.uint32)).astype(np.int64)
        copied = np.flatnonzero(kind == COPY)
        place[copied] = place[_followed(source.copy(), copied)]
        some = np.flatnonzero(bits > 0)
        slot = (image[some] << 11) | place[some]
        by_slot = _order(slot)
        order, slot = some[by_slot], slot[by_slot]
        before = np.empty(len(value), np.int64)
        before[order[1:]] = order[:-1]
        same = np.zeros(len(value), bool)
        same[order[1:]] = slot[1:] == slot[:-1]
        empty = cached[~same[cached]]  # nothing was there: transparent black
        source[cached] = before[cached]
        source[empty], value[empty] = empty, 0
    made = np.flatnonzero(source != every)
    value[made] = value[_followed(source, made)]
    return value


def decode_streams(chunks: list[bytes]) -> list[np.ndarray]:
    """ARGB (height * width, uint32) of the data of each VP8L chunk."""
    return [x for part in _grouped(read_heads(chunks), lambda m: 3 * m.width * m.height) for x in _decode_images(part)]


def _decode_images(images: list[Image]) -> list[np.ndarray]:
    totals = np.array([m.width * m.height for m in images], np.int64)
    base = np.cumsum(totals) - totals
    pixels = _fill_pixels(images, *_read_symbols(images, base))
    found = [pixels[b : b + n].reshape(m.height, m.width) for m, b, n in zip(images, base.tolist(), totals.tolist())]
    for step in range(max(len(m.undo) for m in images)):  # the last transform is undone first
        todo = [i for i, m in enumerate(images) if len(m.undo) > step]
        guessed = [i for i in todo if images[i].undo[-1 - step][0] == 0]
        if guessed:
            for i, x in zip(guessed, _unpredict([found[i] for i in guessed], [images[i].undo[-1 - step] for i in guessed])):
                found[i] = x
        for i in todo:
            kind, data, n, own = images[i].undo[-1 - step]
            if kind == 1:
                found[i] = _uncross(found[i], data, n)
            elif kind == 2:
                found[i] = _add_green(found[i], 1)
            elif kind == 3:
                found[i] = _unpalette(found[i], data, own)
    return found


def _channels(argb: np.ndarray) -> np.ndarray:
    """Last axis: blue, green, red, alpha."""
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


def _add_green(x: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(x).copy()
    c[..., 0] += sign * c[..., 1] if sign > 0 else -c[..., 1]
    c[..., 2] += c[..., 1] if sign > 0 else -c[..., 1]
    return c.view("<u4").reshape(x.shape)


_BLACK = np.array([0, 0, 0, 255], np.int16)


def _guess(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A predictor mode, over int16 arrays whose last axis are the channels; right is the neighbour above and to the right."""

    def average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) >> 1

    if mode in (0, 14, 15):
        return np.broadcast_to(_BLACK, left.shape)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return average(average(left, right), top)
    if mode in (6, 7, 8, 9):
        return average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return average(average(left, corner), average(top, right))
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = average(left, top)
    half = mean - corner
    return np.clip(mean + (np.abs(half) >> 1) * np.sign(half), 0, 255)


def _unpredict(residuals: list[np.ndarray], transforms: list[tuple]) -> list[np.ndarray]:
    """Undoes the predictor transform of several images side by side, a pixel of each at a time."""
    order = sorted(range(len(residuals)), key=lambda i: -residuals[i].size)
    sizes = np.array([residuals[i].size for i in order])
    width = np.array([residuals[i].shape[1] for i in order])
    out = np.zeros((len(order), int(sizes[0]), 4), np.int16)
    modes = np.zeros((len(order), int(sizes[0])), np.uint8)
    for j, i in enumerate(order):
        h, w = residuals[i].shape
        _, tiles, n, _ = transforms[i]
        out[j, : sizes[j]] = _channels(residuals[i]).reshape(-1, 4)
        modes[j, : sizes[j]] = np.repeat(np.repeat(tiles >> 8 & 15, 1 << n, 0), 1 << n, 1)[:h, :w].reshape(-1)
        modes[j, 1:w], modes[j, w : sizes[j] : w] = 1, 2  # the first row goes by the left, the first column by the top
        modes[j, 0] = 0
    going = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
    lanes = np.arange(len(order))
    for p in range(int(sizes[0])):
        m = going[p]
        mode, w, own = modes[:m, p], width[:m], lanes[:m]
        left = out[:m, p - 1] if p else np.zeros((m, 4), np.int16)
        top, corner, right = (out[own, np.maximum(p - w + d, 0)] for d in (0, -1, 1))
        first = int(mode[0])
        if (mode == first).all():
            guess = _guess(first, left, top, corner, right)
        else:
            guess = np.zeros((m, 4), np.int16)
            for k in np.unique(mode):
                of = np.flatnonzero(mode == k)
                guess[of] = _guess(int(k), left[of], top[of], corner[of], right[of])
        out[:m, p] = (out[:m, p] + guess) & 255
    done = out.astype(np.uint8)
    found: list = [None] * len(order)
    for j, i in enumerate(order):
        found[i] = np.ascontiguousarray(done[j, : sizes[j]]).view("<u4").reshape(residuals[i].shape)
    return found


def _tile_fields(tiles: np.ndarray, n: int, shape: tuple[int, int]) -> np.ndarray:
    """Cross-colour multipliers (green to red, green to blue, red to blue) of each pixel."""
    return np.repeat(np.repeat(_channels(tiles), 1 << n, 0), 1 << n, 1)[: shape[0], : shape[1]].view(np.int8).astype(np.int32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _uncross(x: np.ndarray, tiles: np.ndarray, tile_bits: int) -> np.ndarray:
    """Undoes the cross-colour transform."""
    c = _channels(x).copy()
    t = _tile_fields(tiles, tile_bits, x.shape)
    green = _signed(c[..., 1])
    red = (c[..., 2] + (t[..., 0] * green >> 5)) & 255
    blue = c[..., 0] + (t[..., 1] * green >> 5) + (t[..., 2] * _signed(red) >> 5)
    c[..., 2], c[..., 0] = red.astype(np.uint8), (blue & 255).astype(np.uint8)
    return c.view("<u4").reshape(x.shape)


def _unpalette(x: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Undoes the palette transform; indices past the palette are transparent black."""
    index = (x >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
    n = len(palette)
    if n <= 16:
        per = 8 if n <= 2 else 4 if n <= 4 else 2
        step = 8 // per
        parts = index[:, :, None] >> (np.arange(per, dtype=np.uint8) * step) & ((1 << step) - 1)
        index = parts.reshape(len(x), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[:n] = palette
    return full[index]


def _chunks(data: bytes) -> list[bytes]:
    """The lossless streams of one or more WebP files in a row."""
    out, at = [], 0
    while at < len(data):
        riff, size, webp = struct.unpack_from("<4sI4s", data, at)
        if riff != b"RIFF" or webp != b"WEBP":
            raise ValueError("not a WebP file")
        p, end = at + 12, at + 8 + size
        while p < end:
            kind, n = struct.unpack_from("<4sI", data, p)
            if kind == b"VP8L":
                out.append(data[p + 8 : p + 8 + n])
            p += 8 + n + (n & 1)
        at = end
    return out


def decode_all(media: list[bytes]) -> list[list[np.ndarray]]:
    """Of each of the media its images, ARGB as uint32."""
    parts = [_chunks(m) for m in media]
    found = iter(decode_streams([c for p in parts for c in p]))
    return [[next(found) for _ in p] for p in parts]


def decode(data: bytes) -> list[np.ndarray]:
    return decode_all([data])[0]


# the writer


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of each row of counts, `most` at most; 0 for what doesn't occur. Rows are merged side by side.

    Where a code would get longer, its least counts are raised (to 2, 4, ...) until it fits. A lone symbol has length 1.
    """
    out = np.zeros(counts.shape, np.uint8)
    rows, least = np.flatnonzero((counts > 0).sum(1)), 1
    while len(rows):
        own = np.where(counts[rows] > 0, np.maximum(counts[rows], least), 0)
        lengths = _merged_lengths(own)
        out[rows] = lengths
        rows, least = rows[lengths.max(1) > most], 2 * least
    return out


def _merged_lengths(counts: np.ndarray) -> np.ndarray:
    """By two queues: the symbols by count (ties by symbol), and the pairs made of the two least of either queue."""
    used = (counts > 0).sum(1)
    down = np.argsort(-used, kind="stable")
    counts, used = counts[down], used[down]
    n_rows, k = len(counts), int(used[0])
    never = np.int64(1) << 60
    ordered = np.sort(np.where(counts > 0, counts, never >> 12) << 10 | np.arange(counts.shape[1]), axis=1)[:, :k]
    symbols = ordered & 1023
    leaves = np.full((n_rows, k + 1), never)
    leaves[:, :k] = np.where(np.arange(k)[None, :] < used[:, None], ordered >> 10, never)
    pairs = np.full((n_rows, k + 1), never)
    leaf_parent, pair_parent = np.zeros((n_rows, k), np.int64), np.zeros((n_rows, k), np.int64)
    leaf, pair, lanes = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64), np.arange(n_rows)
    going = np.searchsorted(-used, -np.arange(1, k + 1), "left")  # so many rows have more symbols than this
    for t in range(k - 1):
        r = lanes[: going[t]]
        total = np.zeros(len(r), np.int64)
        for _ in range(2):
            li, pi = leaf[r], pair[r]
            a, b = leaves[r, li], pairs[r, pi]
            low = a <= b
            x, y = np.flatnonzero(low), np.flatnonzero(~low)
            leaf_parent[x, li[x]] = t
            pair_parent[y, pi[y]] = t
            leaf[x] += 1
            pair[y] += 1
            total += np.where(low, a, b)
        pairs[r, t] = total
    depth = np.zeros((n_rows, k), np.int64)
    for t in range(k - 3, -1, -1):
        r = lanes[: going[t + 1]]
        depth[r, t] = np.where(t < used[r] - 2, depth[r, pair_parent[r, t]] + 1, 0)
    lengths = np.take_along_axis(depth, leaf_parent, 1) + 1
    lengths[np.arange(k)[None, :] >= used[:, None]] = 0
    out = np.zeros(counts.shape, np.uint8)
    np.put_along_axis(out, symbols, lengths.astype(np.uint8), 1)
    back = np.zeros_like(out)
    back[down] = out
    return back


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words of each row of lengths, first bit lowest."""
    flat = lengths.reshape(-1)
    used = np.flatnonzero(flat != 0)
    row, own = used // lengths.shape[1], flat[used].astype(np.int64)
    order = _order(row << 4 | own)
    used, own = used[order], own[order]
    steps = np.int64(1) << (15 - own)
    high = np.cumsum(steps) - steps  # the word, its first bit the 15th
    first = np.searchsorted(row, np.arange(len(lengths) + 1))
    high -= np.repeat(high[first[:-1][np.diff(first) > 0]], np.diff(first)[np.diff(first) > 0])
    out = np.zeros(lengths.size, np.int64)
    out[used] = _reversed(15)[high]
    return out.reshape(lengths.shape)


Symbols = tuple[np.ndarray, np.ndarray, np.ndarray]
"""Whose (in the order of writing), values, and their numbers of bits."""


def _runs_of_lengths(lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first `sizes` code lengths of each row as (row, symbol, extra, its bits): 16 repeats the last length, 17 and 18 are runs of 0."""
    v, starts = lengths[np.arange(lengths.shape[1]) < sizes[:, None]], np.cumsum(sizes) - sizes
    differs = np.r_[True, v[1:] != v[:-1]]
    differs[starts] = True
    new = np.flatnonzero(differs)
    n, v, row = np.diff(np.r_[new, len(v)]), v[new].astype(np.int64), np.searchsorted(starts, new, "right") - 1
    zero = v == 0
    first = (~zero).astype(np.int64)  # a length itself comes before its repeats
    most = np.where(zero, 138, 6)
    whole, rest = (n - first) // most, (n - first) % most
    short = rest < 3
    pieces = first + whole + np.where(short, rest, 1)
    of = np.repeat(np.arange(len(v)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    is_whole = (nth >= first[of]) & (nth < (first + whole)[of])
    is_rest = (nth >= (first + whole)[of]) & ~short[of]
    repeat = np.where(zero, 18, 16)
    rest_symbol = np.where(zero, np.where(rest < 11, 17, 18), 16)
    rest_from = np.where(rest_symbol == 18, 11, 3)
    width = np.array([2, 3, 7])
    symbol = np.where(is_whole, repeat[of], np.where(is_rest, rest_symbol[of], v[of]))
    extra = np.where(is_whole, np.where(zero, 127, 3)[of], np.where(is_rest, (rest - rest_from)[of], 0))
    return row[of], symbol, extra, np.where(symbol >= 16, width[np.maximum(symbol, 16) - 16], 0)


def _codes_written(lengths: np.ndarray, sizes: np.ndarray) -> Symbols:
    """How codes are written, row by row: simple ones for one symbol or two, others by a code of their lengths."""
    used = (lengths > 0).sum(1)
    top = lengths.shape[1] - 1 - (lengths[:, ::-1] > 0).argmax(1)
    simple = (used == 0) | (used <= 2) & (top < 256)
    first, wide = np.where(used > 0, (lengths > 0).argmax(1), 0), 8
    bits = np.where(first > 1, wide, 1)
    value = 1 | (used == 2) << 1 | (first > 1) << 2 | first << 3
    value = np.where(used == 2, value | top << (3 + bits), value)
    s = np.flatnonzero(simple)
    parts = [(s, value[s], (3 + bits + np.where(used == 2, 8, 0))[s])]
    normal = np.flatnonzero(~simple)
    if len(normal):
        row, symbol, extra, more = _runs_of_lengths(lengths[normal], sizes[normal])
        own = code_lengths(np.bincount(row * 19 + symbol, minlength=19 * len(normal)).reshape(-1, 19), MOST_LENGTH_BITS)
        words = code_words(own)
        ordered = own[:, _ORDER].astype(np.int64)
        count = np.maximum(4, 19 - (ordered[:, ::-1] > 0).argmax(1))
        named = (ordered << (3 * np.arange(19))).sum(1)  # three bits each; what is beyond count is 0
        taken = np.where((own > 0).sum(1)[:, None] > 1, own, 0)  # a lone length takes no bits, but is named
        at = taken[row, symbol].astype(np.int64)
        parts += [(normal, (count - 4) << 1, np.full(len(normal), 5)), (normal, named, 3 * count), (normal, np.zeros(len(normal), np.int64), np.ones(len(normal), np.int64))]
        parts.append((normal[row], np.where(at > 0, words[row, symbol], 0) | extra << at, at + more))
    return _in_order(len(used), *parts)


def _small_written(images: list[np.ndarray]) -> Symbols:
    """Images inside headers: no cache, the codes, and literals."""
    n, sizes = len(images), np.array([x.size for x in images])
    of, c = np.repeat(np.arange(n), sizes), _channels(np.concatenate([x.reshape(-1) for x in images]))
    channels = [c[:, k].astype(np.int64) for k in (1, 2, 0, 3)]
    counts = np.stack([np.bincount(of * 280 + v, minlength=280 * n).reshape(n, 280) for v in channels] + [np.zeros((n, 280), np.int64)], 1)
    lengths = code_lengths(counts.reshape(5 * n, 280), 15)
    row, value, size = _codes_written(lengths, np.tile([280, 256, 256, 256, 40], n))
    words = code_words(lengths).reshape(n, 5, 280)
    lengths = np.where((lengths > 0).sum(1)[:, None] > 1, lengths, 0).reshape(n, 5, 280)
    pixel, bits = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    for k, v in enumerate(channels):
        more = lengths[of, k, v].astype(np.int64)
        pixel |= np.where(more > 0, words[of, k, v], 0) << bits
        bits += more
    return _in_order(n, (np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int64)), (row // 5, value, size), (of, pixel, bits))


def _in_order(n: int, *parts: Symbols) -> Symbols:
    """Parts one after another, for each of n that they are of; in each part they are in order."""
    counts = np.stack([np.bincount(of, minlength=n) for of, _, _ in parts])
    begin = np.cumsum(counts.T.reshape(-1)).reshape(n, -1).T - counts
    total = int(counts.sum())
    value, size = np.empty(total, np.int64), np.empty(total, np.int64)
    for (_, v, bits), c, b in zip(parts, counts, begin):
        at = np.repeat(b - (np.cumsum(c) - c), c) + np.arange(len(v))
        value[at], size[at] = v, bits
    return np.repeat(np.arange(n), counts.sum(0)), value, size


_N_LOG_N = np.concatenate([[0.0], np.arange(1, MOST_ROWS * PIXELS + 1) * np.log2(np.arange(1, MOST_ROWS * PIXELS + 1))])
DIRECT, PALETTE, GREEN, SPATIAL = range(4)
TILE = 3


def _entropy(row: np.ndarray, totals: np.ndarray, channel: np.ndarray) -> np.ndarray:
    """Bits of each image if a channel were coded by its own frequencies; row is 256 times the number of a pixel's image, totals the images' pixels."""
    counts = np.bincount(row + channel, minlength=256 * len(totals))
    return _N_LOG_N[totals] - _N_LOG_N[counts].reshape(-1, 256).sum(1)


def _spatial(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals of an image after predictor and cross-colour, and both transforms' tiles, each tile by what leaves the most zeros."""
    h, w = x.shape
    c = _channels(x).astype(np.int16)
    flat = np.concatenate([np.broadcast_to(_BLACK, (w + 1, 4)), c.reshape(-1, 4)])
    left, top, corner, right = (flat[w + 1 - d : w + 1 - d + h * w].reshape(h, w, 4) for d in (1, w, w + 1, w - 1))
    tiles = (_div(h, TILE), _div(w, TILE))

    def by_tile(v: np.ndarray) -> np.ndarray:
        padded_ = np.zeros((tiles[0] << TILE, tiles[1] << TILE), v.dtype)
        padded_[:h, :w] = v
        return padded_.reshape(tiles[0], 1 << TILE, tiles[1], 1 << TILE).sum((1, 3))

    def spread(v: np.ndarray) -> np.ndarray:
        return np.repeat(np.repeat(v, 1 << TILE, 0), 1 << TILE, 1)[:h, :w]

    left = np.where((np.arange(w) == 0)[None, :, None], top, left)
    every = [(c - _guess(m, left, top, corner, right)) & 255 for m in range(14)]
    missed = np.stack([by_tile(np.count_nonzero(e[..., :3], axis=-1)) for e in every])
    missed[0] //= 2  # samples are left as they are but where a mode tells more than half of them
    modes = missed.argmin(0)
    picked = np.take_along_axis(np.stack(every), spread(modes)[None, :, :, None], 0)[0]
    picked[0] = (c[0] - left[0]) & 255
    picked[1:, 0] = (c[1:, 0] - top[1:, 0]) & 255
    picked[0, 0] = (c[0, 0] - _BLACK) & 255
    blue, green, red = (picked[..., k].astype(np.int32) for k in range(3))

    def best(target: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tried = (0, 8, 16, 24, 32, -8, -16, -24, -32)
        left_over = [(target - (m * _signed(by) >> 5)) & 255 for m in tried]
        missed = np.stack([by_tile((v != 0).astype(np.int64)) for v in left_over])
        missed[0] //= 2
        of = missed.argmin(0)
        return np.array(tried)[of], np.take_along_axis(np.stack(left_over), spread(of)[None], 0)[0]

    to_red, red_left = best(red, green)
    to_blue, blue_left = best(blue, green)
    red_blue, blue_left = best(blue_left, red)
    res = (picked[..., 3].astype(np.uint32) << 24 | red_left.astype(np.uint32) << 16 | green.astype(np.uint32) << 8 | blue_left.astype(np.uint32)).astype(np.uint32)
    cross = 0xFF << 24 | (red_blue & 255) << 16 | (to_blue & 255) << 8 | (to_red & 255)
    return res, (0xFF000000 | modes << 8).astype(np.uint32), cross.astype(np.uint32)


def _planned(argb: np.ndarray, image: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[int], Symbols, np.ndarray]:
    """Of each image its pixels after the transforms it gets and their width; all that is written before their codes; and the bits that literals take by entropy."""
    n, row = len(sizes), image << 8
    blue, green, red = (np.ascontiguousarray(argb.view(np.uint8)[k::4]) for k in range(3))
    of_green = _entropy(row, sizes, green)
    direct = _entropy(row, sizes, blue) + of_green + _entropy(row, sizes, red)
    costs = np.stack([direct, np.full(n, np.inf), _entropy(row, sizes, blue - green) + of_green + _entropy(row, sizes, red - green), np.full(n, np.inf)])
    # where most pixels of a tile are like the one before or above, prediction may pay
    like = np.zeros(len(argb), bool)
    like[1:] = argb[1:] == argb[:-1]
    above = np.zeros(len(argb), bool)
    above[PIXELS:] = argb[PIXELS:] == argb[:-PIXELS]
    above.reshape(-1, PIXELS)[starts // PIXELS] = False
    like |= above
    like[starts] = False
    alike = np.flatnonzero(like)
    at = alike - starts[image[alike]]
    per_row = PIXELS >> TILE
    tile = (image[alike] << 16) + (at // PIXELS >> TILE) * per_row + (at % PIXELS >> TILE)
    tile, count = np.unique(tile, return_counts=True)
    likely = np.unique(tile[2 * count > 1 << 2 * TILE] >> 16)
    predicted = {i: _spatial(argb[starts[i] : starts[i] + sizes[i]].reshape(-1, PIXELS)) for i in likely.tolist()}
    for i, (left_over, modes, cross) in predicted.items():
        c = _channels(left_over).reshape(-1, 4)
        costs[SPATIAL, i] = sum(_entropy(np.zeros(len(c), np.int64), sizes[i : i + 1], c[:, k])[0] for k in range(3)) + 8 * (modes.size + cross.size) + 200
    colour = np.sort(image << 24 | argb & np.uint32(0xFFFFFF))
    first = np.flatnonzero(np.r_[True, colour[1:] != colour[:-1]])
    kinds, counts = colour[first], np.diff(np.r_[first, len(colour)])
    owner = kinds >> 24
    n_kinds = np.bincount(owner, minlength=n)
    few = n_kinds <= 256
    costs[PALETTE, few] = (_N_LOG_N[sizes] - np.bincount(owner, _N_LOG_N[counts], n) + 18 * n_kinds)[few]
    plan = costs.argmin(0)
    first_kind = np.cumsum(n_kinds) - n_kinds
    pixels, widths, fields, small, bits = [], [], [], [], costs.min(0)
    for i in range(n):
        own = argb[starts[i] : starts[i] + sizes[i]]
        rows = len(own) // PIXELS
        width = PIXELS
        fields.append((i, 0x2F | PIXELS - 1 << 8 | rows - 1 << 22, 40))
        if plan[i] == PALETTE:
            palette = (kinds[first_kind[i] : first_kind[i] + n_kinds[i]] & 0xFFFFFF).astype(np.uint32) | np.uint32(0xFF000000)
            x = np.searchsorted(palette, own).astype(np.uint8).reshape(rows, PIXELS)
            if len(palette) <= 16:
                per = 8 if len(palette) <= 2 else 4 if len(palette) <= 4 else 2
                x = np.bitwise_or.reduce(x.reshape(rows, -1, per) << (np.arange(per, dtype=np.uint8) * (8 // per)), axis=2)
                width = x.shape[1]
            deltas = _channels(palette).copy()
            deltas[1:] -= deltas[:-1].copy()
            fields.append((i, 7 | len(palette) - 1 << 3, 11))
            small.append((len(fields), deltas.view("<u4").reshape(-1)))
            fields.append((i, 0, 0))
            own = np.uint32(0xFF000000) | x.reshape(-1).astype(np.uint32) << np.uint32(8)
        elif plan[i] == GREEN:
            fields.append((i, 5, 3))
            own = _add_green(own, -1)
        elif plan[i] == SPATIAL:
            res, modes, cross = predicted[i]
            for kind, tiles in ((0, modes), (1, cross)):
                fields.append((i, 1 | kind << 1 | TILE - 2 << 3, 6))
                small.append((len(fields), tiles))
                fields.append((i, 0, 0))
            own = res.reshape(-1)
        fields.append((i, 0, 1))  # no more transforms
        pixels.append(own)
        widths.append(width)
    of, value, size = (np.array(x, np.int64) for x in zip(*fields))
    written = (np.arange(len(of)), value, size)
    if small:
        at, parts = np.array([k for k, _ in small]), _small_written([x for _, x in small])
        written = _in_order(len(of), written, (at[parts[0]], *parts[1:]))
    return pixels, widths, (of[written[0]], *written[1:]), bits


def _split(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances as prefix symbol, extra and its bits."""
    v = value - 1
    n = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 2, 0)
    symbol = np.where(v < 4, v, 2 * n + 2 + (v >> n & 1))
    n = np.where(v < 4, 0, n)
    return symbol, np.where(v < 4, 0, v & ((1 << n) - 1)), n


@lru_cache
def _codes_of_distances(width: int) -> np.ndarray:
    """The plane's code of each short distance, 0 where it has none."""
    out = np.zeros(8 * width + 9, np.int64)
    for code in range(120, 0, -1):
        out[_back(code, width)] = code
    return out


def _matches(pixels: np.ndarray, image: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of back-references that don't overlap: runs of places whose next pixels were last seen at one distance."""
    n = len(pixels) - LEAST_MATCH + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none
    x = pixels.astype(np.uint64)
    key = x[:n] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(1, LEAST_MATCH):
        key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + x[i : i + n]
    # 26 bits of an image's hashes are enough, as they are checked; in it the outcome is the same whatever is beside
    key = image[:n] << 26 | (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(38)).astype(np.int64)
    order = _order(key)
    key = key[order]
    same = np.flatnonzero(key[1:] == key[:-1])  # the image is part of the key
    at, before = order[1:][same], order[same]
    ok = at + LEAST_MATCH <= ends[image[at]]
    for i in range(LEAST_MATCH):  # hashes may be equal by chance
        ok &= pixels[at + i] == pixels[before + i]
    back = np.zeros(n, np.int64)
    back[at[ok]] = (at - before)[ok]
    some = back > 0
    turns = (back[1:] != back[:-1]) | (image[1:n] != image[: n - 1])
    new, last = np.flatnonzero(some & np.r_[True, turns]), np.flatnonzero(some & np.r_[turns, True])
    end = last + LEAST_MATCH
    start = np.maximum(new, np.r_[0, np.maximum.accumulate(end)[:-1]]) if len(new) else new
    keep = end - start >= LEAST_MATCH
    return start[keep], (end - start)[keep], back[new][keep]


def _cache_hits(pixels: np.ndarray, image: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pixel's place in its image's cache, and whether its colour is there when it is reached."""
    place = (pixels * np.uint32(_HASH) >> (32 - bits[image]).astype(np.uint32)).astype(np.int64)
    key = image << 11 | place
    order = _order(key)
    key, by_key = key[order], pixels[order]
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (key[1:] == key[:-1]) & (by_key[1:] == by_key[:-1])
    return place, hit


def _encode_images(chunks: list[bytes]) -> list[bytes]:
    """One lossless stream for each of chunks, of 1 to MOST_ROWS rows. What is written of one doesn't depend on the others."""
    sizes = np.array([len(c) // 3 for c in chunks], np.int64)
    image = np.repeat(np.arange(len(chunks)), sizes)
    channels = np.full((len(image), 4), 255, np.uint8)
    channels[:, 2::-1] = np.frombuffer(b"".join(chunks), np.uint8).reshape(-1, 3)
    argb = channels.view("<u4")[:, 0]
    own, widths, heads, cost = _planned(argb, image, np.cumsum(sizes) - sizes, sizes)
    n, sizes = len(own), np.array([len(x) for x in own], np.int64)
    pixels, image = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
    ends = np.cumsum(sizes)
    start, length, distance = _matches(pixels, image, ends)
    free = np.ones(len(pixels), bool)
    free[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = False
    # a cache where its hits save more than its codes cost
    cache_bits = np.select([sizes < 512, sizes < 2048], [5, 7], 8)
    place, hit = _cache_hits(pixels, image, cache_bits)
    hit &= free
    hits = np.bincount(image[hit], minlength=n)
    met = np.zeros((n, 1 << 8), bool)
    met[image[hit], place[hit]] = True
    slots = met.sum(1)
    pays = hits * (cost / sizes - 8) > 4 * slots + 20
    cache_bits = np.where(pays, cache_bits, 0)
    hit &= pays[image]
    # symbols, in the order of their pixels
    literal = free & ~hit
    head = free.copy()
    head[start] = True
    at = np.flatnonzero(head)
    of = image[at]
    green = np.where(hit[at], 280 + place[at], (pixels[at] >> np.uint32(8) & np.uint32(255)).astype(np.int64))
    nth = np.searchsorted(at, start)
    len_symbol, len_extra, len_bits = _split(length)
    green[nth] = 256 + len_symbol
    wide = np.array(widths)[of[nth]]
    code = distance + 120
    for w in set(widths):
        table = _codes_of_distances(w)
        near = (wide == w) & (distance < len(table))
        short = table[distance[near]]
        code[near] = np.where(short > 0, short, distance[near] + 120)
    far_symbol, far_extra, far_bits = _split(code)
    alphabet = 280 + (1 << int(cache_bits.max()) if cache_bits.any() else 0)
    plain = np.flatnonzero(literal[at])
    own = np.ascontiguousarray(pixels[at[plain]])
    row = of[plain] << 8
    # each symbol's place among the codes' words
    green += of * alphabet
    others = [row + own.view(np.uint8)[k::4] for k in (2, 0, 3)]
    counts = [np.bincount(v, minlength=n * m).reshape(n, -1) for v, m in ((green, alphabet), *((v, 256) for v in others))]
    counts.append(np.bincount(of[nth] * 40 + far_symbol, minlength=n * 40).reshape(n, -1))
    lengths = [code_lengths(c, MOST_BITS) for c in counts]
    words = [code_words(x) for x in lengths]
    cache_field = (np.arange(n), np.where(cache_bits > 0, 1 | cache_bits << 1, 0), np.where(cache_bits > 0, 6, 2))  # and one group of codes
    every = np.zeros((n, 5, max(alphabet, 280)), np.uint8)
    for k, x in enumerate(lengths):
        every[:, k, : x.shape[1]] = x
    sizes = np.tile([280, 256, 256, 256, 40], (n, 1))
    sizes[:, 0] += np.where(cache_bits > 0, 1 << cache_bits, 0)
    row, code_value, code_size = _codes_written(every.reshape(5 * n, -1), sizes.reshape(-1))
    for x in lengths:  # a lone symbol takes no bits
        x[(x > 0).sum(1) == 1] = 0
    # bits << 16 | word
    coded = [np.where(x > 0, w | x.astype(np.int64) << 16, 0).reshape(-1) for w, x in zip(words[:4], lengths[:4])]
    value = coded[0][green]
    bits = value >> 16
    value &= 0xFFFF
    literal_value, literal_bits = value[plain], bits[plain]
    for v, code in zip(others, coded[1:]):
        if code.any():
            x = code[v]
            literal_value |= (x & 0xFFFF) << literal_bits
            literal_bits += x >> 16
    value[plain], bits[plain] = literal_value, literal_bits
    for v, more in ((len_extra, len_bits), (words[4][of[nth], far_symbol], lengths[4][of[nth], far_symbol].astype(np.int64)), (far_extra, far_bits)):
        value[nth] |= np.where(more > 0, v, 0) << bits[nth]
        bits[nth] += more
    return _packed(n, *_in_order(n, heads, cache_field, (row // 5, code_value, code_size), (of, value, bits)))


def _packed(n: int, of: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The symbols of each of n streams (of tells whose) as bytes; 57 bits a symbol at most."""
    first = np.searchsorted(of, np.arange(n))
    total = np.add.reduceat(size, first)
    n_words = (total + 63) >> 6
    start = np.cumsum(n_words) - n_words
    offset = np.cumsum(size) - size
    offset += ((start << 6) - offset[first])[of]
    value, word, shift = value.astype(np.uint64), offset >> 6, (offset & 63).astype(np.uint64)
    out = np.zeros(int(n_words.sum()) + 1, np.uint64)
    new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[new]] = np.bitwise_or.reduceat(value << shift, new)
    over = np.flatnonzero((offset & 63) + size > 64)
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    data = out.astype("<u8").tobytes()
    return [data[8 * s : 8 * s + ((n + 7) >> 3)] for s, n in zip(start.tolist(), total.tolist())]


def _grouped(items: list, size: Callable[[Any], int]) -> Iterator[list]:
    """items in runs of up to GROUP, or of one."""
    part, total = [], 0
    for x in items:
        if part and total + size(x) > GROUP:
            yield part
            part, total = [], 0
        part.append(x)
        total += size(x)
    if part:
        yield part


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """WebP of payloads whose lengths are positive multiples of WIDTH: of each one file for every MOST_ROWS rows."""
    step = MOST_ROWS * WIDTH
    for p in payloads:
        if not p or len(p) % WIDTH:
            raise ValueError(f"not a positive multiple of {WIDTH} bytes")
    chunks = [[p[i : i + step] for i in range(0, len(p), step)] for p in payloads]
    streams = (x for part in _grouped([c for own in chunks for c in own], len) for x in _encode_images(part))
    return [b"".join(_file(next(streams)) for _ in own) for own in chunks]


def _file(data: bytes) -> bytes:
    pad = len(data) & 1
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(data) + pad, b"WEBP", b"VP8L", len(data)) + data + b"\0" * pad


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


def samples(images: list[np.ndarray]) -> np.ndarray:
    """The payload's bytes: red, green and blue of each pixel, row by row."""
    return np.concatenate([_channels(x)[..., 2::-1].reshape(-1) for x in images])


def traits(media: bytes) -> Counter:
    """What the images of a file were written with: transforms, caches, codes of more than one symbol, kinds of pixels."""
    images = read_heads(_chunks(media))
    totals = np.array([m.width * m.height for m in images], np.int64)
    kind, _ = _read_symbols(images, np.cumsum(totals) - totals)
    out = Counter(("predictor", "cross-colour", "subtract green", "palette")[u[0]] for m in images for u in m.undo)
    out.update({"cache": sum(m.cache_bits > 0 for m in images), "prefix codes": sum(len(c) - c.count(0) > 1 for m in images for g in m.groups for c in g)})
    out.update({name: int((kind == k).sum()) for k, name in ((LITERAL, "literals"), (COPY, "copied"), (CACHED, "cached"))})
    return +out


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH))


def feature(pixels: np.ndarray) -> str:
    """rows x width, distinct values, mean in thousandths, and the changes from one sample to the next."""
    n = len(pixels)
    values = int(np.count_nonzero(np.bincount(pixels, minlength=256)))
    return f"{n // WIDTH}x{WIDTH} values={values} mean={int(pixels.sum(dtype=np.int64)) * 1000 // n} changes={int(np.count_nonzero(pixels[1:] != pixels[:-1]))}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary, WebP) for each row of docs (doc_id, text); null text is stored like empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = texts(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in own], pa.int64()), pa.array(encode_all([padded(t) for t in own]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    plain = docs.select("doc_id", "text")
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """The stored images read back: sizes, hashes and the feature of each row of media (doc_id, n_bytes, media).

    Equal media give equal rows; null media is an error of the caller's; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media", 4 << 20):
            rows, media = [], batch.column("media").to_pylist()
            for m, images in zip(media, decode_all(media)):
                pixels = samples(images)
                payload = pixels.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
