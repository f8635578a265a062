"""A second reader of lossless streams, which goes symbol by symbol and pixel by pixel; and a writer of any bits."""

from __future__ import annotations

import numpy as np

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


class PrefixCode:
    """Canonical code from lengths by symbol. constant: its only symbol, taken without reading a bit."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.constant = used[0][1] if len(used) == 1 else 0 if not used else None
        if self.constant is None:
            used.sort()
            if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
                raise ValueError("the code isn't complete")
            self.most = used[-1][0]
            self.table: list[tuple[int, int]] | None = None
            self._used = used

    def _fill(self) -> None:
        self.table = [(0, 0)] * (1 << self.most)
        code = last = 0
        for n, s in self._used:
            code <<= n - last
            last = n
            start = int(format(code, f"0{n}b")[::-1], 2)
            for i in range(start, 1 << self.most, 1 << n):
                self.table[i] = (n, s)
            code += 1

    def read(self, bits: Bits) -> int:
        if self.constant is not None:
            return self.constant
        if self.table is None:
            self._fill()
        p = bits.at
        window = int.from_bytes(bits.data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7) & ((1 << self.most) - 1)
        n, s = self.table[window]
        bits.at = p + n
        return s


def _read_code(bits: Bits, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.take(1):
        count = bits.take(1) + 1
        first = bits.take(8 if bits.take(1) else 1)
        lengths[first] = 1
        if count == 2:
            lengths[bits.take(8)] = 1
        return PrefixCode(lengths)
    of_lengths = [0] * 19
    for i in range(4 + bits.take(4)):
        of_lengths[_ORDER[i]] = bits.take(3)
    code = PrefixCode(of_lengths)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, previous = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            previous = s or previous
            continue
        repeat, value = (3 + bits.take(2), previous) if s == 16 else (3 + bits.take(3), 0) if s == 17 else (11 + bits.take(7), 0)
        if at + repeat > size:
            raise ValueError("code lengths run over")
        lengths[at : at + repeat] = [value] * repeat
        at += repeat
    return PrefixCode(lengths)


def _extra(bits: Bits, symbol: int) -> int:
    """Length or distance of a prefix symbol, 1 at least."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.take(n) + 1


def _read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB of width * height pixels as uint32."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    tile_bits, groups_of = 0, None
    if top and bits.take(1):
        tile_bits = bits.take(3) + 2
        tiles = _div(width, tile_bits)
        groups_of = (_read_image(bits, tiles, _div(height, tile_bits), False) >> np.uint32(8)) & np.uint32(0xFFFF)
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(1 + (int(groups_of.max()) if groups_of is not None else 0))]
    total = width * height
    return _read_pixels(bits, width, total, groups, groups_of, tile_bits, cache_bits)


def _read_pixels(bits: Bits, width: int, total: int, groups: list, groups_of: np.ndarray | None, tile_bits: int, cache_bits: int) -> np.ndarray:
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    tiles = _div(width, tile_bits) if groups_of is not None else 0
    at = cached = 0
    while at < total:
        g = groups[int(groups_of[((at // width) >> tile_bits) * tiles + ((at % width) >> tile_bits)])] if groups_of is not None else groups[0]
        s = g[0].read(bits)
        if s < 256:
            r = g[1].read(bits)
            b = g[2].read(bits)
            out[at] = g[3].read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            code = _extra(bits, g[4].read(bits))
            if code > 120:
                back = code - 120
            else:
                dx, dy = _PLANE[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + length):
                out[i] = out[i - back]
            at += length
        else:
            while cached < at:
                cache[(out[cached] * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _div(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _channels(argb: np.ndarray) -> np.ndarray:
    """Last axis: blue, green, red, alpha."""
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


def _predict(x: np.ndarray, modes: np.ndarray, tile_bits: int) -> np.ndarray:
    """Undoes the predictor transform; x is height * width residuals."""
    h, w = x.shape
    out = _channels(x).astype(np.int16).reshape(h, w, 4)
    black = np.array([0, 0, 0, 255], np.int16)

    def average(a, b):
        return (a + b) >> 1

    for row in range(h):
        for col in range(w):
            if not row:
                guess = out[0, col - 1] if col else black
            elif not col:
                guess = out[row - 1, 0]
            else:
                left, top, corner = out[row, col - 1], out[row - 1, col], out[row - 1, col - 1]
                right = out[row - 1, col + 1] if col + 1 < w else out[row, 0]
                mode = int(modes[row >> tile_bits, col >> tile_bits]) >> 8 & 15
                if mode in (0, 14, 15):
                    guess = black
                elif mode < 5:
                    guess = (left, top, right, corner)[mode - 1]
                elif mode == 5:
                    guess = average(average(left, right), top)
                elif mode == 6:
                    guess = average(left, corner)
                elif mode == 7:
                    guess = average(left, top)
                elif mode == 8:
                    guess = average(corner, top)
                elif mode == 9:
                    guess = average(top, right)
                elif mode == 10:
                    guess = average(average(left, corner), average(top, right))
                elif mode == 11:
                    near_left = np.abs(top - corner).sum() < np.abs(left - corner).sum()
                    guess = left if near_left else top
                elif mode == 12:
                    guess = np.clip(left + top - corner, 0, 255)
                else:
                    mean = average(left, top)
                    half = mean - corner
                    guess = np.clip(mean + (np.abs(half) >> 1) * np.sign(half), 0, 255)
            out[row, col] = (out[row, col] + guess) & 255
    return np.ascontiguousarray(out.astype(np.uint8)).view("<u4").reshape(h, w)


def _uncross(x: np.ndarray, tiles: np.ndarray, tile_bits: int) -> np.ndarray:
    """Undoes the cross-colour transform."""
    h, w = x.shape
    c = _channels(x).reshape(h, w, 4).copy()
    t = np.repeat(np.repeat(_channels(tiles), 1 << tile_bits, 0), 1 << tile_bits, 1)[:h, :w].astype(np.int8).astype(np.int32)
    green = c[..., 1].astype(np.int8).astype(np.int32)
    red = (c[..., 2] + (t[..., 0] * green >> 5)) & 255
    blue = c[..., 0] + (t[..., 1] * green >> 5) + (t[..., 2] * red.astype(np.uint8).astype(np.int8).astype(np.int32) >> 5)
    c[..., 2], c[..., 0] = red.astype(np.uint8), (blue & 255).astype(np.uint8)
    return c.view("<u4").reshape(h, w)


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


def decode_stream(data: bytes) -> np.ndarray:
    """ARGB (height * width, uint32) of the data of a VP8L chunk."""
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
            tiles = _read_image(bits, _div(inner, n), _div(height, n), False).reshape(_div(height, n), -1)
            undo.append((kind, tiles, n, inner))
        elif kind == 2:
            undo.append((kind, None, 0, inner))
        else:
            n = bits.take(8) + 1
            deltas = _channels(_read_image(bits, n, 1, False)).reshape(n, 4)
            palette = np.ascontiguousarray(np.cumsum(deltas, 0, dtype=np.uint8)).view("<u4")[:, 0]
            undo.append((kind, palette, 0, inner))
            inner = _div(inner, 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0)
    x = _read_image(bits, inner, height, True).reshape(height, inner)
    for kind, data_, n, own in reversed(undo):
        if kind == 0:
            x = _predict(x, data_, n)
        elif kind == 1:
            x = _uncross(x, data_, n)
        elif kind == 2:
            c = _channels(x).reshape(*x.shape, 4).copy()
            c[..., 0] += c[..., 1]
            c[..., 2] += c[..., 1]
            x = c.view("<u4").reshape(x.shape)
        else:
            x = _unpalette(x, data_, own)
    return x


class Writer:
    """Collects bits, least significant first."""

    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, n: int) -> Writer:
        self.value |= value << self.n
        self.n += n
        return self
