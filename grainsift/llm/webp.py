"""Lossless WebP: decoder to pixel arrays, and an encoder that makes test images."""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsift.llm._common import keep_columns, prepare, table, tidied

LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# the near pixels that short distances name: (columns to the left, rows up)
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, COLOUR, GREEN, PALETTE = range(4)
_HASH = 0x1E35A7BD
WAVE_PIXELS = 8
"""Predictions are undone by anti-diagonals, in numpy, where as many pixels of one go
together on average."""
PART = 1 << 20
BATCH_PIXELS = 4 << 20


class WebPError(ValueError):
    pass


class _Reader:
    __slots__ = ("data", "end", "pos")

    def __init__(self, data: bytes):
        self.data, self.pos, self.end = data, 0, 8 * len(data)

    def bits(self, n: int) -> int:
        p = self.pos
        self.pos = p + n
        if self.pos > self.end:
            raise WebPError("the image data ends early")
        return (int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7)) & ((1 << n) - 1)


def _reverse(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2) if n else 0


def _codes(lengths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes, as read from the low bit: symbol to (bits, length)."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    out, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        if code >> n:
            raise WebPError("too many codes")
        out[s] = (_reverse(code, n), n)
        code, last = code + 1, n
    if len(used) > 1 and code != 1 << last:
        raise WebPError("incomplete prefix code")
    return out


@lru_cache(16)
def _mirrored(width: int) -> np.ndarray:
    """The numbers of so many bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


Table = tuple[list[int], int]
"""``symbol << 4 | length`` for each value of the next bits, and the mask of these."""


def _table(lengths: Sequence[int]) -> Table:
    """A prefix code; a lone symbol takes no bits."""
    every = np.asarray(lengths, np.int64)
    used = np.flatnonzero(every)
    if len(used) <= 1:
        return [int(used[0]) << 4 if len(used) else 0], 0
    n = every[used]
    order = np.argsort(n, kind="stable")
    used, n = used[order], n[order]
    width = int(n[-1])
    room = 1 << (width - n)
    if room.sum() != 1 << width:
        raise WebPError("too many codes" if room.sum() > 1 << width else "incomplete prefix code")
    # canonical codes fill the table in order when read from the high bit
    return np.repeat(used << 4 | n, room)[_mirrored(width)].tolist(), (1 << width) - 1


def _read_table(r: _Reader, alphabet: int) -> Table:
    if r.bits(1):
        two = r.bits(1)
        symbols = [r.bits(8 if r.bits(1) else 1)]
        if two:
            symbols.append(r.bits(8))
        if max(symbols) >= alphabet:
            raise WebPError("a symbol outside its alphabet")
        return ([s << 4 | 1 for s in sorted(symbols)], 1) if len(set(symbols)) == 2 else ([symbols[0] << 4], 0)
    lengths = [0] * 19
    for s in LENGTH_ORDER[: 4 + r.bits(4)]:
        lengths[s] = r.bits(3)
    table, mask = _table(lengths)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    out: list[int] = []
    last, data, p = 8, r.data, r.pos
    while len(out) < alphabet and left:
        left -= 1
        bits = int.from_bytes(data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7)
        e = table[bits & mask]
        s, n = e >> 4, e & 15
        if s < 16:
            out.append(s)
            last = s or last
        else:
            least, extra = ((3, 2), (3, 3), (11, 7))[s - 16]
            out += [last if s == 16 else 0] * (least + (bits >> n & ((1 << extra) - 1)))
            n += extra
        p += n
        if p > r.end:
            raise WebPError("the image data ends early")
    r.pos = p
    if len(out) > alphabet:
        raise WebPError("too many code lengths")
    return _table(out)


#: least value and extra bits of each prefix symbol of lengths and distances
_VALUES = [(c + 1, 0) if c < 4 else (((2 + (c & 1)) << ((c - 2) >> 1)) + 1, (c - 2) >> 1) for c in range(40)]


def _read_pixels(r: _Reader, width: int, height: int, main: bool) -> array:
    """An entropy-coded image as ARGB numbers, 32 bits each. A window of 121 bits is
    taken for each pixel or reference: neither needs more."""
    cache_bits = 0
    if r.bits(1):
        cache_bits = r.bits(4)
        if not 1 <= cache_bits <= 11:
            raise WebPError("a colour cache of impossible size")
    cache = [0] * (1 << cache_bits)
    shift, groups, meta, step, across = 32 - cache_bits, 1, None, 0, 0
    if main and r.bits(1):
        step = r.bits(3) + 2
        across = (width + (1 << step) - 1) >> step
        meta = [(p >> 8) & 0xFFFF for p in _read_pixels(r, across, (height + (1 << step) - 1) >> step, False)]
        groups = max(meta) + 1
    sizes = (280 + (len(cache) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_table(r, n) for n in sizes] for _ in range(groups)]
    total, out, n = width * height, array("I"), 0
    (green, gm), (red, rm), (blue, bm), (alpha, am), (distance, dm) = codes[0]
    pending = 0  # pixels before this are in the cache
    data, p, end, block = r.data, r.pos, r.end, -1
    while n < total:
        if meta is not None:
            y, x = divmod(n, width)
            at = (y >> step) * across + (x >> step)
            if at != block:
                block = at
                (green, gm), (red, rm), (blue, bm), (alpha, am), (distance, dm) = codes[meta[at]]
        bits = int.from_bytes(data[p >> 3 : (p >> 3) + 16], "little") >> (p & 7)
        e = green[bits & gm]
        s, used = e >> 4, e & 15
        if s < 256:
            e = red[bits >> used & rm]
            used += e & 15
            pixel = e >> 4 << 16 | s << 8
            e = blue[bits >> used & bm]
            used += e & 15
            pixel |= e >> 4
            e = alpha[bits >> used & am]
            p += used + (e & 15)
            out.append(e >> 4 << 24 | pixel)
            n += 1
        elif s < 280:
            size, extra = _VALUES[s - 256]
            size += bits >> used & ((1 << extra) - 1)
            used += extra
            e = distance[bits >> used & dm]
            used += e & 15
            d, extra = _VALUES[e >> 4]
            d += bits >> used & ((1 << extra) - 1)
            p += used + extra
            if d > 120:
                d -= 120
            else:
                x, y = NEAR[d - 1]
                d = max(1, x + y * width)
            if d > n or n + size > total:
                raise WebPError("a reference outside the image")
            if d >= size:
                out += out[n - d : n - d + size]
            else:
                out += (out[n - d :] * (size // d + 1))[:size]
            n += size
        else:
            for pixel in out[pending:]:
                cache[(pixel * _HASH & 0xFFFFFFFF) >> shift] = pixel
            pending = n
            p += used
            out.append(cache[s - 280])
            n += 1
        if p > end:
            raise WebPError("the image data ends early")
    r.pos = p
    return out


def _average(a: int, b: int) -> int:
    """By channel, rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _clamped(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out = out << 8 | (0 if v < 0 else 255 if v > 255 else v)
    return out


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for a, b, c in zip(_channels(left), _channels(top), _channels(corner), strict=True):
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


def _half(a: int, b: int) -> int:
    d = a - b
    return a + (d // 2 if d >= 0 else -(-d // 2))


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """What the neighbours say: left, above, above left and above right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _clamped(a + b - c for a, b, c in zip(_channels(left), _channels(top), _channels(corner), strict=True))
    if mode == 13:
        return _clamped(_half(a, b) for a, b in zip(_channels(_average(left, top)), _channels(corner), strict=True))
    return 0xFF000000


#: which of left, above, above left and above right each predictor looks at
_NEEDED = [(), (0,), (1,), (3,), (2,), (0, 1, 3), (0, 2), (0, 1), (1, 2), (1, 3), (0, 1, 2, 3), (0, 1, 2), (0, 1, 2), (0, 1, 2), (), ()]
_BLACK = np.array([0, 0, 0, 255])


def predict_all(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same for many pixels, given as rows of four channels of 16 bits."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right >> 1) + top) >> 1
    if mode == 6:
        return left + corner >> 1
    if mode == 7:
        return left + top >> 1
    if mode == 8:
        return corner + top >> 1
    if mode == 9:
        return top + right >> 1
    if mode == 10:
        return ((left + corner >> 1) + (top + right >> 1)) >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(axis=1) < np.abs(left - corner).sum(axis=1)
        return np.where(nearer[:, None], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = left + top >> 1
        d = mean - corner
        return np.clip(mean + (d + (d < 0) >> 1), 0, 255)  # halves are cut towards zero
    return _BLACK


def _sum(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _neighbours(pixels: Sequence[int], width: int, i: int) -> tuple[int, int, int, int]:
    # beyond the right edge the pixel above right is the first of this row
    return pixels[i - 1], pixels[i - width], pixels[i - width - 1], pixels[i - width + 1]


def _mode(i: int, width: int, step: int, across: int, modes: Sequence[int]) -> int:
    """The predictor of pixel i; the first row and column have their own."""
    if i < width:
        return 1 if i else 0
    if i % width == 0:
        return 2
    return modes[((i // width) >> step) * across + ((i % width) >> step)] >> 8 & 15


def _undo_by_pixel(pixels: np.ndarray, width: int, step: int, modes: Sequence[int]) -> np.ndarray:
    out, across = pixels.tolist(), (width + (1 << step) - 1) >> step
    for i in range(len(out)):
        near = _neighbours(out, width, i) if i >= width else (out[i - 1], 0, 0, 0)
        out[i] = _sum(out[i], predict(_mode(i, width, step, across, modes), *near))
    return np.array(out, np.uint32)


def _undo_by_waves(pixels: np.ndarray, width: int, step: int, modes: Sequence[int]) -> np.ndarray:
    """Pixels with the same x + 2 y depend on earlier ones only, so each such wave is
    undone at once, mode by mode; waves run through bands of rows."""
    height, across = len(pixels) // width, (width + (1 << step) - 1) >> step
    pixels = pixels.copy()
    flat = pixels.view(np.uint8).reshape(-1, 4)
    of_block = np.array(modes, np.uint32) >> 8 & 15
    band, back = max(64, PART // width), (1, width, width + 1, width - 1)
    for row in range(0, height, band):
        rows = min(band, height - row)
        y, x = np.divmod(np.arange(rows * width), width)
        mode = of_block[(y + row >> step) * across + (x >> step)].astype(np.int64)
        mode[x == 0] = 2
        if row == 0:
            mode[:width] = 1
            mode[0] = 0
        key = (x + 2 * y) * 16 + mode
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.diff(key[order], prepend=-1))
        place = order + row * width
        for a, b, m in zip(at.tolist(), [*at[1:].tolist(), len(order)], mode[order[at]].tolist(), strict=True):
            i = place[a:b]
            near = [flat[i - back[k]].astype(np.int16) if k in _NEEDED[m] else None for k in range(4)]
            flat[i] += (predict_all(m, *near) if m in range(1, 14) else _BLACK).astype(np.uint8)
    return pixels


def _undo_prediction(pixels: np.ndarray, width: int, step: int, modes: Sequence[int]) -> np.ndarray:
    waves = (width + 2 * (len(pixels) // width)) * len(set(modes))
    return (_undo_by_waves if len(pixels) >= WAVE_PIXELS * waves else _undo_by_pixel)(pixels, width, step, modes)


def _signed(a: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) ^ 128) - 128


def _cross_colour(pixels: np.ndarray, elements: np.ndarray, sign: int) -> np.ndarray:
    """Adds (sign 1) or takes away (-1) what green says of red, and both of blue."""
    e = elements.astype(np.int64)
    pixels = pixels.astype(np.int64)
    green = _signed(pixels >> 8 & 255)
    old_red = pixels >> 16 & 255
    red = old_red + sign * (_signed(e & 255) * green >> 5) & 255
    true_red = red if sign > 0 else old_red
    blue = (pixels & 255) + sign * ((_signed(e >> 8 & 255) * green >> 5) + (_signed(e >> 16 & 255) * _signed(true_red) >> 5)) & 255
    return pixels & 0xFF00FF00 | red << 16 | blue


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo(kind: int, pixels: np.ndarray, width: int, height: int, extra: tuple) -> np.ndarray:
    if kind == PREDICTOR:
        return _undo_prediction(pixels, width, *extra)
    out = np.empty(width * height, np.uint32)
    for low in range(0, len(out), PART):  # so that wider numbers in between stay few
        high = min(low + PART, len(out))
        y, x = np.divmod(np.arange(low, high), width)
        if kind == COLOUR:
            step, elements = extra
            of_pixel = np.array(elements, np.uint32)[(y >> step) * ((width + (1 << step) - 1) >> step) + (x >> step)]
            out[low:high] = _cross_colour(pixels[low:high], of_pixel, 1)
        elif kind == GREEN:
            p = pixels[low:high].astype(np.int64)
            g = p >> 8 & 255
            out[low:high] = p & 0xFF00FF00 | ((p >> 16) + g & 255) << 16 | p + g & 255
        else:
            (colours,) = extra
            pack = _packing(len(colours))
            narrow = (width + (1 << pack) - 1) >> pack
            bits = 8 >> pack
            index = (pixels[y * narrow + (x >> pack)].astype(np.int64) >> 8 & 255) >> ((x & ((1 << pack) - 1)) * bits) & ((1 << bits) - 1)
            full = np.zeros(256, np.uint32)
            full[: len(colours)] = colours
            out[low:high] = full[index]
    return out


def _chunk(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise WebPError("no lossless image in it")


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels, row by row, of any size that the format has
    (16,384 x 16,384 at most)."""
    r = _Reader(_chunk(data))
    if r.bits(8) != 0x2F:
        raise WebPError("wrong signature")
    width, height, alpha = r.bits(14) + 1, r.bits(14) + 1, r.bits(1)
    if r.bits(3):
        raise WebPError("unknown version")
    done, now, seen = [], width, set()
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        extra: tuple = ()
        before = now
        if kind in (PREDICTOR, COLOUR):
            step = r.bits(3) + 2
            size = (1 << step) - 1
            extra = (step, _read_pixels(r, (now + size) >> step, (height + size) >> step, False))
        elif kind == PALETTE:
            n = r.bits(8) + 1
            colours, last = [], 0
            for p in _read_pixels(r, n, 1, False):
                last = _sum(last, p)
                colours.append(last)
            extra = (colours,)
            pack = _packing(n)
            now = (now + (1 << pack) - 1) >> pack
        done.append((kind, before, extra))
    pixels = np.frombuffer(_read_pixels(r, now, height, True), np.uint32)
    for kind, w, extra in reversed(done):
        pixels = _undo(kind, pixels, w, height, extra)
    return width, height, pixels if alpha else pixels | np.uint32(0xFF000000)


# --- encoder ---------------------------------------------------------------


class _Writer:
    def __init__(self) -> None:
        self.value, self.n, self.out = 0, 0, bytearray()

    def bits(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        while self.n >= 8:
            self.out.append(self.value & 255)
            self.value >>= 8
            self.n -= 8

    def close(self) -> bytes:
        if self.n:
            self.out.append(self.value & 255)
            self.value = self.n = 0
        return bytes(self.out)


def _lengths(counts: Counter, limit: int) -> dict[int, int]:
    """Huffman code lengths; counts are flattened until none is beyond the limit."""
    counts = dict(counts)
    while True:
        heap = [(c, i, (s,)) for i, (s, c) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        out = dict.fromkeys(counts, 0)
        nxt = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], nxt, a[2] + b[2]))
            nxt += 1
        if max(out.values(), default=0) <= limit:
            return out
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def _write_code(w: _Writer, counts: Counter, alphabet: int) -> dict[int, tuple[int, int]]:
    symbols = sorted(counts)
    if len(symbols) <= 2 and all(s < 256 for s in symbols):
        symbols = symbols or [0]
        w.bits(1, 1)
        w.bits(len(symbols) - 1, 1)
        w.bits(int(symbols[0] > 1), 1)
        w.bits(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            w.bits(symbols[1], 8)
            return {symbols[0]: (0, 1), symbols[1]: (1, 1)}
        return {symbols[0]: (0, 0)}
    if len(symbols) == 1:  # too large for the short form: a second one that never comes
        counts = counts + Counter({0: 1})
    lengths = _lengths(counts, 15)
    full = [lengths.get(s, 0) for s in range(alphabet)]
    steps: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    i, last = 0, 8
    while i < alphabet:
        run = 1
        while i + run < alphabet and full[i + run] == full[i]:
            run += 1
        if not full[i] and run >= 3:
            run = min(run, 138)
            steps.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif full[i] and full[i] == last and run >= 3:
            run = min(run, 6)
            steps.append((16, run - 3, 2))
        else:
            run = 1
            steps.append((full[i], 0, 0))
            last = full[i] or last
        i += run
    own = _lengths(Counter(s for s, _, _ in steps), 7)
    if len(own) == 1:
        own = dict.fromkeys([*own, 0 if 0 not in own else 1], 1)
    w.bits(0, 1)
    used = max(4, max(LENGTH_ORDER.index(s) for s in own) + 1)
    w.bits(used - 4, 4)
    for s in LENGTH_ORDER[:used]:
        w.bits(own.get(s, 0), 3)
    w.bits(0, 1)
    codes = _codes([own.get(s, 0) for s in range(19)])
    for s, value, n in steps:
        w.bits(*codes[s])
        w.bits(value, n)
    return _codes(full)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and number of extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    extra = high - 1
    return 2 * high + second, v - ((2 + second) << extra), extra


def _write_pixels(w: _Writer, pixels: list[int], width: int, cache_bits: int, main: bool, step: int = 0) -> None:
    """``step``: a group of codes for each block of 2**step pixels (0: one for all)."""
    w.bits(int(cache_bits > 0), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    n = len(pixels)
    across = (width + (1 << step) - 1) >> step if step else 1
    group = [((i // width) >> step) * across + ((i % width) >> step) if step else 0 for i in range(n)]
    groups = max(group) + 1
    if main:
        w.bits(int(step > 0), 1)
        if step:
            w.bits(step - 2, 3)
            _write_pixels(w, [0xFF000000 | g << 8 for g in range(groups)], across, 0, False)
    tokens: list[tuple[int, tuple]] = []
    cache: dict[int, int] = {}
    near = {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}
    last: dict[tuple[int, ...], int] = {}
    i = 0
    while i < n:
        size, d = 0, 0
        j = last.get(tuple(pixels[i : i + 3]))
        if j is not None:
            d = i - j
            while i + size < n and size < 4096 and pixels[i + size] == pixels[i + size - d]:
                size += 1
        if size >= 3:
            tokens.append((group[i], ("copy", _prefix(size), _prefix(near.get(d, d + 120)))))
        else:
            size, p = 1, pixels[i]
            slot = (p * _HASH & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            tokens.append((group[i], ("cache", slot)) if cache_bits and cache.get(slot) == p else (group[i], ("pixel", *_channels(p))))
        for k in range(i, i + size):
            last[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[(pixels[k] * _HASH & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        i += size
    counts = [[Counter() for _ in range(5)] for _ in range(groups)]
    for g, t in tokens:
        green, red, blue, alpha, distance = counts[g]
        if t[0] == "pixel":
            for c, v in zip((alpha, red, green, blue), t[1:], strict=True):
                c[v] += 1
        elif t[0] == "cache":
            green[280 + t[1]] += 1
        else:
            green[256 + t[1][0]] += 1
            distance[t[2][0]] += 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_write_code(w, c, s) for c, s in zip(five, sizes, strict=True)] for five in counts]
    for g, t in tokens:
        green, red, blue, alpha, distance = codes[g]
        if t[0] == "pixel":
            a, r, gr, b = t[1:]
            for c, v in ((green, gr), (red, r), (blue, b), (alpha, a)):
                w.bits(*c[v])
        elif t[0] == "cache":
            w.bits(*green[280 + t[1]])
        else:
            for c, (s, value, extra) in ((green, (256 + t[1][0], *t[1][1:])), (distance, t[2])):
                w.bits(*c[s])
                w.bits(value, extra)


def encode(pixels: np.ndarray, width: int, transforms: Sequence[int] = (), cache_bits: int = 0, step: int = 0, modes: Sequence[int] = (11,), element: int = 0x00102030) -> bytes:
    """A lossless WebP file. ``transforms`` are applied in order; ``modes`` are the
    predictors that blocks take in turn, ``element`` the cross-colour element."""
    now = np.asarray(pixels).astype(np.int64) & 0xFFFFFFFF
    height = len(now) // width
    w = _Writer()
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(int((now >> 24 != 255).any()), 1)
    w.bits(0, 3)
    wide, size = width, 2
    for kind in transforms:
        across, down = (wide + 3) >> 2, (height + 3) >> 2
        if kind == PALETTE:
            colours, index = np.unique(now, return_inverse=True)
            if len(colours) > 256:
                continue
            w.bits(1, 1)
            w.bits(kind, 2)
            w.bits(len(colours) - 1, 8)
            steps, last = [], 0
            for c in colours.tolist():
                steps.append(_sum(c, sum((256 - x) % 256 << s for x, s in zip(_channels(last), (24, 16, 8, 0), strict=True))))
                last = c
            _write_pixels(w, steps, len(steps), 0, False)
            pack = _packing(len(colours))
            narrow = (wide + (1 << pack) - 1) >> pack
            packed = np.zeros(narrow * height, np.int64)
            y, x = np.divmod(np.arange(wide * height), wide)
            np.bitwise_or.at(packed, y * narrow + (x >> pack), index.ravel() << ((x & ((1 << pack) - 1)) * (8 >> pack)))
            now, wide = 0xFF000000 | packed << 8, narrow
            continue
        w.bits(1, 1)
        w.bits(kind, 2)
        if kind == GREEN:
            g = now >> 8 & 255
            now = now & 0xFF00FF00 | ((now >> 16) - g & 255) << 16 | now - g & 255
            continue
        w.bits(size - 2, 3)
        if kind == COLOUR:
            elements = np.full(across * down, 0xFF000000 | element)
            _write_pixels(w, elements.tolist(), across, 0, False)
            y, x = np.divmod(np.arange(wide * height), wide)
            now = _cross_colour(now, elements[(y >> size) * across + (x >> size)], -1)
        else:
            chosen = [0xFF000000 | modes[k % len(modes)] << 8 for k in range(across * down)]
            _write_pixels(w, chosen, across, 0, False)
            old, out = now.tolist(), []
            for i, p in enumerate(old):
                near = _neighbours(old, wide, i) if i >= wide else (old[i - 1], 0, 0, 0)
                guess = predict(_mode(i, wide, size, across, chosen), *near)
                out.append(sum((a - b) % 256 << s for a, b, s in zip(_channels(p), _channels(guess), (24, 16, 8, 0), strict=True)))
            now = np.array(out, np.int64)
    w.bits(0, 1)
    _write_pixels(w, now.tolist(), wide, cache_bits, True, step)
    body = w.close()
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


# --- columns ---------------------------------------------------------------


def decode_images(images: DataFrame) -> DataFrame:
    """``images(image_id, webp)`` as ``(image_id, width, height, pixels, error)``;
    pixels are ARGB numbers (signed), row by row.

    A null image gives nulls; one that is empty, cut short, not lossless WebP or
    damaged gives nulls and says why in ``error``, and never fails the job. Null
    ids and repeated rows are decoded like others. An empty table stays empty. A
    task holds one image and BATCH_PIXELS pixels (of four bytes) at a time.
    """
    prepare(images.sparkSession)

    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        flat = np.concatenate([np.zeros(0, np.int32), *[r[3] for r in rows if r[3] is not None]])
        ends = np.cumsum([0, *[0 if r[3] is None else len(r[3]) for r in rows]])
        pixels = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([r[3] is None for r in rows]))
        columns = [pixels if i == 3 else pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        return pa.record_batch(columns, ["image_id", "width", "height", "pixels", "error"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row: tuple = (ident, None, None, None, None)
                if value.is_valid:
                    try:
                        width, height, pixels = decode(value.as_py())
                        row = (ident, width, height, pixels.view(np.int32), None)
                        size += len(pixels)
                    except (WebPError, IndexError) as e:
                        row = (ident, None, None, None, str(e))
                rows.append(row)
                if size >= BATCH_PIXELS:  # a few large images are a batch
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    source = keep_columns(images, "image_id", "webp").select(F.col("image_id").cast("long").alias("image_id"), "webp")
    return source.mapInArrow(run, "image_id long, width int, height int, pixels array<int>, error string")


VARIANTS = (
    {"transforms": (PREDICTOR, GREEN), "modes": tuple(range(14))},
    {"transforms": (COLOUR, GREEN), "cache_bits": 4},
    {"transforms": (PALETTE,), "cache_bits": 2},
    {"transforms": (GREEN, PREDICTOR, COLOUR), "modes": (1, 2, 7, 12, 13)},
    {"transforms": (), "step": 2, "cache_bits": 3},
)


def pixels_of(vector: np.ndarray) -> np.ndarray:
    """A vector as opaque pixels, one a number, from blue over green to red."""
    level = np.clip((np.nan_to_num(vector) + 1) * 127.5, 0, 255).astype(np.int64) & ~7
    return (0xFF000000 | level << 16 | (255 - np.abs(2 * level - 255)) << 8 | (255 - level)).astype(np.uint32)


def images_of(vectors: DataFrame, width: int = 8) -> DataFrame:
    """A lossless WebP image of every vector, in turns with each kind of coding."""
    prepare(vectors.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vector = np.array(value.as_py() or [], np.float64)
                whole = np.zeros(max(1, -(-len(vector) // width)) * width)
                whole[: len(vector)] = vector
                made.append(encode(pixels_of(whole), width, **VARIANTS[(ident or 0) % len(VARIANTS)]) if value.is_valid else None)
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["image_id", "webp"])

    return keep_columns(vectors, "vec_id", "embedding").mapInArrow(run, "image_id long, webp binary")


def op6_webp_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus has no images, so each embedding is drawn as one, then decoded."""
    return decode_images(images_of(table(spark, sf_dir, "embeddings")))
