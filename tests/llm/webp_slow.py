"""A lossless WebP decoder that follows the format's text bit by bit and channel by
channel, without tables, windows or arrays: what the decoder is held against."""

ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, *range(6, 16)]


def distances():
    """The places of the 120 short distances: nearest first; of those equally near the
    ones in the rows above before those to the left."""
    from grainsift.llm.webp import NEAR

    return NEAR


class Bits:
    def __init__(self, data):
        self.stream = [byte >> k & 1 for byte in data for k in range(8)]
        self.at = 0

    def one(self):
        self.at += 1
        return self.stream[self.at - 1]

    def number(self, n):
        return sum(self.one() << k for k in range(n))


class Prefix:
    def __init__(self, lengths):
        self.codes, code = {}, 0
        used = [s for s, n in enumerate(lengths) if n]
        self.lone = used[0] if len(used) == 1 else 0 if not used else None
        for n in range(1, 16):
            for s in used:
                if lengths[s] == n:
                    self.codes[f"{code:0{n}b}"] = s
                    code += 1
            code *= 2

    def symbol(self, bits):
        if self.lone is not None:
            return self.lone
        seen = ""
        while seen not in self.codes:
            seen += str(bits.one())
        return self.codes[seen]


def prefix(bits, size):
    if bits.one():
        n = bits.one() + 1
        lengths = [0] * 256
        lengths[bits.number(8 if bits.one() else 1)] = 1
        if n == 2:
            lengths[bits.number(8)] = 1
        return Prefix(lengths)
    first = [0] * 19
    for k in range(bits.number(4) + 4):
        first[ORDER[k]] = bits.number(3)
    code, lengths, before = Prefix(first), [], 8
    tokens = size
    if bits.one():
        tokens = 2 + bits.number(2 + 2 * bits.number(3))
    while tokens and len(lengths) < size:
        tokens -= 1
        s = code.symbol(bits)
        if s < 16:
            lengths.append(s)
            before = s if s else before
        elif s == 16:
            lengths += [before] * (3 + bits.number(2))
        else:
            lengths += [0] * (3 + bits.number(3) if s == 17 else 11 + bits.number(7))
    return Prefix(lengths)


def value(bits, s):
    if s < 4:
        return s + 1
    extra = (s - 2) // 2
    return ((2 + s % 2) << extra) + bits.number(extra) + 1


def image(bits, width, height, top):
    """(alpha, red, green, blue) of each pixel."""
    cache, size = None, 0
    if bits.one():
        size = bits.number(4)
        cache = [(0, 0, 0, 0)] * (1 << size)
    groups, of = 1, lambda i: 0
    if top and bits.one():
        block = bits.number(3) + 2
        wide = -(-width // (1 << block))
        small = image(bits, wide, -(-height // (1 << block)), False)
        numbers = [p[1] * 256 + p[2] for p in small]
        groups, of = max(numbers) + 1, lambda i: numbers[(i // width >> block) * wide + (i % width >> block)]
    codes = [[prefix(bits, n) for n in (280 + (len(cache) if cache else 0), 256, 256, 256, 40)] for _ in range(groups)]
    out = []

    def put(p):
        out.append(p)
        if cache:
            n = p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]
            cache[(0x1E35A7BD * n % (1 << 32)) >> (32 - size)] = p

    while len(out) < width * height:
        five = codes[of(len(out))]
        s = five[0].symbol(bits)
        if s < 256:
            red, blue, alpha = (five[k].symbol(bits) for k in (1, 2, 3))
            put((alpha, red, s, blue))
        elif s < 280:
            run = value(bits, s - 256)
            d = value(bits, five[4].symbol(bits))
            if d <= 120:
                x, y = distances()[d - 1]
                d = max(1, x + y * width)
            else:
                d -= 120
            for _ in range(run):
                put(out[-d])
        else:
            put(cache[s - 280])
    return out


def guess(mode, left, top, corner, right):
    def mean(a, b):
        return tuple((x + y) // 2 for x, y in zip(a, b, strict=True))

    def clamp(x):
        return min(255, max(0, x))

    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        to_left = sum(abs(x - y) for x, y in zip(p, left, strict=True))
        to_top = sum(abs(x - y) for x, y in zip(p, top, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return tuple(clamp(a + b - c) for a, b, c in zip(left, top, corner, strict=True))
    if mode == 13:
        return tuple(clamp(a + int((a - c) / 2)) for a, c in zip(mean(left, top), corner, strict=True))
    black = (255, 0, 0, 0)
    table = [black, left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right))]
    return table[mode] if mode < 11 else black


def signed(x):
    return x - 256 if x > 127 else x


def inverse(kind, pixels, width, height, block, extra):
    wide = -(-width // (1 << block))
    out = []
    for y in range(height):
        for x in range(width):
            e = extra[(y >> block) * wide + (x >> block)] if kind < 2 else None
            if kind == 0:
                i = y * width + x
                if i == 0:
                    g = (255, 0, 0, 0)
                elif y == 0:
                    g = out[i - 1]
                elif x == 0:
                    g = out[i - width]
                else:
                    g = guess(e[2] % 16, out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
                out.append(tuple((a + b) % 256 for a, b in zip(pixels[i], g, strict=True)))
                continue
            if kind == 3:
                per = 8 >> block
                narrow = -(-width // (1 << block))
                p = pixels[y * narrow + (x >> block)][2]
                n = p >> per * (x % (1 << block)) & ((1 << per) - 1)
                out.append(extra[n] if n < len(extra) else (0, 0, 0, 0))
                continue
            a, r, g, b = pixels[y * width + x]
            if kind == 2:
                out.append((a, (r + g) % 256, g, (b + g) % 256))
            else:
                r = (r + (signed(e[3]) * signed(g) >> 5)) % 256
                b = (b + (signed(e[2]) * signed(g) >> 5) + (signed(e[1]) * signed(r) >> 5)) % 256
                out.append((a, r, g, b))
    return out


def body(bits, width, height):
    """The transforms and the image of a stream."""
    todo, now = [], width
    while bits.one():
        kind = bits.number(2)
        block, extra, before = 0, None, now
        if kind < 2:
            block = bits.number(3) + 2
            extra = image(bits, -(-now // (1 << block)), -(-height // (1 << block)), False)
        elif kind == 3:
            n = bits.number(8) + 1
            extra = image(bits, n, 1, False)
            for k in range(1, n):
                extra[k] = tuple((a + b) % 256 for a, b in zip(extra[k], extra[k - 1], strict=True))
            block = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            now = -(-now // (1 << block))
        todo.append((kind, before, block, extra))
    pixels = image(bits, now, height, True)
    for kind, before, block, extra in reversed(todo):
        pixels = inverse(kind, pixels, before, height, block, extra)
    return pixels


def decode(file):
    bits = Bits(file[file.index(b"VP8L") + 8 :])
    assert bits.number(8) == 0x2F
    width, height = bits.number(14) + 1, bits.number(14) + 1
    alpha, _ = bits.one(), bits.number(3)
    pixels = body(bits, width, height)
    return width, height, [(a if alpha else 255) << 24 | r << 16 | g << 8 | b for a, r, g, b in pixels]
