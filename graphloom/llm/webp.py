"""Lossless WebP: a decoder for the whole format and an encoder that can use each of its tools.

Written from the public format specification. Pixels are uint32 arrays (height, width) of ARGB.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3),
    (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5),
    (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7),
    (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6),
    (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH, MAX_BITS, MAX_RUN, LITERALS, LENGTHS, DISTANCES = 0x1E35A7BD, 15, 4096, 256, 24, 40
PREDICT, CROSS, GREEN, PALETTE = range(4)
BLACK = 0xFF000000
#: Bytes of the stream whose bit positions are decoded at once.
BLOCK = 1 << 15


# --- decoding ---------------------------------------------------------------------------------------------


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0

    def take(self, n: int) -> int:
        i = self.at >> 3
        got = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7) & 0x7FFF


def _mirror() -> np.ndarray:
    x, out = np.arange(1 << MAX_BITS), np.zeros(1 << MAX_BITS, np.int64)
    for i in range(MAX_BITS):
        out |= (x >> i & 1) << (MAX_BITS - 1 - i)
    return out


MIRROR = _mirror()


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest."""
    code, first, out = 0, np.zeros(MAX_BITS + 2, np.int64), np.zeros(len(lengths), np.int64)
    count = np.bincount(lengths, minlength=MAX_BITS + 1)
    count[0] = 0
    for n in range(1, MAX_BITS + 1):
        code = (code + int(count[n - 1])) << 1
        first[n] = code
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    size = lengths[order]
    start = np.cumsum(count) - count
    out[order] = first[size] + np.arange(len(order)) - start[size]
    return MIRROR[out] >> (MAX_BITS - np.maximum(lengths, 0)) * (lengths > 0)


class Code:
    """A prefix code as tables over as many next bits as its longest code has. A code of one symbol takes none."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.single = int(used[0]) if len(used) == 1 else (0 if not len(used) else None)
        if self.single is not None:
            return
        own = lengths[used]
        if int((1 << (MAX_BITS - own)).sum()) != 1 << MAX_BITS:
            raise ValueError("a prefix code is not complete")
        top = int(own.max())
        self.mask = (1 << top) - 1
        # in order of length and symbol, codes fill the table one after another; then bits are turned round
        order = np.argsort(own, kind="stable")
        turned = MIRROR[: 1 << top] >> (MAX_BITS - top)
        times = 1 << (top - own[order])
        self.symbols = np.repeat(used[order].astype(np.int32), times)[turned]
        self.sizes = np.repeat(own[order].astype(np.int32), times)[turned]

    @classmethod
    def of(cls, symbol: int) -> Code:
        """The code of one symbol."""
        out = cls.__new__(cls)
        out.single = symbol
        return out

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        w = bits.peek() & self.mask
        bits.at += int(self.sizes[w])
        return int(self.symbols[w])


def _read_code(bits: Bits, alphabet: int) -> Code:
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        first = bits.take(8 if wide else 1)
        if not two:
            return Code.of(first)
        lengths = np.zeros(alphabet, np.int64)
        lengths[[first, bits.take(8)]] = 1
        return Code(lengths)
    lengths = np.zeros(alphabet, np.int64)
    own = np.zeros(19, np.int64)
    for i in range(4 + bits.take(4)):
        own[LENGTH_ORDER[i]] = bits.take(3)
    code = Code(own)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    out, before = [], 8
    if code.single is not None:
        symbols, sizes, mask = [code.single], [0], 0
    else:
        symbols, sizes, mask = code.symbols.tolist(), code.sizes.tolist(), code.mask
    data, place = bits.data, bits.at
    while len(out) < alphabet and left > 0:
        left -= 1
        w = int.from_bytes(data[place >> 3 : (place >> 3) + 4], "little") >> (place & 7)
        s, n = symbols[w & mask], sizes[w & mask]
        place, w = place + n, w >> n
        if s < 16:
            out.append(s)
            before = s or before
        elif s == 16:
            out += [before] * (3 + (w & 3))
            place += 2
        elif s == 17:
            out += [0] * (3 + (w & 7))
            place += 3
        else:
            out += [0] * (11 + (w & 127))
            place += 7
    bits.at = place
    lengths[: len(out)] = out[:alphabet]
    return Code(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.take(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, distance: int, n: int) -> None:
    if distance > at:
        raise ValueError("a reference before the first pixel")
    while n > 0:
        step = min(n, distance)
        out[at : at + step] = out[at - distance : at - distance + step]
        at, n, distance = at + step, n - step, distance + step


def _plain(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    """Pixels of one group of codes in which only green varies: all bit positions of a block are decoded at
    once, then the chain of symbol starts is followed."""
    green, rest = codes[0], (codes[3].single << 24) | (codes[1].single << 16) | codes[2].single
    out, n = np.empty(total, np.uint32), 0
    eight = np.arange(8, dtype=np.uint32)
    data = np.frombuffer(bits.data, np.uint8)
    if green.single is not None and green.single < LITERALS:
        out[:] = rest | green.single << 8
        return out
    while n < total:
        byte = bits.at >> 3
        raw = data[byte : byte + BLOCK + 3].astype(np.uint32)
        if len(raw) < 4:
            raise ValueError("the stream ends early")
        word = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        window = ((word[:, None] >> eight) & np.uint32(green.mask)).ravel()
        symbol = green.symbols[window]
        limit = len(window)
        after = np.empty(limit + 1, np.int32)
        np.minimum(np.arange(limit, dtype=np.int32) + green.sizes[window], limit, out=after[:limit])
        after[:limit][symbol >= LITERALS] = limit
        after[limit] = limit
        far = after
        for _ in range(4):  # sixteen symbols a step
            far = far[far]
        q, heads = bits.at & 7, []
        while q < limit:
            heads.append(q)
            q = int(far[q])
        chain = np.empty((16, len(heads)), np.int32)
        chain[0] = heads
        for k in range(1, 16):
            chain[k] = after[chain[k - 1]]
        seen = chain.T.ravel()
        seen = seen[seen < limit][: total - n]
        got = symbol[seen]
        special = len(got) and got[-1] >= LITERALS
        got = got[: len(got) - bool(special)]
        out[n : n + len(got)] = rest | got.astype(np.uint32) << 8
        n += len(got)
        last = int(seen[-1])
        if special:
            bits.at = (byte << 3) + last + int(green.sizes[window[last]])
            run = _value(bits, int(symbol[last]) - LITERALS)
            far = _distance(_value(bits, codes[4].read(bits)), width)
            run = min(run, total - n)
            _copy(out, n, far, run)
            n += run
        else:
            bits.at = (byte << 3) + last + int(green.sizes[window[last]])
    return out


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.take(4) if bits.take(1) else 0
    meta, shift = None, 0
    if main and bits.take(1):
        shift = bits.take(3) + 2
        across = (width + (1 << shift) - 1) >> shift
        meta = (_pixels(bits, across, (height + (1 << shift) - 1) >> shift, False).reshape(-1, across) >> 8) & 0xFFFF
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(1 if meta is None else int(meta.max()) + 1)]
    total = width * height
    if meta is None and not cache_bits and all(c.single is not None for c in groups[0][1:4]):
        return _plain(bits, groups[0], width, total)
    out, n = np.zeros(total, np.uint32), 0
    cache, cached = [0] * (1 << cache_bits), 0
    while n < total:
        codes = groups[0] if meta is None else groups[int(meta[n // width >> shift, n % width >> shift])]
        s = codes[0].read(bits)
        if s < LITERALS:
            red, blue = codes[1].read(bits), codes[2].read(bits)
            out[n] = codes[3].read(bits) << 24 | red << 16 | s << 8 | blue
            n += 1
        elif s < LITERALS + LENGTHS:
            run = min(_value(bits, s - LITERALS), total - n)
            _copy(out, n, _distance(_value(bits, codes[4].read(bits)), width), run)
            n += run
        else:
            while cached < n:
                cache[(int(out[cached]) * HASH & 0xFFFFFFFF) >> (32 - cache_bits)] = int(out[cached])
                cached += 1
            out[n] = cache[s - LITERALS - LENGTHS]
            n += 1
    return out


def _channels(x: np.ndarray) -> np.ndarray:
    return np.stack([x >> s & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint8)
    return np.ascontiguousarray(c[..., ::-1]).view(np.uint32)[..., 0]


def _guess(mode: int, left, top, right, corner):
    """The prediction of a mode from the neighbours left, above, above right and above left; arrays of channels."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = mean(left, top)
        d = a - corner
        return np.clip(a + np.where(d < 0, -(-d >> 1), d >> 1), 0, 255)
    pairs = {1: (left, left), 2: (top, top), 3: (right, right), 4: (corner, corner), 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}
    if mode in pairs:
        return mean(*pairs[mode])
    return np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)


HALF = np.uint32(0xFEFEFEFE)


def plus(a, b):
    """The sum of pixels, channel by channel."""
    return (np.ascontiguousarray(a).view(np.uint8) + np.ascontiguousarray(b).view(np.uint8)).view(np.uint32)


def minus(a, b):
    return (np.ascontiguousarray(a).view(np.uint8) - np.ascontiguousarray(b).view(np.uint8)).view(np.uint32)


def mean(a, b):
    return (a & b) + (((a ^ b) & HALF) >> np.uint32(1))


def apart(x):
    return np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 4).astype(np.int16)


def packed(c):
    return np.ascontiguousarray(c.astype(np.uint8)).view(np.uint32)[..., 0]


def distance(a, b):
    """How far pixels are apart, over all channels."""
    a, b = np.ascontiguousarray(a).view(np.uint8), np.ascontiguousarray(b).view(np.uint8)
    d = (np.maximum(a, b) - np.minimum(a, b)).view(np.uint32)
    d = (d & np.uint32(0x00FF00FF)) + (d >> np.uint32(8) & np.uint32(0x00FF00FF))
    return (d & np.uint32(0xFFFF)) + (d >> np.uint32(16))


def guess(mode: int, left, top, right, corner):
    """The prediction of a mode from the neighbours left, above, above right and above left."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode in (6, 7, 8, 9):
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 11:
        return np.where(distance(top, corner) < distance(left, corner), left, top)
    if mode == 12:
        return packed(np.clip(apart(left) + apart(top) - apart(corner), 0, 255))
    if mode == 13:
        a = apart(mean(left, top))
        d = a - apart(corner)
        return packed(np.clip(a + (d + (d < 0) >> 1), 0, 255))
    return np.full_like(left, BLACK)


def unpredict(x: np.ndarray, y: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Pixels from what predictors left. ``y`` numbers the rows of each image, ``modes`` has the blocks of each row. A pixel needs
    its left one and three above, so rows run two pixels behind the row above, all images at once."""
    w = x.shape[1]
    x = np.ascontiguousarray(x, np.uint32).copy()
    first = x[y == 0]
    first[:, 0] += np.uint32(BLACK)
    x[y == 0] = np.cumsum(first.view(np.uint8).reshape(-1, w, 4), 1, dtype=np.uint8).reshape(len(first), -1).view(np.uint32)
    flat = x.ravel()
    rows = np.flatnonzero(y > 0)
    rows = rows[np.argsort(y[rows], kind="stable")]
    late = 2 * (y[rows] - 1)
    if not len(rows):
        return x
    for t in range(w + int(late[-1])):
        i, j = np.searchsorted(late, [t - w, t], side="right")
        r = rows[i:j]
        at = t - late[i:j]
        mode = np.where(at == 0, 2, modes[r, at >> shift])
        p = r * w + at
        order = np.argsort(mode.astype(np.uint8), kind="stable")
        p, n = p[order], np.bincount(mode, minlength=16)
        left, top, right, corner = flat[p - 1], flat[p - w], flat[p - w + 1], flat[p - w - 1]
        new, a = np.empty(len(p), np.uint32), 0
        for m in np.flatnonzero(n).tolist():
            b = a + int(n[m])
            new[a:b] = guess(m, left[a:b], top[a:b], right[a:b], corner[a:b])
            a = b
        flat[p] = plus(flat[p], new)
    return x


def _unpredict(x: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    y = np.arange(len(x))
    return unpredict(x, y, (modes >> np.uint32(8) & np.uint32(15)).astype(np.int64)[y >> shift], shift)


def _signed(x):
    return ((x & 255) ^ 128) - 128


def _spread(image: np.ndarray, shift: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(image, 1 << shift, 0), 1 << shift, 1)[:h, :w]


def _uncross(x: np.ndarray, image: np.ndarray, shift: int, sign: int = 1) -> np.ndarray:
    part = lambda v, k: ((v >> np.uint32(k) & np.uint32(255)).astype(np.int32) ^ 128) - 128
    t = _spread(image, shift, *x.shape) if image.size > 1 else image
    green = part(x, 8)
    red = part(x, 16) + sign * (part(t, 0) * green >> 5)
    seen = ((red & 255) ^ 128) - 128 if sign > 0 else part(x, 16)
    blue = part(x, 0) + sign * ((part(t, 8) * green >> 5) + (part(t, 16) * seen >> 5))
    return (x & np.uint32(0xFF00FF00)) | (red & 255).astype(np.uint32) << np.uint32(16) | (blue & 255).astype(np.uint32)


def _greens(x: np.ndarray, sign: int) -> np.ndarray:
    """Green added to red and blue, or taken away."""
    both, g = x & np.uint32(0x00FF00FF), (x >> np.uint32(8)) & np.uint32(255)
    g = g | g << np.uint32(16)
    both = both + g if sign > 0 else (both | np.uint32(0x01000100)) - g
    return (x & np.uint32(0xFF00FF00)) | both & np.uint32(0x00FF00FF)


def decode(data: bytes) -> np.ndarray:
    """Pixels of one file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(4)
    undo, w = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICT, CROSS):
            shift = bits.take(3) + 2
            a, b = (w + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            undo.append((kind, _pixels(bits, a, b, False).reshape(b, a), shift, w))
        elif kind == GREEN:
            undo.append((kind, None, 0, w))
        else:
            n = bits.take(8) + 1
            colours = _joined(np.cumsum(_channels(_pixels(bits, n, 1, False)), 0))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, colours, pack, w))
            w = (w + (1 << pack) - 1) >> pack
    x = _pixels(bits, w, height, True).reshape(height, w)
    for kind, image, shift, w in reversed(undo):
        if kind == PREDICT:
            x = _unpredict(x, image, shift)
        elif kind == CROSS:
            x = _uncross(x, image, shift)
        elif kind == GREEN:
            x = _greens(x, 1)
        else:
            index = x >> 8 & 255
            if shift:
                each = 8 >> shift
                index = (index[..., None] >> (np.arange(1 << shift, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :w]
            table = np.zeros(256, np.uint32)
            table[: len(image)] = image
            x = table[index]
    return x


# --- encoding ---------------------------------------------------------------------------------------------


def code_lengths(freq: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code, flattened until none is over ``most``.

    The two rarest nodes are joined until one is left; symbols come in order of frequency and joined nodes are made in order,
    so the rarest is at the head of one of two queues.
    """
    out = np.zeros(len(freq), np.int64)
    used = np.flatnonzero(freq)
    if len(used) < 2:
        out[used] = 1
        return out
    while True:
        order = used[np.argsort(freq[used], kind="stable")]
        weight = freq[order].tolist()
        n, i, j = len(weight), 0, len(weight)
        parent = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if i < n and (j >= new or weight[i] <= weight[j]):
                    k, i = i, i + 1
                else:
                    k, j = j, j + 1
                parent[k] = new
                total += weight[k]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            out[order] = depth[:n]
            return out
        freq = np.where(freq > 0, freq // 2 + 1, 0)


def complete(lengths: np.ndarray) -> np.ndarray:
    """Lengths that can be written: a lone symbol over 255 gets a companion, since only the long form can name it."""
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] > 255:
        lengths = lengths.copy()
        lengths[0] = 1
    return lengths


class Writer:
    """(value, bits) pairs, lowest bit first."""

    def __init__(self):
        self.values, self.sizes, self.some = [], [], []

    def put(self, value: int, n: int) -> None:
        self.some.append((value, n))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.some:
            got, self.some = np.array(self.some, np.int64), []
            self.values.append(got[:, 0])
            self.sizes.append(got[:, 1])
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        self.many(np.zeros(0, np.int64), np.zeros(0, np.int64))
        v, n = np.concatenate(self.values), np.concatenate(self.sizes)
        start = np.cumsum(n) - n
        nth = np.arange(int(n.sum())) - np.repeat(start, n)
        return np.packbits((np.repeat(v, n) >> nth & 1).astype(np.uint8), bitorder="little").tobytes()


def _split(value: int) -> tuple[int, int, int]:
    """Prefix, extra bits and their number for a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    d = value - 1
    h = d.bit_length() - 1
    return 2 * h + (d >> (h - 1) & 1), d & ((1 << (h - 1)) - 1), h - 1


def _write_single(out: Writer, symbol: int) -> None:
    """The code of one symbol up to 255."""
    wide = symbol > 1
    out.put(1 | wide << 2 | symbol << 3, 11 if wide else 4)


def _write_code(out: Writer, lengths: np.ndarray) -> None:
    lengths = complete(lengths)
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return _write_single(out, int(used[0]) if len(used) else 0)
    last = int(used[-1]) + 1
    runs, i = [], 0
    plain = lengths[:last].tolist()
    while i < last:
        j = i
        while j < last and plain[j] == plain[i]:
            j += 1
        n = j - i
        if plain[i] == 0 and n >= 3:
            n = min(n, 138)
            runs.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
        elif plain[i] and n >= 4:
            runs.append((plain[i], 0, 0))
            n = min(n - 1, 6)
            runs.append((16, n - 3, 2))
            n += 1
        else:
            n = 1
            runs.append((plain[i], 0, 0))
        i += n
    own = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    if (own > 0).sum() == 1:
        own[0 if not own[0] else 1] = 1
    code = canonical(own)
    out.put(0, 1)
    out.put(15, 4)
    out.many(own[list(LENGTH_ORDER)], np.full(19, 3, np.int64))
    out.put(1, 1)
    out.put(7, 3)
    out.put(len(runs) - 2 if len(runs) >= 2 else 0, 16)
    for s, extra, n in runs if len(runs) >= 2 else [*runs, (0, 0, 0)]:
        out.put(int(code[s]), int(own[s]))
        if n:
            out.put(extra, n)


def _tokens(x: np.ndarray, width: int, cache_bits: int, least_run: int):
    """('lit', pixel) , ('run', length) at distance 1 and ('old', index) tokens with their positions."""
    n, i, cache, out = len(x), 0, {}, []
    same = np.r_[False, x[1:] == x[:-1]]
    edge = np.flatnonzero(~same)
    ends = dict(zip(edge.tolist(), np.r_[edge[1:], n].tolist(), strict=True))
    while i < n:
        stop = ends.get(i)
        key = (int(x[i]) * HASH & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if cache_bits and cache.get(key) == int(x[i]):
            out.append((i, "old", key))
        else:
            out.append((i, "lit", int(x[i])))
        cache[key] = int(x[i])
        i += 1
        while stop and stop - i >= least_run:
            step = min(stop - i, MAX_RUN)
            out.append((i, "run", step))
            i += step
    return out


def _entropy(out: Writer, x: np.ndarray, width: int, height: int, main: bool, cache_bits: int = 0, meta_bits: int = 0, least_run: int = 32, far: bool = False) -> None:
    x = x.ravel()
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    group = np.zeros(len(x), np.int64)
    if main:
        out.put(int(meta_bits > 0), 1)
    if main and meta_bits:
        out.put(meta_bits - 2, 3)
        a, b = (width + (1 << meta_bits) - 1) >> meta_bits, (height + (1 << meta_bits) - 1) >> meta_bits
        image = np.arange(a * b).reshape(b, a) % 3
        group = _spread(image, meta_bits, height, width).ravel()
        _entropy(out, image.astype(np.uint32) << 8, a, b, False)
    size = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    if not cache_bits and not meta_bits and ((x ^ x[0]) & np.uint32(0xFFFF00FF)).max() == 0:
        return _write_plain(out, x, width, least_run, far)
    tokens = _tokens(x, width, cache_bits, least_run)
    freq = [[np.zeros(n, np.int64) for n in (size, 256, 256, 256, DISTANCES)] for _ in range(int(group.max()) + 1)]
    far = _split(2)
    for at, kind, v in tokens:
        f = freq[group[at]]
        if kind == "lit":
            for k, s in enumerate((8, 16, 0, 24)):
                f[k][v >> s & 255] += 1
        else:
            f[0][LITERALS + (_split(v)[0] if kind == "run" else LENGTHS + v)] += 1
            f[4][far[0]] += kind == "run"
    lengths = [[complete(code_lengths(c)) for c in f] for f in freq]
    for g in lengths:
        for n in g:
            _write_code(out, n)
    codes = [[canonical(n) for n in g] for g in lengths]
    several = [[(n > 0).sum() > 1 for n in g] for g in lengths]

    def symbol(g, k, s):
        if several[g][k]:
            out.put(int(codes[g][k][s]), int(lengths[g][k][s]))

    for at, kind, v in tokens:
        g = int(group[at])
        if kind == "lit":
            for k, s in enumerate((8, 16, 0, 24)):
                symbol(g, k, v >> s & 255)
        elif kind == "old":
            symbol(g, 0, LITERALS + LENGTHS + v)
        else:
            p, extra, n = _split(v)
            symbol(g, 0, LITERALS + p)
            out.put(extra, n)
            symbol(g, 4, far[0])


def _references(green: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that occurred before, from the first that is ``least`` long on."""
    n = len(green) - least + 1
    if n < 2:
        return []
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(least, step, np.uint64))
        h, low = np.zeros(n, np.uint64), green.astype(np.uint64) + np.uint64(1)
        for k in range(least):
            h += low[k : k + n] * power[k]
    order = np.argsort(h, kind="stable")
    before = np.full(n, -1)
    same = h[order][1:] == h[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    out, at = [], 0
    for i in np.flatnonzero(before >= 0).tolist():
        if i < at:
            continue
        j = int(before[i])
        end = min(len(green) - i, MAX_RUN)
        differ = np.flatnonzero(green[i : i + end] != green[j : j + end])
        size = int(differ[0]) if len(differ) else end
        if size >= least:
            out.append((i, size, i - j))
            at = i + size
    return out


def _write_plain(out: Writer, x: np.ndarray, width: int, least_run: int, far: bool = False) -> None:
    """One varying channel: literals, runs, and with ``far`` references at any distance, all at once."""
    green = (x >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if far:
        refs = _references(green, least_run)
    else:
        edge = np.flatnonzero(np.concatenate([[True], green[1:] != green[:-1]]))
        size = np.diff(np.append(edge, len(green)))
        refs = [(at + 1 + i, min(MAX_RUN, n - 1 - i), 1) for at, n in zip(edge[size > least_run].tolist(), size[size > least_run].tolist(), strict=True) for i in range(0, n - 1, MAX_RUN)]
    keep = np.ones(len(green), bool)
    for at, n, _ in refs:
        keep[at : at + n] = False
    at = np.flatnonzero(keep)
    # a distance of 1 is the second of the near codes; others are told by their own number
    cut = [(*_split(n), *_split(2 if d == 1 else d + len(NEAR))) for _, n, d in refs]
    freq, apart = np.bincount(green[at], minlength=LITERALS + LENGTHS), np.zeros(DISTANCES, np.int64)
    for p, _, _, q, _, _ in cut:
        freq[LITERALS + p] += 1
        apart[q] += 1
    lengths = code_lengths(freq)
    rest = int(x[0])
    _write_code(out, lengths)
    for k in (rest >> 16 & 255, rest & 255, rest >> 24):
        _write_single(out, k)
    alone = not refs or (apart > 0).sum() < 2
    if alone:
        _write_single(out, int(apart.argmax()) if refs else 0)
    else:
        away = code_lengths(apart)
        _write_code(out, away)
        other = canonical(away)
    code = canonical(lengths)
    if not refs and (lengths > 0).sum() < 2:
        return
    values, sizes = code[green[at]], lengths[green[at]]
    if refs:
        place = np.concatenate([at, np.repeat([i for i, _, _ in refs], 4) + np.tile([0.0, 0.2, 0.4, 0.6], len(refs))])
        more = [(v, n) for p, e, k, q, f, m in cut for v, n in ((code[LITERALS + p], lengths[LITERALS + p]), (e, k), (0, 0) if alone else (other[q], away[q]), (f, m))]
        order = np.argsort(place, kind="stable")
        values = np.concatenate([values, [int(v) for v, _ in more]]).astype(np.int64)[order]
        sizes = np.concatenate([sizes, [int(n) for _, n in more]]).astype(np.int64)[order]
    out.many(values, sizes)


def modes_of(x: np.ndarray, shift: int, allowed: tuple[int, ...] = (1, 2, 4, 8)) -> np.ndarray:
    """For each block the mode that leaves the least of green, by the sum of distances from 0."""
    h, w = x.shape
    a, b = (w + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift
    if h < 2 or w < 2:
        return np.full((b, a), allowed[0], np.uint32)
    g = (x >> np.uint32(8) & np.uint32(255)).astype(np.int16)
    left, top, corner = g[1:, :-1], g[:-1, 1:], g[:-1, :-1]
    cost = []
    for m in allowed:
        d = np.zeros((b << shift, a << shift), np.int32)
        d[1:h, 1:w] = np.abs(((g[1:, 1:] - {1: left, 2: top, 4: corner, 8: (corner + top) >> 1}[m] + 128) & 255) - 128)
        cost.append(d.reshape(b, 1 << shift, a, 1 << shift).sum((1, 3)))
    return np.array(allowed, np.uint32)[np.argmin(cost, 0)]


def encode(x: np.ndarray, predict: int = 0, cross: int = 0, green: bool = False, palette: bool = False, cache_bits: int = 0, meta_bits: int = 0, modes=None, least_run: int = 32, colour=None, far: bool = False) -> bytes:
    """A file of the pixels. ``predict`` and ``cross`` are block sizes as powers of two (0: off), ``modes`` and ``colour`` their
    images; ``far`` lets references reach any distance."""
    x = np.ascontiguousarray(x, np.uint32)
    h, w = x.shape
    out = Writer()
    for v, n in ((w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    if palette:
        colours = np.unique(x)
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        n = len(colours)
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(n - 1, 8)
        _entropy(out, _joined(np.diff(_channels(colours), axis=0, prepend=0)), n, 1, False)
        index = np.searchsorted(colours, x).astype(np.uint32)
        pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
        if pack:
            across, each = (w + (1 << pack) - 1) >> pack, 8 >> pack
            wide = np.zeros((h, across << pack), np.uint32)
            wide[:, :w] = index
            index = (wide.reshape(h, across, -1) << (np.arange(1 << pack, dtype=np.uint32) * each)).sum(-1).astype(np.uint32)
            w = across
        x = index << 8 | BLACK
    if green:
        out.put(1, 1)
        out.put(GREEN, 2)
        x = _greens(x, -1)
    for kind, shift in ((CROSS, cross), (PREDICT, predict)):
        if not shift:
            continue
        out.put(1, 1)
        out.put(kind, 2)
        out.put(shift - 2, 3)
        a, b = (w + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift
        seed = np.arange(a * b, dtype=np.uint32).reshape(b, a)
        if kind == CROSS:
            image = BLACK | (seed * 37 & 255) << 16 | (seed * 91 + 5 & 255) << 8 | (seed * 53 + 200 & 255)
            image = image if colour is None else np.full((b, a), colour, np.uint32)
            new = _uncross(x, image, shift, -1)
        else:
            if modes is None:
                image = seed % 16
            else:
                image = modes_of(x, shift) if isinstance(modes, str) else np.asarray(modes, np.uint32).reshape(b, a)
            image = BLACK | image.astype(np.uint32) << np.uint32(8)
            c = _channels(x)
            where = _spread(image, shift, h, w) >> 8 & 15
            new = c.copy()
            if h > 1 and w > 1:
                up = c[:-1]
                right = np.concatenate([up[:, 2:], c[1:, :1]], 1)
                for m in np.unique(where).tolist():
                    g = _guess(m, c[1:, :-1], up[:, 1:], right, up[:, :-1])
                    new[1:, 1:] = np.where((where[1:, 1:] == m)[..., None], c[1:, 1:] - g, new[1:, 1:])
            new[0, 1:] = c[0, 1:] - c[0, :-1]
            new[1:, 0] = c[1:, 0] - c[:-1, 0]
            new[0, 0] = c[0, 0] - [255, 0, 0, 0]
            new = _joined(new)
        _entropy(out, image, a, b, False)
        x = new
    out.put(0, 1)
    _entropy(out, x, w, h, True, cache_bits, meta_bits, least_run, far)
    body = b"\x2f" + out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def files(data: bytes) -> list[bytes]:
    """The files of a sequence of files."""
    out, at = [], 0
    while at < len(data):
        n = 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
        out.append(data[at : at + n])
        at += n
    return out
