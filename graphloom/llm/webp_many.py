"""Lossless WebP of many images at once: one numpy step handles all of them.

Images of one width lie below each other in one array. Every file gets each tool of the format that is not the palette:
subtract-green, cross-colour with multipliers fitted by block, the best of the fourteen predictors by block, a colour cache,
references at any distance, and an image of groups of codes, which names two where two shorten the file. What a file holds
depends on its own image alone. The decoder walks all streams in step, a pixel of each at a time, and the last ones alone; files
with a palette are read by ``webp.decode``.
"""

from __future__ import annotations

import struct

import numpy as np

from . import webp
from .webp import BLACK, CROSS, DISTANCES, GREEN, HASH, LENGTH_ORDER, LENGTHS, LITERALS, MAX_BITS, MAX_RUN, MIRROR, NEAR, PALETTE, PREDICT, guess, minus, unpredict

#: Blocks are 32 pixels wide and high; references have six pixels at least and reach as far as the format can tell.
SHIFT, LEAST, FARTHEST = 5, 6, (1 << 20) - len(NEAR)
#: Bits of the longest code that is written, so that tables of codes stay small.
LONGEST = 12
#: Rows whose predictors are tried at once.
CHUNK = 128
EVEN = np.uint32(0x00FF00FF)
#: Images and pixels that are written together (one image may have up to 2^21 pixels), and those that are read together.
MOST, PIXELS, READ_MOST, READ_PIXELS = 2048, 1 << 18, 1 << 13, 6 << 20
#: When so few streams have pixels left, they are read one by one.
FEW = 24


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(starts_of(sizes), sizes)


# --- prefix codes -----------------------------------------------------------------------------------------


class Codes:
    """A complete code for each row of frequencies, of the lengths of its shares, rounded up, then as many symbols as possible
    shortened, the short and frequent first. A lone symbol over 255 gets a companion, since only the long form can name it.

    ``row``, ``col``, ``n``: used symbols and their lengths; ``table``: code * 16 + length of each cell, 0 for a lone symbol.
    """

    def __init__(self, freq: np.ndarray, alphabet: int, most: int = MAX_BITS, alone: bool = True):
        cell = np.flatnonzero(freq)
        m, f, row = len(freq) // alphabet, freq[cell], cell // alphabet
        used = np.bincount(row, minlength=m)
        floor = np.bincount(row, f, m).astype(np.int64) >> (most - 1)
        f = np.maximum(f, floor[row])
        part, power = np.frexp(np.bincount(row, f, m)[row] / f)
        n = np.clip(power - (part == 0.5), 1, most)
        count = np.bincount(row * 16 + n, minlength=m * 16).reshape(m, 16)
        room = np.where(used > 1, (1 << most) - (count << np.maximum(most - np.arange(16), 0)).sum(1), 0)
        while room.any():
            for k in range(2, most + 1):
                move = np.minimum(count[:, k], room >> (most - k))
                count[:, k] -= move
                count[:, k - 1] += move
                room -= move << (most - k)
        # by row, the most frequent first, get the lengths from the shortest on; then by row and length
        order = np.sort(row << 36 | ((1 << 22) - 1 - f) << 12 | cell - row * alphabet)
        n = np.repeat(np.tile(np.arange(16), m), count.ravel())
        order = np.sort(order >> 36 << 16 | n << 12 | order & 4095)
        row, n, col = order >> 16, order >> 12 & 15, order & 4095
        first = np.zeros_like(count)
        for k in range(1, 16):
            first[:, k] = (first[:, k - 1] + count[:, k - 1]) << 1
        code = MIRROR[first[row, n] + counted(count.ravel())] >> (MAX_BITS - n)
        lone = used[row] == 1
        self.used, self.m, self.alphabet = used, m, alphabet
        self.table = np.zeros(m * alphabet, np.int64)
        if alone:  # a lone symbol takes no bits
            wide = np.flatnonzero(lone & (col > 255))
            code, n = np.where(lone, 0, code), np.where(lone, 0, n)
        else:
            wide = np.flatnonzero(lone)
        # the companion is 0, or 1 beside 0; its code comes before or after
        other = np.where(col[wide] > 0, 0, 1)
        code[wide], n[wide] = other == 0, 1
        self.used[row[wide]] = 2
        row, col, n, code = (np.concatenate([v, w]) for v, w in ((row, row[wide]), (col, other), (n, n[wide]), (code, other)))
        self.table[row * alphabet + col] = code << 4 | n
        self.row, self.col, self.n = row, col, n

    def bits(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = self.table.take(row * self.alphabet + col)
        return got >> 4, got & 15


def in_order(lengths: np.ndarray):
    """Row, symbol and length of each used symbol, by row, length and symbol."""
    cell = np.flatnonzero(lengths)
    row = cell // lengths.shape[1]
    order = np.sort(row << 16 | lengths.ravel()[cell].astype(np.int64) << 12 | cell - row * lengths.shape[1])
    return order >> 16, order & 4095, order >> 12 & 15


class Tables:
    """Codes as tables over as many next bits as the longest has, one after another; symbol * 16 + length."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, lengths: np.ndarray) -> np.ndarray:
        """Start and mask of the table of each row."""
        used = (lengths > 0).sum(1)
        if not used.all():
            lengths = lengths.copy()
            lengths[used == 0, 0] = 1
        row, col, n = in_order(lengths)
        lone = (used < 2)[row]
        if ((np.bincount(row, (1 << MAX_BITS) >> n, len(used)) != 1 << MAX_BITS) & (used > 1)).any():
            raise ValueError("a prefix code is not complete")
        n = np.where(lone, 0, n)
        top = n[np.flatnonzero(np.append(row[1:] != row[:-1], True))]  # the last of each row is the longest
        each, value = 1 << top, (col << 4 | n).astype(np.int32)
        start = np.zeros(len(used), np.int64)
        for k in np.unique(top).tolist():
            # in order of length and symbol, codes fill a table one after another; then bits are turned round
            own, some = top == k, top[row] == k
            start[own] = self.size + (np.arange(int(own.sum())) << k)
            table = np.repeat(value[some], 1 << (k - n[some])).reshape(-1, 1 << k)
            self.parts.append(np.take(table, MIRROR[: 1 << k] >> (MAX_BITS - k), axis=1).ravel())
            self.size += table.size
        return np.stack([start, each - 1])

    def all(self) -> np.ndarray:
        return np.concatenate(self.parts)


# --- predictors -------------------------------------------------------------------------------------------

def predicted(x: np.ndarray, y: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the best predictor of each block leaves, the modes by row of blocks and their sums of distances from 0.
    ``blocks`` numbers the rows of blocks."""
    (h, w), n = x.shape, int(blocks[-1]) + 1
    edge = np.arange(0, w, 1 << SHIFT)
    modes, least, out = np.zeros((n, len(edge)), np.int64), np.zeros((n, len(edge)), np.int64), np.empty_like(x)
    ends = np.append(np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]), h)
    tried = np.zeros((14, CHUNK, len(edge) << SHIFT), np.uint32)
    i = 0
    while i < h:  # whole rows of blocks
        j = int(ends[np.searchsorted(ends, i + CHUNK, side="right") - 1])
        cur, up = x[i:j], x[max(i, 1) - 1 : j - 1]
        if i == 0:
            up = np.concatenate([x[:1], up])
        left, corner, right = np.roll(cur, 1, 1), np.roll(up, 1, 1), np.concatenate([up[:, 1:], cur[:, :1]], 1)
        rows, top, own = j - i, np.flatnonzero(y[i:j] == 0), blocks[i:j]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        side, first = minus(cur[:, 0], up[:, 0]), minus(cur[top], left[top])
        first[:, 0] = cur[top, 0] - np.uint32(BLACK)
        cost = np.empty((14, len(cut), len(edge)), np.int64)
        for m in range(14):
            res = minus(cur, guess(m, left, up, right, corner))
            res[:, 0], res[top] = side, first
            tried[m, :rows, :w] = res
            res = res.view(np.uint8)
            far = np.minimum(res, -res).view(np.uint32)
            far = np.add.reduceat((far & EVEN) + (far >> np.uint32(8) & EVEN), edge, axis=1)
            cost[m] = np.add.reduceat((far & 0xFFFF) + (far >> 16), cut, axis=0)
        best = cost.argmin(0)
        modes[own[cut]], least[own[cut]] = best, cost.min(0)
        each = best[own - own[0]]
        out[i:j] = tried.reshape(14, CHUNK, len(edge), -1)[each, np.arange(rows)[:, None], np.arange(len(edge))].reshape(rows, -1)[:, :w]
        i = j
    return out, modes, least


# --- encoding ---------------------------------------------------------------------------------------------


class Streams:
    """Bits of many streams. Parts follow each other; each has its (stream, value, size) ordered by stream."""

    def __init__(self, n: int):
        self.n, self.parts = n, []

    def add(self, stream, value, size) -> None:
        stream = np.asarray(stream)
        self.parts.append((stream, np.broadcast_to(np.asarray(value, np.int64), stream.shape), np.broadcast_to(np.asarray(size, np.int64), stream.shape)))

    def every(self, value, size) -> None:
        self.add(np.arange(self.n), value, size)

    def bytes(self) -> list[bytes]:
        taken = [np.bincount(s, n, self.n).astype(np.int64) for s, _, n in self.parts]
        total = (sum(taken) + 7) // 8
        words = (total + 15) // 8
        begin = starts_of(words)
        buffer, at = np.zeros(int(words.sum()) + 1, np.uint64), begin * 64
        for (stream, value, size), part in zip(self.parts, taken, strict=True):
            place = (np.cumsum(size) - size) + (at - starts_of(part)).take(stream)
            low = (place & 63).astype(np.uint64)
            value = value.astype(np.uint64)
            np.add.at(buffer, place >> 6, value << low)
            np.add.at(buffer, (place >> 6) + 1, (value >> np.uint64(1)) >> (np.uint64(63) - low))
            at = at + part
        raw = buffer.tobytes()
        return [raw[i : i + n] for i, n in zip((begin * 8).tolist(), total.tolist(), strict=True)]


def put_codes(out: Streams, stream: np.ndarray, codes: Codes, which: np.ndarray) -> None:
    """A code for each of the streams, the rows ``which``."""
    a = codes.alphabet
    lone = codes.used[which] < 2
    only = np.zeros(codes.m, np.int64)
    only[codes.row] = codes.col
    symbol = only[which[lone]]
    out.add(stream[lone], np.where(symbol > 1, 5 | symbol << 3, 1 | symbol << 3), np.where(symbol > 1, 11, 4))
    stream, m = stream[~lone], int((~lone).sum())
    if not m:
        return
    place = np.full(codes.m, -1)
    place[which[~lone]] = np.arange(m)
    own = place[codes.row] >= 0
    cell = np.sort((place[codes.row[own]] * a + codes.col[own]) << 4 | codes.n[own])
    cell, n = cell >> 4, cell & 15
    # each used symbol, and the unused ones before it in its row
    row = cell // a
    gap = np.diff(cell, prepend=-1) - 1
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    gap[head] = cell[head] % a
    full, rest = gap // 138, gap % 138
    times = 1 + full + np.where(rest > 2, 1, rest)
    nth, last = counted(times), np.repeat(times - 1, times)
    full, rest, row = (np.repeat(v, times) for v in (full, rest, row))
    whole, end = nth < full, nth == last
    symbol = np.where(end, np.repeat(n, times), np.where(whole | (rest > 10), 18, np.where(rest > 2, 17, 0)))
    extra = np.where(symbol == 18, np.where(whole, 127, rest - 11), np.where(symbol == 17, rest - 3, 0))
    own = Codes(np.bincount(row * 19 + symbol, minlength=m * 19), 19, 7, alone=False)
    out.add(stream, 15 << 1, 5)
    size = (own.table & 15).reshape(m, 19)[:, LENGTH_ORDER]
    for i, j in ((0, 10), (10, 19)):
        out.add(stream, (size[:, i:j] << np.arange(0, 3 * (j - i), 3)).sum(1), 3 * (j - i))
    out.add(stream, 15 | (np.bincount(row, minlength=m) - 2) << 4, 20)
    value, size = own.bits(row, symbol)
    out.add(stream[row], value | extra << size, size + np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0)))


def split(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number of lengths or distance codes."""
    d = np.maximum(value - 1, 1)
    high = np.frexp(d.astype(np.float64))[1] - 1
    few, less = value <= 4, np.maximum(high - 1, 0)
    return np.where(few, value - 1, 2 * high + (d >> less & 1)), np.where(few, 0, d & ((1 << less) - 1)), np.where(few, 0, less)


def references(px: np.ndarray, img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, length and distance of stretches that occurred before in their image."""
    n = len(px) - LEAST + 1
    none = (np.zeros(0, np.int64),) * 3
    if n < 2:
        return none
    step = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(n, np.uint64)
    for k in range(LEAST):
        h = (h ^ px[k : k + n]) * step
    h ^= h >> np.uint64(29)
    h *= step
    # 11 bits of image, 32 of the stretch, 21 of place: equal images have equal order
    order = np.sort(img[:n].astype(np.uint64) << np.uint64(53) | h >> np.uint64(32) << np.uint64(21) | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero((order[1:] ^ order[:-1]) >> np.uint64(21) == 0)
    far, order = np.zeros(n, np.int64), (order & np.uint64((1 << 21) - 1)).astype(np.int64)
    far[order[same + 1]] = order[same + 1] - order[same]
    at = np.flatnonzero((far > 0) & (far <= FARTHEST) & (img[:n] == img[LEAST - 1 :]))
    d = far[at]
    for k in range(LEAST):  # equal hashes are not yet equal pixels, nor of one image
        ok = (px[at + k] == px[at + k - d]) & (img[at] == img[at - d])
        at, d = at[ok], d[ok]
    if not len(at):
        return none
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (d[1:] != d[:-1])])
    size = np.diff(np.r_[head, len(at)]) + LEAST - 1
    got, end = [], 0
    for i, k, back in zip(at[head].tolist(), size.tolist(), d[head].tolist(), strict=True):
        k, i = min(k, k + i - end), max(i, end)
        while k >= LEAST:
            got.append((i, min(k, MAX_RUN), back))
            i, k, end = i + MAX_RUN, k - MAX_RUN, i + min(k, MAX_RUN)
    return tuple(np.array(got, np.int64).reshape(-1, 3).T)


def put_pixels(out: Streams, px: np.ndarray, img: np.ndarray, alpha: int, group=None, cache=None, refs=None) -> None:
    """Codes and symbols of an image in each stream; ``px`` has all images' pixels in order and ``img`` their streams. The main
    images have ``group``, ``cache`` (bits by stream) and references."""
    n = out.n
    if group is None:
        groups, code = np.ones(n, np.int64), img
    else:
        groups = np.ones(n, np.int64)
        groups[img[group > 0]] = 2
        code = starts_of(groups)[img] + group
    of_group, m = starts_of(groups), int(groups.sum())
    green = (px >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    literal, a = np.ones(len(px), bool), LITERALS + LENGTHS
    token = literal
    if cache is not None:
        key = ((px * np.uint32(HASH)) >> (32 - cache[img]).astype(np.uint32)).astype(np.int64)
        order = np.sort((img << 10 | key) << 21 | np.arange(len(px)))
        same, order = (order[1:] ^ order[:-1]) >> 21 == 0, order & ((1 << 21) - 1)
        hit, sorted_px = np.zeros(len(px), bool), px.take(order)
        hit[order[1:]] = same & (sorted_px[1:] == sorted_px[:-1])
        green = np.where(hit, LITERALS + LENGTHS + key, green)
        start, size, far = refs
        covered = np.zeros(len(px) + 1, np.int8)
        covered[start] = 1
        covered[start + size] -= 1
        covered = np.cumsum(covered[:-1], dtype=np.int8).view(bool)
        literal, token = ~hit & ~covered, ~covered
        token[start] = True
        long, back = split(size), split(np.where(far == 1, 2, far + len(NEAR)))
        green[start] = LITERALS + long[0]
        a = LITERALS + LENGTHS + (1 << int(cache.max()))
    at = np.flatnonzero(token)
    plain = at if cache is None else np.flatnonzero(literal)
    of, lit = (code, code) if cache is None else (code.take(at), code.take(plain))
    value = px.take(plain)
    reds, blues = (value >> np.uint32(16) & np.uint32(255)).astype(np.int64), (value & np.uint32(255)).astype(np.int64)
    count = lambda row, symbol, a: Codes(np.bincount(row * a + symbol, minlength=m * a), a, LONGEST)
    codes = [count(of, green.take(at), a), *(count(lit, s, 256) if s.any() else None for s in (reds, blues))]
    codes += [None, None if refs is None else count(code[start], back[0], DISTANCES)]
    for g in (0, 1):
        stream = np.flatnonzero(groups > g)
        for c, symbol in zip(codes, (0, 0, 0, alpha, 0), strict=True):
            if c is None:
                out.add(stream, 5 | symbol << 3 if symbol > 1 else 1 | symbol << 3, 11 if symbol > 1 else 4)
            else:
                put_codes(out, stream, c, of_group[stream] + g)
    value, size = codes[0].bits(of, green.take(at))
    place = slice(None) if cache is None else np.flatnonzero(literal[at])
    for c, row, s in ((codes[1], lit, reds), (codes[2], lit, blues)):
        if c is not None:
            far, more = c.bits(row, s)
            own = size[place]
            value[place] |= far << own
            size[place] = own + more
    if refs is not None:
        place = np.searchsorted(at, start)
        far, more = codes[4].bits(code[start], back[0])
        for v, k in (long[1:], (far, more), back[1:]):
            value[place] |= v << size[place]
            size[place] += k
    out.add(img.take(at), value, size)


def crossed(x: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Red and blue without what least squares by block take from green (and red), and the multipliers."""
    h, w = x.shape
    part = lambda k: (x >> np.uint32(k)).astype(np.uint8).view(np.int8).astype(np.float32)
    red, green, blue = part(16), part(8), part(0)
    cut, edge = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]), np.arange(0, w, 1 << SHIFT)
    total = lambda a, b: np.add.reduceat(np.add.reduceat(a * b, edge, axis=1), cut, axis=0).astype(np.float64)
    gg, rr, rg, bg, br = total(green, green), total(red, red), total(red, green), total(blue, green), total(blue, red)
    whole = lambda a, b: np.clip(np.rint(32 * a / np.where(b > 0, b, 1)), -128, 127).astype(np.int64) * (b > 0)
    det = gg * rr - rg * rg
    good = det > 1e-3 * gg * rr
    own = whole(rg, gg)
    from_green = np.where(good, whole(bg * rr - br * rg, det), whole(bg, gg))
    from_red = np.where(good, whole(br * gg - bg * rg, det), 0)
    image = (BLACK | (from_red & 255) << 16 | (from_green & 255) << 8 | own & 255).astype(np.uint32)
    each = np.repeat(image[blocks], 1 << SHIFT, 1)[:, :w]
    return webp._uncross(x, each, 0, -1), image


def bits_of(freq: np.ndarray) -> np.ndarray:
    """Bits that each row of frequencies takes with a code of its own: those of its symbols, and five for each length of the code."""
    cell = np.flatnonzero(freq)
    f, row = freq.ravel()[cell], cell // freq.shape[1]
    total = freq.sum(1)
    # in 1024ths of a bit and whole numbers, so that sums do not depend on their order
    return np.bincount(row, f * np.rint(1024 * np.log2(total[row] / f)) + 5 * 1024, len(freq))


def encode(images: list[np.ndarray]) -> list[bytes]:
    """A file of each image; all are opaque and of one width."""
    out, i = [], 0
    while i < len(images):
        size, j = 0, i
        while j < len(images) and j - i < MOST and (j == i or size + images[j].size <= PIXELS):
            size, j = size + images[j].size, j + 1
        out += _encode(images[i:j])
        i = j
    return out


def _encode(images: list[np.ndarray]) -> list[bytes]:
    n, w = len(images), images[0].shape[1]
    heights = np.array([len(i) for i in images])
    x, y, row_img = np.concatenate(images).astype(np.uint32), counted(heights), np.repeat(np.arange(n), heights)
    down, across = (heights + (1 << SHIFT) - 1) >> SHIFT, (w + (1 << SHIFT) - 1) >> SHIFT
    blocks = starts_of(down)[row_img] + (y >> SHIFT)
    x, colour = crossed(webp._greens(x, -1), blocks)
    x, modes, cost = predicted(x, y, blocks)
    px, img, small = x.ravel(), np.repeat(row_img, w), np.repeat(np.arange(n), down * across)
    # blocks that predictors leave more of than the image's mean get codes of their own, where that shortens the file
    size = np.bincount(blocks, minlength=len(modes))[:, None] * np.minimum(1 << SHIFT, w - np.arange(0, w, 1 << SHIFT))
    whole = (np.bincount(small, cost.ravel(), n).astype(np.int64), np.bincount(small, size.ravel(), n).astype(np.int64))
    of = small.reshape(cost.shape)
    group = (cost * whole[1][of] > whole[0][of] * size).astype(np.int64)
    each = np.repeat(group[blocks], 1 << SHIFT, 1)[:, :w].ravel()
    worth, row = np.zeros(n), (img * 2 + each) << 8
    for s in (16, 8, 0):
        freq = np.bincount(row + (px >> np.uint32(s) & np.uint32(255)), minlength=n * 512).reshape(n, 2, 256)
        worth += bits_of(freq.sum(1)) - bits_of(freq.reshape(-1, 256)).reshape(n, 2).sum(1)
    group, each = np.where(worth[of] > 0, group, 0), np.where(worth[img] > 0, each, 0)
    cache = np.clip(np.frexp((heights * w).astype(np.float64))[1] - 4, 4, 10).astype(np.int64)
    out = Streams(n)
    out.every((w - 1) | (heights - 1) << 14 | 1 << 28, 32)
    out.every(1 | GREEN << 1, 3)
    out.every(1 | CROSS << 1 | (SHIFT - 2) << 3, 7)  # the last bit: no cache
    put_pixels(out, colour.ravel(), small, 255)
    out.every(1 | PREDICT << 1 | (SHIFT - 2) << 3, 7)
    put_pixels(out, (modes.ravel() << 8).astype(np.uint32), small, 255)
    out.every(cache << 2 | 1 << 1, 6)  # no more transforms, a cache of so many bits
    out.every(1 | (SHIFT - 2) << 1, 5)  # groups; their image has no cache
    put_pixels(out, (group.ravel() << 8).astype(np.uint32), small, 0)
    put_pixels(out, px, img, 0, each, cache, references(px, img))
    done = []
    for body in out.bytes():
        body = b"\x2f" + body
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        done.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return done


# --- decoding ---------------------------------------------------------------------------------------------

REACH = np.array([(0, 0), *NEAR])


class Walk:
    """The bits of many streams, each with its own place."""

    def __init__(self, bodies: list[bytes]):
        size = np.array([len(b) for b in bodies])
        self.at = starts_of(size) * 8
        self.end = self.at + size * 8
        self.data = b"".join(bodies) + b"\0" * 64
        self.words = np.ascontiguousarray(np.ndarray(len(self.data) - 7, "<i8", self.data, 0, (1,)))

    def look(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from a place on."""
        return self.words.take(at >> 3) >> (at & 7)

    def take(self, idx: np.ndarray, n) -> np.ndarray:
        at = self.at[idx]
        self.at[idx] = at + n
        return self.look(at) & ((1 << n) - 1)

    def code(self, idx: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
        """Lengths of the next code of each stream."""
        m = len(idx)
        out = np.zeros((m, int(alphabet.max())), np.int32)
        simple = self.take(idx, 1) > 0
        if simple.any():
            row, s = np.flatnonzero(simple), idx[simple]
            two, wide = self.take(s, 1) > 0, self.take(s, 1)
            out[row, self.take(s, 1 + 7 * wide)] = 1
            out[row[two], self.take(s[two], 8)] = 1
        row, s = np.flatnonzero(~simple), idx[~simple]
        if not len(row):
            return out
        given, own = 4 + self.take(s, 4), np.zeros((len(row), 19), np.int64)
        for i in range(19):
            more = given > i
            own[more, LENGTH_ORDER[i]] = self.take(s[more], 3)
        tables = Tables()
        start, mask = tables.add(own)
        table = tables.all()
        some = self.take(s, 1) > 0
        left = alphabet[row].astype(np.int64)
        n = 2 + 2 * self.take(s[some], 3)
        left[some] = 2 + self.take(s[some], n)
        limit, place, before, at = alphabet[row].astype(np.int64), np.zeros(len(row), np.int64), np.full(len(row), 8), self.at[s]
        live, runs = np.arange(len(row)), []
        while True:
            go = (left > 0) & (place < limit)
            if 5 * np.count_nonzero(go) < 4 * len(go) or not go.any():
                self.at[s[live]] = at
                live, left, limit, place, before, at, start, mask, go = (v[go] for v in (live, left, limit, place, before, at, start, mask, go))
                if not len(live):
                    break
            w = self.look(at)
            e = table.take(start + (w & mask))
            symbol, size = e >> 4, e & 15
            times = go.astype(np.int64)
            q = np.flatnonzero(symbol > 15)
            if len(q):
                kind = symbol[q] - 16
                more = np.array([2, 3, 7])[kind]
                times[q] *= (w[q] >> size[q] & ((1 << more) - 1)) + np.array([3, 3, 11])[kind]
                size[q] += more
                symbol[q] = np.where(kind == 0, before[q], 0)
            new = np.flatnonzero((symbol > 0) & go)
            runs.append((live[new], place[new], times[new], symbol[new]))
            before = np.where(symbol > 0, symbol, before)
            at = at + size * go
            place = place + times
            left = left - 1
        live, place, times, symbol = (np.concatenate(v) for v in zip(*runs, strict=True))
        where = np.repeat(place, times) + counted(times)
        ok = where < out.shape[1]
        out[np.repeat(row[live], times)[ok], where[ok]] = np.repeat(symbol, times)[ok]
        return out

    def pixels(self, idx: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pixels of an image in each stream, one image after another, and where each begins. Main images are of one width."""
        m, total = len(idx), width * height
        cached = self.take(idx, 1) > 0
        cache_bits = np.zeros(m, np.int64)
        cache_bits[cached] = self.take(idx[cached], 4)
        groups, meta, begin, shift, across = np.ones(m, np.int64), np.zeros(1, np.int64), np.zeros(m, np.int64), np.full(m, 20), np.zeros(m, np.int64)
        if main:
            several = self.take(idx, 1) > 0
            s = idx[several]
            if len(s):
                shift[several] = k = self.take(s, 3) + 2
                across[several] = a = (width[several] + (1 << k) - 1) >> k
                image, first = self.pixels(s, a, (height[several] + (1 << k) - 1) >> k, False)
                meta = np.append((image >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64), 0)
                groups[several] = np.maximum.reduceat(meta, first) + 1
                begin[:] = len(meta) - 1
                begin[several] = first
        tables, most = Tables(), int(groups.max())
        start, mask = np.zeros((2, 5, m, most), np.int64)
        green = LITERALS + LENGTHS + np.where(cached, 1 << cache_bits, 0)
        for g in range(most):
            own = np.flatnonzero(groups > g)
            for k, size in enumerate((green[own], 256, 256, 256, DISTANCES)):
                start[k, own, g], mask[k, own, g] = tables.add(self.code(idx[own], np.broadcast_to(size, own.shape)))
        table = tables.all()
        # the largest first, so that those with pixels left are a beginning
        order = np.argsort(-total, kind="stable")
        total, idx, begin, shift, across, start, mask = total[order], idx[order], begin[order], shift[order], across[order], start[:, order], mask[:, order]
        base = starts_of(total)
        out, at = np.zeros(int(total.sum()), np.uint32), self.at[idx]
        slots, left, far, wide = np.where(cached, cache_bits, 1)[order], np.zeros(m, np.int64), np.zeros(m, np.int64), width[order]
        keys, down = starts_of(1 << slots), (32 - slots).astype(np.uint32)
        cache, caching = np.zeros(int((1 << slots).sum()), np.uint32), bool(cached.any())
        opaque = not mask[3].any()
        step, k, every = (1 << int(shift.min())) - 1, m, np.arange(m)
        first = [start[i, :, 0] for i in range(5)]
        masks = [mask[i, :, 0] for i in range(5)]
        alphas = (table[first[3]] >> 4).astype(np.uint32) << np.uint32(24)
        for t in range(int(total[0])):
            while total[k - 1] <= t:
                k -= 1
            if k <= FEW:
                for i in range(k):
                    area = meta[begin[i] :] if most > 1 else None
                    own = [[(table[a : a + b + 1].tolist(), b) for a, b in zip(start[:, i, g].tolist(), mask[:, i, g].tolist(), strict=True)] for g in range(int(groups[order[i]]))]
                    hold = cache[keys[i] : keys[i] + (1 << slots[i])].tolist()
                    at[i] = self._finish(out[base[i] : base[i] + total[i]], t, int(at[i]), own, area, int(shift[i]), int(across[i]), int(wide[i]), hold, int(left[i]), int(far[i]))
                break
            if most > 1:
                column = t % int(wide[0])
                if column & step == 0:
                    g = meta[begin[:k] + (t // int(wide[0]) >> shift[:k]) * across[:k] + (column >> shift[:k])]
                    first, masks = ([v[i, every[:k], g] for i in range(5)] for v in (start, mask))
                    alphas = (table[first[3]] >> 4).astype(np.uint32) << np.uint32(24)
            a = at[:k]
            w = self.look(a)
            e = table.take(first[0][:k] + (w & masks[0][:k]))
            symbol, size = e >> 4, e & 15
            red = table.take(first[1][:k] + (w >> size & masks[1][:k]))
            size = size + (red & 15)
            blue = table.take(first[2][:k] + (w >> size & masks[2][:k]))
            size = size + (blue & 15)
            value = ((red >> 4) << 16 | symbol << 8 | blue >> 4).view(np.uint32)
            if opaque:
                value |= alphas[:k]
            else:
                alpha = table[first[3][:k] + (w >> size & masks[3][:k])]
                size = size + (alpha & 15)
                value |= (alpha >> 4).astype(np.uint32) << np.uint32(24)
            q = ((symbol >= LITERALS) | (left[:k] > 0)).nonzero()[0]
            if len(q):
                size[q] = e[q] & 15
                copies = left[q] > 0
                size[q[copies]] = 0
                old = q[~copies & (symbol[q] >= LITERALS + LENGTHS)]
                value[old] = cache[keys[old] + symbol[old] - (LITERALS + LENGTHS)]
                new = q[~copies & (symbol[q] < LITERALS + LENGTHS)]
                if len(new):
                    to = a[new] + size[new]
                    left[new], to = self._value(to, symbol[new] - LITERALS)
                    e = table[first[4][new] + (self.look(to) & masks[4][new])]
                    code, to = self._value(to + (e & 15), e >> 4)
                    near = REACH[np.where(code > len(NEAR), 0, code)]
                    far[new] = np.where(code > len(NEAR), code - len(NEAR), np.maximum(1, near[:, 0] + near[:, 1] * wide[new]))
                    if (far[new] > t).any():
                        raise ValueError("a reference before the first pixel")
                    size[new] = to - a[new]
                q = q[left[q] > 0]
                value[q] = out[base[q] + t - far[q]]
                left[q] -= 1
            at[:k] += size
            out[base[:k] + t] = value
            if caching:
                cache[keys[:k] + ((value * np.uint32(HASH)) >> down[:k])] = value
        if (at > self.end[idx]).any():
            raise ValueError("the stream ends early")
        self.at[idx] = at
        # back in the order asked for
        place = np.empty(m, np.int64)
        place[order] = base
        total = (width * height).astype(np.int64)
        return out[np.repeat(place, total) + counted(total)], starts_of(total)

    def _finish(self, out: np.ndarray, n: int, at: int, groups: list, area, shift: int, across: int, width: int, cache: list, left: int, far: int) -> int:
        """The pixels of one stream from the ``n``-th on, symbol by symbol, and the place after them."""
        data, total, px, until = self.data, len(out), out[:n].tolist(), n
        down, whole = 33 - len(cache).bit_length(), (1 << shift) - 1

        def number(at, prefix):
            if prefix < 4:
                return prefix + 1, at
            extra = (prefix - 2) >> 1
            more = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << extra) - 1)
            return ((2 + (prefix & 1)) << extra) + more + 1, at + extra

        (green, gm), (red, rm), (blue, bm), (alpha, am), (away, dm) = groups[0]
        while n < total:
            if left:
                left = min(left, total - n)
                got = px[n - far : n - far + left]
                got = got if far >= left else (got * (left // far + 1))[:left]
                px += got
                for v in got[-far:]:
                    cache[(v * HASH & 0xFFFFFFFF) >> down] = v
                n, left = n + left, 0
                continue
            if area is not None and n >= until:
                x = n % width
                (green, gm), (red, rm), (blue, bm), (alpha, am), (away, dm) = groups[int(area[(n // width >> shift) * across + (x >> shift)])]
                until = n + min(whole + 1 - (x & whole), width - x)
            i = at >> 3
            w = int.from_bytes(data[i : i + 8], "little") >> (at & 7)
            e = green[w & gm]
            s, size = e >> 4, e & 15
            if s < LITERALS:
                r = red[w >> size & rm]
                size += r & 15
                b = blue[w >> size & bm]
                size += b & 15
                a = alpha[w >> size & am]
                at += size + (a & 15)
                v = (a >> 4) << 24 | (r >> 4) << 16 | s << 8 | b >> 4
            elif s >= LITERALS + LENGTHS:
                at += size
                v = cache[s - LITERALS - LENGTHS]
            else:
                left, at = number(at + size, s - LITERALS)
                e = away[int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & dm]
                far, at = number(at + (e & 15), e >> 4)
                far = webp._distance(far, width)
                if far > n:
                    raise ValueError("a reference before the first pixel")
                continue
            px.append(v)
            cache[(v * HASH & 0xFFFFFFFF) >> down] = v
            n += 1
        out[:] = px
        return at

    def _value(self, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths or distance codes and the places after them."""
        prefix = prefix.astype(np.int64)
        extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        more = self.look(at) & ((1 << extra) - 1)
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), at + extra


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Pixels of each file."""
    out, many, rows = [None] * len(files), {}, {}
    for i, f in enumerate(files):
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
        size = int.from_bytes(f[21:25], "little")
        w, h = (size & 0x3FFF) + 1, (size >> 14 & 0x3FFF) + 1
        lists = many.setdefault(w, [[]])
        if len(lists[-1]) == READ_MOST or lists[-1] and (rows[w] + h) * w > READ_PIXELS:
            lists.append([])
        rows[w] = h + (rows[w] if lists[-1] else 0)
        lists[-1].append((i, h))
    for w, lists in many.items():
        for some in lists:
            try:
                images = _decode([files[i] for i, _ in some], w, np.array([h for _, h in some]))
            except IndexError as e:
                raise ValueError("a stream ends early") from e
            for i, image in images.items():
                out[some[i][0]] = image
    return [webp.decode(f) if image is None else image for f, image in zip(files, out, strict=True)]


def _decode(files: list[bytes], w: int, heights: np.ndarray) -> dict[int, np.ndarray]:
    """Images of one width, without those that have a palette."""
    walk = Walk([f[25 : 20 + struct.unpack("<I", f[16:20])[0]] for f in files])
    idx = np.arange(len(files))
    steps, on, whole = [], idx, np.ones(len(files), bool)
    while True:
        on = on[walk.take(on, 1) > 0]
        if not len(on):
            break
        kind = walk.take(on, 2)
        for k in (PREDICT, CROSS, GREEN):
            s = on[kind == k]
            if not len(s):
                continue
            if k == GREEN:
                steps.append((k, s, None, None, None))
                continue
            shift = walk.take(s, 3) + 2
            image, begin = walk.pixels(s, (w + (1 << shift) - 1) >> shift, (heights[s] + (1 << shift) - 1) >> shift, False)
            steps.append((k, s, image, begin, shift))
        whole[on[kind == PALETTE]] = False
        on = on[kind != PALETTE]
    idx = np.flatnonzero(whole)
    if not len(idx):
        return {}
    x, _ = walk.pixels(idx, np.full(len(idx), w), heights[idx], True)
    x, rows = x.reshape(-1, w), np.repeat(idx, heights[idx])
    y = counted(heights[idx])
    for k, s, image, begin, shift in reversed(steps):
        if k == GREEN:
            own = np.isin(rows, s)
            x[own] = webp._greens(x[own], 1)
            continue
        for size in np.unique(shift).tolist():
            place = np.full(len(files), -1)
            place[s[shift == size]] = begin[shift == size]
            own = np.flatnonzero(place[rows] >= 0)
            across = (w + (1 << size) - 1) >> size
            each = image[(place[rows[own]] + (y[own] >> size) * across)[:, None] + np.arange(across)]
            if k == PREDICT:
                x[own] = unpredict(x[own], y[own], (each >> np.uint32(8) & np.uint32(15)).astype(np.int64), size)
            else:
                x[own] = webp._uncross(x[own], np.repeat(each, 1 << size, 1)[:, :w], 0)
    cut = starts_of(heights[idx]).tolist()
    return {i: x[a : a + h] for i, a, h in zip(idx.tolist(), cut, heights[idx].tolist(), strict=True)}
