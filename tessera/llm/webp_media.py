"""Operator 5: lossless WebP media columns (VP8L, as published in RFC 9649).

``decode`` reads any lossless still image: prefix codes (one group or many), literals,
back-references, colour cache, and the predictor, cross-colour, subtract-green and
palette transforms, which it inverts to pixel arrays.  Runs of literals are decoded
with arrays: for every bit position a table gives how many bits the pixel that would
start there takes, a short walk picks the positions where pixels do start, and one
gather fetches their symbols.  ``encode`` writes such images with any of the transforms.

The media column stores a byte payload as 8-bit grey samples, 64 to a row, in
images of at most 16,384 rows (the format's limit); a longer payload is a sequence of
images, so no image grows with the text.  The images are written to a table and decoded
from what is read of it.

Defined results: a null text is an empty one (one row of zero bytes); repeated rows are
kept, and equal texts give equal values; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

# fixed values of the format
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
HASH = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Neighbourhood of the 120 short distance codes, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
MOST_SIDE = 1 << 14
ROW = 64


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(8), 0

    def read(self, n: int) -> int:
        at = self.at
        if at + n > (len(self.data) - 8) * 8:
            raise ValueError("truncated image")
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)


class Code:
    """A canonical prefix code: tables from the next bits to symbol and length."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.symbols, self.lengths = 0, np.array([used[0] if len(used) else 0]), np.zeros(1, np.uint8)
            return
        order = used[np.argsort(lengths[used], kind="stable")]
        sizes = lengths[order].astype(np.int64)
        self.bits = top = int(sizes[-1])
        spans = 1 << (top - sizes)
        if int(spans.sum()) != 1 << top:
            raise ValueError("a prefix code is not complete")
        index = reversal(top)
        self.symbols = np.empty(1 << top, np.int64)
        self.lengths = np.empty(1 << top, np.uint8)
        self.symbols[index] = np.repeat(order, spans)
        self.lengths[index] = np.repeat(sizes, spans)

    def next(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.symbols[0])
        at = bits.at
        w = (int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & ((1 << self.bits) - 1)
        bits.read(int(self.lengths[w]))
        return int(self.symbols[w])


@cache
def reversal(n: int) -> np.ndarray:
    """The n-bit numbers with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    lens = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        lens[k] = bits.read(3)
    outer = Code(lens)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    # a symbol and its extra bits are 14 bits at most: one look at the next bytes is enough for both
    symbols, steps, mask = outer.symbols.tolist(), outer.lengths.tolist(), (1 << outer.bits) - 1
    data, place, at, last = bits.data, bits.at, 0, 8
    while at < size and left:
        left -= 1
        w = int.from_bytes(data[place >> 3 : (place >> 3) + 3], "little") >> (place & 7)
        s, n = symbols[w & mask], steps[w & mask]
        place += n
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
            continue
        extra, least, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
        times = least + (w >> n & ((1 << extra) - 1))
        place += extra
        if at + times > size:
            raise ValueError("too many code lengths")
        lengths[at : at + times] = [value] * times
        at += times
    if place > (len(data) - 8) * 8:
        raise ValueError("truncated image")
    bits.at = place
    return Code(lengths)


def extra_value(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


class _Runs:
    """Literal runs of an image with one code group, decoded with arrays."""

    def __init__(self, bits: Bits, group, total: int):
        self.bits, self.group, self.start = bits, group, bits.at >> 3
        most = total * (sum(c.bits for c in group) + 32) // 8 + 16  # bytes that so many symbols can take
        data = np.frombuffer(bits.data, np.uint8)[self.start : self.start + most]
        word = data[:-3].astype(np.uint32) | data[1:-2].astype(np.uint32) << 8 | data[2:-1].astype(np.uint32) << 16 | data[3:].astype(np.uint32) << 24
        self.window = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
        self.n = len(self.window)
        green, rest = group[0], [c for c in group[1:4] if c.bits]
        w = self.window & ((1 << green.bits) - 1)
        step = green.lengths[w]
        if rest:
            at = np.minimum(np.arange(self.n) + step, self.n - 1)
            for c in rest:
                at = np.minimum(at + c.lengths[self.window[at] & ((1 << c.bits) - 1)], self.n - 1)
            step = (at - np.arange(self.n)).astype(np.uint8)
        ahead = np.arange(self.n, dtype=np.int32)
        # where the next pixel starts; a symbol that is no literal stays where it is
        self.still = not (green.bits or rest)  # every pixel is the same, without a bit
        if len(green.symbols) > 1 and (green.symbols >= 256).any():
            step = np.where(green.symbols[w] >= 256, 0, step)
        self.next = np.minimum(ahead + step, self.n - 1)
        two = self.next[self.next]
        self.four = (two[two] - ahead).astype(np.uint8).tobytes()  # four pixels take 240 bits at most

    def take(self, most: int) -> np.ndarray:
        """Pixels up to the next symbol that is no literal, ``most`` at most."""
        green = self.group[0]
        if self.still:
            places = np.zeros(most if green.symbols[0] < 256 else 0, np.int64)
        else:
            four, at, walk = self.four, self.bits.at - 8 * self.start, []
            put = walk.append
            for _ in range(-(-most // 4)):
                put(at)
                n = four[at]
                if not n:
                    break
                at += n
            every = np.empty((len(walk), 5), np.int64)
            every[:, 0] = walk
            for k in range(4):
                every[:, k + 1] = self.next[every[:, k]]
            moved = (every[:, 1:] != every[:, :-1]).ravel()
            places, after = every[:, :-1].ravel()[moved][:most], every[:, 1:].ravel()[moved][:most]
            at = int(after[-1]) if len(after) else at
            if at + 8 * self.start > (len(self.bits.data) - 8) * 8:
                raise ValueError("truncated image")
            self.bits.at = at + 8 * self.start
        out = np.zeros(len(places), np.uint32)
        for c, shift in zip(self.group[:4], (8, 16, 0, 24)):
            if c.bits:
                w = self.window[places] & ((1 << c.bits) - 1)
                out |= c.symbols[w].astype(np.uint32) << np.uint32(shift)
                places = places + c.lengths[w]
            else:
                out |= np.uint32(int(c.symbols[0]) << shift)
        return out


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as 32-bit ARGB values in scan order."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = (read_pixels(bits, -(-width >> shift), -(-height >> shift), False) >> 8 & 0xFFFF).astype(np.int64)
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    groups = [[read_code(bits, n) for n in sizes] for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    colours = np.zeros(1 << cache_bits, np.uint32) if cache_bits else None
    slot = lambda v: (v.astype(np.uint64) * HASH & 0xFFFFFFFF).astype(np.int64) >> (32 - cache_bits)
    total = width * height
    out = np.zeros(total, np.uint32)
    runs = _Runs(bits, groups[0], total) if meta is None else None
    at = 0
    while at < total:
        if meta is None:
            group = groups[0]
            got = runs.take(total - at)
            out[at : at + len(got)] = got
            if cache_bits and len(got):
                colours[slot(got)] = got
            at += len(got)
            if at == total:
                break
        else:
            group = groups[int(meta[(at // width >> shift) * -(-width >> shift) + (at % width >> shift)])]
        s = group[0].next(bits)
        begin = at
        if s < 256:
            red, blue = group[1].next(bits), group[2].next(bits)
            out[at] = group[3].next(bits) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            n = extra_value(bits, s - 256)
            far = extra_value(bits, group[4].next(bits))
            if far > 120:
                far -= 120
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            out[at : at + n] = np.resize(out[at - far : at - far + min(n, far)], n)
            at += n
        else:
            if s - 280 >= 1 << cache_bits or not cache_bits:
                raise ValueError("no such colour in the cache")
            out[at] = colours[s - 280]
            at += 1
        if cache_bits:
            colours[slot(out[begin:at])] = out[begin:at]
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb).astype("<u4").view(np.uint8).reshape(*argb.shape, 4).astype(np.int32)


def _signed(v):
    return v.astype(np.int8).astype(np.int32)


def predict(mode: int, left, top, right, corner):
    """The predicted pixel; neighbours are channel arrays, ``right`` is above to the right."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 11:
        pa_, pb = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if pa_ < pb else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = mean(left, top)
        return np.clip(a + np.trunc((a - corner) / 2).astype(np.int32), 0, 255)
    table = {0: lambda: np.array([0, 0, 0, 255]), 1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top), 8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right))}
    return table.get(mode, table[0])()


def _predictor(pixels: np.ndarray, modes: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """Add (or take away) predictions in scan order; ``pixels`` is (height, width, 4)."""
    h, w, _ = pixels.shape
    uniform = np.unique(modes)
    if inverse and len(uniform) == 1 and uniform[0] in (1, 2):
        return _sum_up(pixels, int(uniform[0]))
    out = pixels.copy()
    whole = out if inverse else pixels  # what predictions look at
    flat = whole.reshape(-1, 4)
    for y in range(h):
        if y:
            row_modes = np.unique(modes[y >> shift])
            if len(row_modes) == 1 and row_modes[0] in (2, 3, 4, 8, 9) and w > 1:  # nothing in the row depends on the row, but for its first pixel
                flat_at = y * w
                first = whole[y - 1, 0]
                out[y, 0] = (pixels[y, 0] + (first if inverse else -first)) & 255
                k = np.arange(1, w)
                t, r, c = flat[flat_at - w + k], flat[flat_at - w + k + 1], flat[flat_at - w + k - 1]
                p = predict(int(row_modes[0]), None, t, r, c)
                out[y, 1:] = (pixels[y, 1:] + (p if inverse else -p)) & 255
                continue
        for x in range(w):
            i = y * w + x
            if not y:
                p = flat[i - 1] if x else np.array([0, 0, 0, 255])
            elif not x:
                p = flat[i - w]
            else:
                p = predict(int(modes[y >> shift, x >> shift]), flat[i - 1], flat[i - w], flat[i - w + 1], flat[i - w - 1])
            out[y, x] = (pixels[y, x] + (p if inverse else -p)) & 255
    return out


def _sum_up(pixels: np.ndarray, mode: int) -> np.ndarray:
    """The inverse where every pixel is predicted by its left (1) or upper (2) neighbour: running sums."""
    out = pixels.copy()
    out[0, 0] += (0, 0, 0, 255)
    out[0] = np.cumsum(out[0], axis=0)
    if mode == 2:
        return np.cumsum(out, axis=0) & 255
    out[:, 0] = np.cumsum(out[:, 0], axis=0)
    out[1:] = np.cumsum(out[1:], axis=1)
    return out & 255


def _cross_colour(px: np.ndarray, table: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    h, w, _ = px.shape
    el = _channels(table)[np.arange(h)[:, None] >> shift, np.arange(w)[None, :] >> shift]
    green_red, green_blue, red_blue = _signed(el[..., 0]), _signed(el[..., 1]), _signed(el[..., 2])
    out, green = px.copy(), _signed(px[..., 1])
    delta = lambda t, c: (t * c) >> 5
    if inverse:
        out[..., 2] = (px[..., 2] + delta(green_red, green)) & 255
        out[..., 0] = (px[..., 0] + delta(green_blue, green) + delta(red_blue, _signed(out[..., 2]))) & 255
    else:
        out[..., 2] = (px[..., 2] - delta(green_red, green)) & 255
        out[..., 0] = (px[..., 0] - delta(green_blue, green) - delta(red_blue, _signed(px[..., 2]))) & 255
    return out


def _argb(px: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(px.astype(np.uint8)).view("<u4").reshape(px.shape[:2])


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """Pixels of one lossless WebP file as (height, width) ARGB values."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[20 : 20 + int.from_bytes(data[16:20], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, *_ in undo):
            raise ValueError("a transform is repeated")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            tw, th = -(-w >> shift), -(-height >> shift)
            undo.append((kind, shift, read_pixels(bits, tw, th, False).reshape(th, tw), w))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _channels(read_pixels(bits, n, 1, False))
            undo.append((kind, bundle_bits(n), _argb((np.cumsum(steps, axis=0) & 255)[None])[0], w))
            w = -(-w >> bundle_bits(n))
        else:
            undo.append((kind, 0, None, w))
    image = read_pixels(bits, w, height, True).reshape(height, w)
    for kind, shift, table, tw in reversed(undo):
        if kind == PALETTE:
            index = (image >> 8 & 0xFF).astype(np.int64)
            if shift:
                per, each = 1 << shift, 8 >> shift
                index = ((index[..., None] >> (np.arange(per) * each)) & ((1 << each) - 1)).reshape(height, -1)[:, :tw]
            image = np.append(table, np.zeros(256, np.uint32))[index].astype(np.uint32)
        elif kind == SUBTRACT_GREEN:
            green = image >> 8 & 0xFF
            image = (image & 0xFF00FF00) | ((image & 0x00FF00FF) + (green << 16 | green) & 0x00FF00FF)
        elif kind == PREDICTOR:
            image = _argb(_predictor(_channels(image), (table >> 8 & 0xFF).astype(np.int64), shift, True))
        else:
            image = _argb(_cross_colour(_channels(image), table, shift, True))
    return image


# --- writing ---------------------------------------------------------------------


class BitWriter:
    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n
        if self.size > 4096:
            self.flush()

    def flush(self) -> None:
        raw = np.frombuffer(self.value.to_bytes(-(-self.size // 8), "little"), np.uint8)
        self.parts.append(np.unpackbits(raw, count=self.size, bitorder="little"))
        self.value = self.size = 0

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many values of their own sizes, one behind the other."""
        self.flush()
        if not len(sizes):
            return
        ends = np.cumsum(sizes, dtype=np.int64)
        starts, v = ends - sizes, values.astype(np.uint64)
        words, at, off = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64), starts >> 6, (starts & 63).astype(np.uint64)
        np.add.at(words, at, v << off)
        np.add.at(words, at + 1, (v >> np.uint64(1)) >> (np.uint64(63) - off))  # what a word has no room for
        self.parts.append(np.unpackbits(words.view(np.uint8), count=int(ends[-1]), bitorder="little"))

    def bytes(self) -> bytes:
        self.flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes() if self.parts else b""


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code for these counts, none above ``most``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    floor = 0
    while True:
        heap = [(max(int(counts[s]), floor), k, None) for k, s in enumerate(used.tolist())]
        heapq.heapify(heap)
        serial = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], serial, (a, b)))
            serial += 1
        stack, deepest = [(heap[0], 0)], 0
        while stack:
            (_, k, kids), d = stack.pop()
            if kids is None:
                out[used[k]] = d
                deepest = max(deepest, d)
            else:
                stack += [(kids[0], d + 1), (kids[1], d + 1)]
        if deepest <= most:
            return out
        floor = max(2 * floor, int(counts.sum()) >> 14, 1)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol, first bit lowest."""
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    sizes, out = lengths[order].astype(np.int64), np.zeros(len(lengths), np.int64)
    if len(order) > 1:
        top = int(sizes[-1])
        firsts = np.concatenate([[0], np.cumsum(1 << (top - sizes))[:-1]]) >> (top - sizes)
        for n in np.unique(sizes).tolist():
            out[order[sizes == n]] = reversal(n)[firsts[sizes == n]]
    return out


def write_code(w: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for the counts; the symbols' bits and sizes."""
    used = np.flatnonzero(counts)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in symbols:
            w.put(s, 8)
        sizes = np.zeros(len(counts), np.int64)
        if len(symbols) == 2:
            sizes[symbols] = 1
        return canonical(sizes), sizes
    sizes = code_lengths(counts)
    w.put(0, 1)
    plain: list[tuple[int, int, int]] = []  # symbol, extra, extra bits
    k, each = 0, sizes[: int(used[-1]) + 1].tolist()
    for at in [*used.tolist(), None]:
        run = (at if at is not None else len(each)) - k
        while run > 2:  # zeros
            n = min(run, 138)
            plain.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            run -= n
        plain += [(0, 0, 0)] * run
        if at is not None:
            plain.append((each[at], 0, 0))
            k = at + 1
    outer = np.bincount([p[0] for p in plain], minlength=19)
    lens = code_lengths(outer, 7)
    many = max(k for k, s in enumerate(LENGTH_ORDER) if lens[s]) + 1
    w.put(max(many, 4) - 4, 4)
    for s in LENGTH_ORDER[: max(many, 4)]:
        w.put(int(lens[s]), 3)
    w.put(1, 1)  # as many code lengths as follow, not the whole alphabet
    w.put(7, 3)
    w.put(len(plain) - 2, 16)
    code = canonical(lens)
    if np.count_nonzero(lens) < 2:
        lens = np.zeros_like(lens)
    symbols, extra, n = np.array(plain, np.int64).T
    w.put_all(np.stack([code[symbols], extra], axis=1).ravel(), np.stack([lens[symbols], n], axis=1).ravel())
    if np.count_nonzero(sizes) < 2:
        sizes = np.zeros_like(sizes)
    return canonical(sizes), sizes


def _prefix(v: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits' value and their number of a length or distance."""
    if v <= 4:
        return v - 1, 0, 0
    v -= 1
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def _write_symbols(w: BitWriter, px: np.ndarray, matches) -> None:
    """Literals and back-references without a colour cache: all symbols at once."""
    plain, refs = np.ones(len(px), bool), np.zeros((0, 6), np.int64)
    if matches:
        for at, n, _ in matches:
            plain[at : at + n] = False
        refs = np.array([(*_prefix(n), *_prefix(far + 120)) for _, n, far in matches], np.int64)
    places = np.flatnonzero(plain)
    lit = px if not matches else px[places]
    chans, other = [(lit >> 8 & 0xFF).astype(np.int64)], lit & np.uint32(0xFFFF00FF)
    grey = bool(len(lit)) and bool((other == other[0]).all())
    # the other channels of grey images have one value each
    chans += [(other[:1] if grey else lit) >> s & 0xFF for s in (16, 0, 24)]
    counts = np.bincount(chans[0], minlength=ALPHABETS[0])
    if len(refs):
        counts += np.bincount(256 + refs[:, 0], minlength=ALPHABETS[0])
    codes = [write_code(w, counts)]
    for c in chans[1:]:
        same = not len(c) or bool((c == c[0]).all())
        codes.append(_write_one(w, int(c[0]) if len(c) else 0) if same else write_code(w, np.bincount(c, minlength=256)))
    far = write_code(w, np.bincount(refs[:, 3], minlength=ALPHABETS[4])) if len(refs) else _write_one(w, 0)
    used = [(c, code) for c, code in zip(chans, codes) if code is not None and code[1].any()]
    if not used and not len(refs):
        return
    values, sizes = (np.stack([code[k][c] for c, code in used], axis=1) if used else np.zeros((len(lit), 1), np.int64) for k in (0, 1))
    if len(refs):
        # a reference is four values: length symbol and its extra bits, distance symbol and its
        own = [np.stack([codes[0][k][256 + refs[:, 0]], refs[:, 1 + k], far[k][refs[:, 3]], refs[:, 4 + k]], axis=1) for k in (0, 1)]
        wide = max(4, values.shape[1])
        place = np.argsort(np.concatenate([places, [at for at, *_ in matches]]), kind="stable")
        values, sizes = (np.concatenate([np.pad(a, ((0, 0), (0, wide - a.shape[1]))), np.pad(b, ((0, 0), (0, wide - 4)))])[place] for a, b in zip((values, sizes), own))
    w.put_all(values.ravel(), sizes.ravel())


def _write_one(w: BitWriter, symbol: int) -> None:
    """The code of a channel that has one value; it takes no bits."""
    w.put(1 | 1 << 2 | symbol << 3, 11)


def write_pixels(w: BitWriter, argb: np.ndarray, main: bool, matches=(), cache_bits: int = 0) -> None:
    """An entropy-coded image.  ``matches``: (place, length, distance), in order and apart."""
    px = argb.ravel()
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    if not cache_bits:
        _write_symbols(w, px, matches)
        return
    stream, at, cache = [], 0, {}
    slot = lambda v: (int(v) * HASH & 0xFFFFFFFF) >> (32 - cache_bits)
    todo = list(matches)
    while at < len(px):
        if todo and todo[0][0] == at:
            _, n, far = todo.pop(0)
            stream.append((256 + _prefix(n)[0], _prefix(n), _prefix(far + 120)))
            if cache_bits:
                cache.update((slot(v), int(v)) for v in px[at : at + n])
            at += n
            continue
        v = int(px[at])
        if cache_bits and cache.get(slot(v)) == v:
            stream.append((280 + slot(v), None, None))
        else:
            stream.append((v >> 8 & 0xFF, v, None))
        if cache_bits:
            cache[slot(v)] = v
        at += 1
    sizes = (ALPHABETS[0] + (1 << cache_bits if cache_bits else 0), *ALPHABETS[1:])
    counts = [np.zeros(n, np.int64) for n in sizes]
    for s, what, far in stream:
        counts[0][s] += 1
        if s < 256:
            for c, shift in ((1, 16), (2, 0), (3, 24)):
                counts[c][what >> shift & 0xFF] += 1
        elif far:
            counts[4][far[0]] += 1
    codes = [write_code(w, c) for c in counts]
    put = lambda c, s: w.put(int(codes[c][0][s]), int(codes[c][1][s]))
    for s, what, far in stream:
        put(0, s)
        if s < 256:
            for c, shift in ((1, 16), (2, 0), (3, 24)):
                put(c, what >> shift & 0xFF)
        elif far:
            w.put(what[1], what[2])
            put(4, far[0])
            w.put(far[1], far[2])


def encode(argb: np.ndarray, transforms=(), matches=(), cache_bits: int = 0) -> bytes:
    """A lossless WebP file of (height, width) ARGB values.

    ``transforms``, in the order applied: ("palette",), ("subtract_green",),
    ("predictor", bits, modes array) and ("cross_colour", bits, element array).
    """
    image = np.asarray(argb, dtype=np.uint32)
    height, width = image.shape
    w = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    for kind, *args in transforms:
        w.put(1, 1)
        if kind == "palette":
            colours, index = np.unique(image, return_inverse=True)
            index = index.reshape(image.shape)
            w.put(PALETTE, 2)
            w.put(len(colours) - 1, 8)
            write_pixels(w, _argb(np.diff(_channels(colours), axis=0, prepend=0)[None] & 255), False)
            if shift := bundle_bits(len(colours)):
                per, each = 1 << shift, 8 >> shift
                index = np.pad(index, ((0, 0), (0, -index.shape[1] % per))).reshape(height, -1, per)
                index = (index << (np.arange(per) * each)).sum(axis=2)
            image = (index.astype(np.uint32) << 8) | np.uint32(0xFF000000)
        elif kind == "subtract_green":
            w.put(SUBTRACT_GREEN, 2)
            green = image >> 8 & 0xFF
            image = (image & 0xFF00FF00) | ((image | 0x01000100) - (green << 16 | green) & 0x00FF00FF)
        else:
            shift, table = args
            w.put(PREDICTOR if kind == "predictor" else CROSS_COLOUR, 2)
            w.put(shift - 2, 3)
            if kind == "predictor":
                write_pixels(w, (np.asarray(table).astype(np.uint32) << 8) | np.uint32(0xFF000000), False)
                image = _argb(_predictor(_channels(image), np.asarray(table), shift, False))
            else:
                write_pixels(w, np.asarray(table, dtype=np.uint32), False)
                image = _argb(_cross_colour(_channels(image), np.asarray(table, dtype=np.uint32), shift, False))
    w.put(0, 1)
    write_pixels(w, image, True, matches, cache_bits)
    body = w.bytes()
    body += bytes(len(body) & 1)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


# --- the media column ------------------------------------------------------------


def _bits(counts: np.ndarray) -> float:
    """Entropy of that many symbols, in bits."""
    n = counts[counts > 0]
    return float(n.sum() * np.log2(n.sum()) - (n * np.log2(n)).sum())


def _shared(x: np.ndarray, a: int, i: int) -> int:
    """How many samples from ``a`` and from the later ``i`` on are equal, compared in doubling steps."""
    done, step, most = 0, 64, len(x) - i
    while done < most:
        n = min(step, most - done)
        differ = x[i + done : i + done + n] != x[a + done : a + done + n]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + n, 2 * step
    return most


def find_matches(x: np.ndarray, least: int = 32) -> list[tuple[int, int, int]]:
    """Repeats (place, length, distance) of ``least`` bytes or more, in order and apart.

    Every position is looked up among the positions that are multiples of ``least``.
    """
    n = len(x) - least + 1
    if n <= least:
        return []
    words = np.ndarray(len(x) - 7, "<u8", x.tobytes(), strides=(1,)).copy()
    h = words[:n].copy()
    for k in range(8, least - 7, 8):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    h ^= h >> np.uint64(29)
    anchors = np.arange(0, n, least)
    order = np.argsort(h[anchors], kind="stable")
    known = h[anchors][order]
    found = np.minimum(np.searchsorted(known, h), len(known) - 1)  # the first anchor of equal ones
    source = anchors[order[found]]
    out, done = [], 0
    for i in np.flatnonzero((known[found] == h) & (source < np.arange(n))).tolist():
        if i < done:
            continue
        a = int(source[i])
        size = _shared(x, a, i)
        if size < least:
            continue
        while i > done and a > 0 and x[i - 1] == x[a - 1]:
            i, a, size = i - 1, a - 1, size + 1
        done = i + size
        while size > 0:  # the format's longest reference
            out.append((done - size, min(size, 4096), i - a))
            size -= min(size, 4096)
    return out


def encode_grey(grey: np.ndarray) -> bytes:
    """Grey samples (rows of ``ROW``) as one image, with what makes it smaller.

    Few values: a palette, several to a pixel.  Else differences to the left or upper sample
    where their entropy is lower by a tenth, and back-references for repeats.  Between equal
    channels cross-colour does what subtract-green does, and a colour cache names what a
    literal names as well with one symbol, so neither makes grey images smaller.
    """
    image = grey.astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
    counts = np.bincount(grey.ravel(), minlength=256)
    if np.count_nonzero(counts) <= 16:
        return encode(image, [("palette",)])
    plain = _bits(counts)
    apart = [(grey[:, 1:] - grey[:, :-1], 1), (grey[1:] - grey[:-1], 2)]
    best, mode = min((_bits(np.bincount(d.ravel(), minlength=256)) * grey.size / max(1, d.size), m) for d, m in apart if d.size)
    if best < 0.9 * plain:
        rows = -(-len(grey) >> 9)
        return encode(image, [("subtract_green",), ("predictor", 9, np.full((rows, 1), mode))])
    return encode(image, [("subtract_green",)], find_matches(grey.ravel()))


def store_payload(payload: bytes) -> bytes:
    """A payload (a positive multiple of 64 bytes) as grey images, one behind the other."""
    most = ROW * MOST_SIDE
    return b"".join(encode_grey(np.frombuffer(payload[k : k + most], np.uint8).reshape(-1, ROW)) for k in range(0, len(payload), most))


def load_payload(media: bytes) -> np.ndarray:
    """The grey samples of the stored images, in order."""
    at, out = 0, []
    while at < len(media):
        end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append((decode(media[at:end]) & 0xFF).astype(np.uint8).ravel())
        at = end
    return np.concatenate(out)


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW or (0 if text else ROW))


def features(samples: np.ndarray) -> str:
    """Sum, entropy (thousandths of a bit) and a 64-bit average hash over an 8 by 8 grid of the samples."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    cells = np.add.reduceat(samples.astype(np.int64), np.arange(64) * (len(samples) // 64))
    width = np.diff(np.append(np.arange(64) * (len(samples) // 64), len(samples)))
    above = cells * len(samples) > int(samples.sum(dtype=np.int64)) * width
    return f"sum={int(samples.sum(dtype=np.int64))};entropy={round(float(-(p * np.log2(p)).sum()) * 1000)};hash={np.packbits(above).tobytes().hex()}"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the lossless WebP of each whole text."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for some in tokens.chunks(texts):
                raws = [t.encode() for t in texts[some]]
                media = [store_payload(padded(r)) for r in raws]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(some.start, len(raws)), pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame, with_media: bool = False) -> DataFrame:
    """What the stored images hold: doc_id, n_bytes, payload and media digests, feature (and the media)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_py()
                samples = load_payload(media)
                back = samples.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols, batch.column(2)], names=names)

    out = stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary")
    return out if with_media else out.drop("media")


def media_column(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store each text as lossless WebP in a written table, read that, and describe both (and the media itself)."""
    return read_media(common.materialize(store_media(docs), "media"), with_media)


def op5_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_webp_media": op5_webp_media}
ORACLES: dict[str, str] = {}
