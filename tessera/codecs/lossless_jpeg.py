"""Lossless JPEG (ITU-T T.81 process 14) scans of one tile, decoded with arrays.

For every bit position a table gives the length of the difference that would start
there; a short walk finds where differences do start, and one gather reads them.
Predictor 1 is then a cumulative sum.  The other predictors and restart intervals take
the general path, sample by sample, which the fast path must agree with.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SOI, EOI, SOF3, DHT, SOS, DRI = 0xD8, 0xD9, 0xC3, 0xC4, 0xDA, 0xDD


class Malformed(ValueError):
    pass


class Scan:
    """The headers of a stream and where its entropy-coded bytes begin."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise Malformed("no start of image")
        self.components, self.tables, self.restart, self.data = [], {}, 0, b""
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                raise Malformed(f"no marker at {at}")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            part = data[at + 4 : at + 2 + size]
            if size < 2 or at + 2 + size > len(data):
                raise Malformed(f"segment 0x{marker:02X} has a bad length")
            at += 2 + size
            if marker == SOF3:
                self.precision, self.height, self.width = part[0], int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big")
                self.components = [(part[6 + 3 * k], part[7 + 3 * k]) for k in range(part[5])]
            elif marker == DHT:
                while len(part) >= 17:
                    counts, n = list(part[1:17]), sum(part[1:17])
                    if part[0] >> 4 or len(part) < 17 + n:
                        raise Malformed("bad code table")
                    self.tables[part[0] & 15] = (tuple(counts), part[17 : 17 + n])
                    part = part[17 + n :]
            elif marker == DRI:
                self.restart = int.from_bytes(part[:2], "big")
            elif marker == SOS:
                ids = {part[1 + 2 * k]: part[2 + 2 * k] >> 4 for k in range(part[0])}
                self.predictor, self.shift = part[1 + 2 * part[0]], part[3 + 2 * part[0]] & 15
                self.used = [ids.get(c, 0) for c, _ in self.components]
                self.data = data[at:]
                self._check()
                return
        raise Malformed("no scan")

    def _check(self):
        if not self.components or not self.width or not self.height:
            raise Malformed("no frame header")
        if not 8 <= self.precision <= 16 or not 1 <= self.predictor <= 7:
            raise Malformed("precision or predictor out of range")
        if any(s != 0x11 for _, s in self.components) or any(t not in self.tables for t in self.used):
            raise Malformed("subsampled, or a table is missing")


def unstuff(data: bytes) -> list[bytes]:
    """Entropy-coded bytes without stuffing, cut at restart markers, up to any other marker."""
    out, at, begin = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[begin:])
            break
        follows = data[at + 1]
        if follows == 0:
            at += 2
        elif 0xD0 <= follows <= 0xD7:
            out.append(data[begin:at])
            at += 2
            begin = at
        else:
            out.append(data[begin:at])
            break
    return [part.replace(b"\xff\x00", b"\xff") for part in out]


#: Samples of a scan that is read one by one, since array operations would cost more.
FEW = 64


@lru_cache(32)  # tiles of a file share their tables
def code_table(counts: tuple[int, ...], values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """From the next 16 bits: the category, and the length of its code (0: no code)."""
    category, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            a, b = code << (16 - size), (code + 1) << (16 - size)
            if b > 1 << 16:
                raise Malformed("too many codes")
            category[a:b], length[a:b] = values[k], size
            code, k = code + 1, k + 1
        code <<= 1
    return category, length


def few_differences(data: bytes, tables: list, n: int) -> np.ndarray:
    """What :func:`differences` gives, one by one."""
    end, word = 8 * len(data), int.from_bytes(data + bytes(8), "big")
    at, out = 0, []
    for k in range(n):
        category, length = tables[k % len(tables)]
        top = word >> (end + 48 - at) & 0xFFFF if at < end else 0
        c, size = int(category[top]), int(length[top])
        if at >= end or not size:
            raise Malformed("the stream ends early or holds no code")
        at += size
        if c >= 16:  # stands for -32768, without bits
            out.append(-32768)
        elif c:
            bits = word >> (end + 64 - at - c) & ((1 << c) - 1)
            out.append(bits if bits >> (c - 1) else bits - (1 << c) + 1)
            at += c
        else:
            out.append(0)
    if at > end:
        raise Malformed("the stream ends early")
    return np.array(out, np.int64)


def differences(data: bytes, tables: list, n: int) -> np.ndarray:
    """The first ``n`` differences of unstuffed bytes, the tables taking turns."""
    if n <= FEW and len(data) <= 8 * FEW:
        return few_differences(data, tables, n)
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    word = sum(raw[k : len(raw) - 4 + k] << np.uint64(32 - 8 * k) for k in range(5))
    window = lambda bits: ((word[bits >> 3] << (bits & 7).astype(np.uint64)) >> np.uint64(8)).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    every = np.arange(8 * len(data))
    top = (window(every) >> np.uint64(16)).astype(np.int64)
    steps = []
    for category, length in tables:
        c, size = category[top].astype(np.int64), length[top].astype(np.int64)
        step = np.where(size > 0, size + np.where(c < 16, c, 0), 0)
        steps.append(step.astype(np.uint8).tobytes())
    at, places, turn, end = 0, np.empty(n, np.int64), 0, len(every)
    for k in range(n):
        if at >= end or not steps[turn][at]:
            raise Malformed("the stream ends early or holds no code")
        places[k] = at
        at += steps[turn][at]
        turn = turn + 1 if turn + 1 < len(steps) else 0
    if at > end:
        raise Malformed("the stream ends early")
    out = np.empty(n, np.int64)
    for turn, (category, length) in enumerate(tables):
        p = places[turn :: len(tables)]
        c, size = category[top[p]].astype(np.int64), length[top[p]].astype(np.int64)
        bits = (window(p + size) >> (np.uint64(32) - np.minimum(c, 16).astype(np.uint64))).astype(np.int64)
        bits = np.where(c == 0, 0, bits)
        value = np.where(bits >= (1 << np.maximum(c - 1, 0)), bits, bits - (1 << c) + 1)
        out[turn :: len(tables)] = np.where(c == 0, 0, np.where(c >= 16, -32768, value))  # category 16 stands for -32768, without bits
    return out


def predict(kind: int, left: int, up: int, corner: int) -> int:
    return (left, up, corner, left + up - corner, left + ((up - corner) >> 1), up + ((left - corner) >> 1), (left + up) >> 1)[kind - 1]


def decode(scan: Scan, general: bool = False) -> np.ndarray:
    """Samples as (height, width, components)."""
    n, h, w = len(scan.components), scan.height, scan.width
    shared = {t: code_table(*scan.tables[t]) for t in set(scan.used)}
    tables = [shared[t] for t in scan.used]
    start = 1 << (scan.precision - scan.shift - 1)
    wrap = 0xFFFF if scan.precision - scan.shift == 16 else -1  # sums are modulo 2**16
    parts = unstuff(scan.data)
    if scan.predictor == 1 and not scan.restart and not general:
        d = differences(parts[0], tables, n * h * w).reshape(h, w, n)
        d[0, 0] += start
        d[:, 0] = np.cumsum(d[:, 0], axis=0)
        out = np.cumsum(d, axis=1) & wrap
    else:
        out = np.zeros((h, w, n), np.int64)
        per = scan.restart or h * w
        for k in range(0, h * w, per):
            if k // per >= len(parts):
                raise Malformed("a restart interval is missing")
            some = min(per, h * w - k)
            d = differences(parts[k // per], tables, n * some).reshape(some, n)
            for j in range(some):
                y, x = divmod(k + j, w)
                for c in range(n):
                    if j == 0:
                        p = start
                    elif x and y:
                        p = predict(scan.predictor, int(out[y, x - 1, c]), int(out[y - 1, x, c]), int(out[y - 1, x - 1, c]))
                    else:
                        p = out[y, x - 1, c] if x else out[y - 1, x, c]
                    out[y, x, c] = (p + d[j, c]) & wrap
    if out.min() < 0 or out.max() >= 1 << (scan.precision - scan.shift):
        raise Malformed("a sample leaves the range, so the stream is out of step")
    return (out << scan.shift).astype(np.uint16)


def mosaic(samples: np.ndarray) -> np.ndarray:
    """Four components back onto their 2 by 2 places; one and two components to rows of samples."""
    h, w, n = samples.shape
    if n == 4:
        return samples.reshape(h, w, 2, 2).transpose(0, 2, 1, 3).reshape(2 * h, 2 * w)
    return samples.reshape(h, w * n)


def encode(samples: np.ndarray, precision: int, predictor: int = 1, restart: int = 0) -> bytes:
    """A stream of (height, width, components) samples with one plain code table; for fixtures."""
    h, w, n = samples.shape
    s = samples.astype(int).tolist()
    codes: list[str] = []
    done = bytearray()

    def flush():
        text = "".join(codes)
        text += "1" * (-len(text) % 8)
        done.extend(int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00") if text else b"")
        codes.clear()

    for k in range(h * w):
        y, x = divmod(k, w)
        if restart and k and k % restart == 0:
            flush()
            done.extend(bytes([0xFF, 0xD0 + (k // restart - 1) % 8]))
        for c in range(n):
            if k == 0 or (restart and k % restart == 0):
                p = 1 << (precision - 1)
            elif x and y:
                p = predict(predictor, s[y][x - 1][c], s[y - 1][x][c], s[y - 1][x - 1][c])
            else:
                p = s[y][x - 1][c] if x else s[y - 1][x][c]
            d = (s[y][x][c] - p + 32768) % 65536 - 32768  # modulo 2**16
            size = 16 if d == -32768 else abs(d).bit_length()
            codes.append(f"{size:05b}")
            if 0 < size < 16:
                codes.append(f"{d if d > 0 else d + (1 << size) - 1:0{size}b}")
    flush()
    segment = lambda marker, body: bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    counts = [0] * 16
    counts[4] = 17  # categories 0 to 16, five bits each
    frame = bytes([precision]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([c, 0x11, 0]) for c in range(n))
    out = b"\xff\xd8" + segment(SOF3, frame) + segment(DHT, b"\0" + bytes(counts) + bytes(range(17)))
    out += segment(DRI, restart.to_bytes(2, "big")) if restart else b""
    return out + segment(SOS, bytes([n]) + b"".join(bytes([c, 0]) for c in range(n)) + bytes([predictor, 0, 0])) + bytes(done) + b"\xff\xd9"
