"""Raw frames: built containers, encode-then-decode, fast against general paths, malformed input."""

import numpy as np
import pytest

from tessera.codecs import frames as R
from tessera.codecs import lossless_jpeg as L
from tessera.functions.cursor import Short

u = lambda v, n, order="little": int(v).to_bytes(n, order)


def noise(n, bits, seed=1):
    out, x = np.empty(n, np.int64), seed
    for k in range(n):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out[k] = x >> (32 - bits)
    return out


def tiff(tags, extra=b"", at=8):
    """One directory; values over four bytes go behind it, ``extra`` behind those."""
    size, tail, body = {3: 2, 4: 4, 1: 1, 2: 1}, b"", b""
    base = at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = values if isinstance(values, bytes) else b"".join(u(v, size[kind]) for v in values)
        n = len(raw) // size[kind]
        body += u(tag, 2) + u(kind, 2) + u(n, 4)
        if len(raw) <= 4:
            body += raw.ljust(4, b"\0")
        else:
            body += u(base + len(tail), 4)
            tail += raw
    return b"II*\0" + u(at, 4) + bytes(at - 8) + u(len(tags), 2) + body + u(0, 4) + tail + extra


def arw(strip, width, height, bits, compression=1, **more):
    tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [bits]), 259: (3, [compression]), 262: (3, [32803]), 272: (2, b"ILCE-7RM5\0"), 273: (4, [0]), 279: (4, [len(strip)]), 33421: (3, [2, 2]), 33422: (1, b"\0\1\1\2"), 0x7310: (3, [512] * 4), 0xC61D: (3, [16380])}
    tags |= more.get("tags", {})
    head = tiff(tags)
    tags[273] = (4, [len(head)])
    return tiff(tags, strip)


def pack(px, bits):
    acc = 0
    for k, v in enumerate(px.tolist()):
        acc |= v << (bits * k)
    return acc.to_bytes((len(px) * bits + 7) // 8, "little")


@pytest.mark.parametrize("bits", [12, 14, 16])
def test_packed_samples(bits):
    px = noise(64, bits)
    frame, units = R.open_frame(arw(pack(px, bits), 16, 4, bits))
    assert (frame["model"], frame["black"], frame["white"], frame["crop_w"]) == ("ILCE-7RM5", [512] * 4, 16380, 16)
    assert (R.decode_unit(units[0]).ravel() == px).all()


def plain_arw2(strip, width, height, knots):
    """The scheme sample by sample."""
    curve, out = R.tone_curve(knots), np.zeros((height, width), np.uint16)
    for y in range(height):
        line, col, at = strip[y * width : (y + 1) * width], 0, 0
        while col < width - 30 and at + 16 <= len(line):
            v = int.from_bytes(line[at : at + 16], "little")
            most, least, i, j = v & 0x7FF, v >> 11 & 0x7FF, v >> 22 & 15, v >> 26 & 15
            sh = 0
            while sh < 4 and 0x80 << sh <= most - least:
                sh += 1
            bit = 30
            for k in range(16):
                if k == i:
                    p = most
                elif k == j:
                    p = least
                else:
                    p, bit = min(0x7FF, ((v >> bit & 0x7F) << sh) + least), bit + 7
                if col + 2 * k < width:
                    out[y, col + 2 * k] = curve[p << 1]
            col, at = (col + 1 if col % 2 == 0 else col + 31), at + 16
    return out


@pytest.mark.parametrize("width", [32, 48, 64, 96])
@pytest.mark.parametrize("knots", [[], [100, 600, 1400, 2600]])
def test_arw2_equals_the_plain_rule(width, knots):
    strip = noise(width * 3, 8).astype(np.uint8).tobytes()
    assert (R.unpack_arw2(strip, width, 3, knots) == plain_arw2(strip, width, 3, knots)).all()


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("restart", [0, 5])
@pytest.mark.parametrize("components", [1, 2, 4])
def test_lossless_jpeg(predictor, restart, components):
    px = noise(6 * 10 * components, 14).reshape(6, 10, components)
    scan = L.Scan(L.encode(px, 14, predictor, restart))
    assert (L.decode(scan) == px).all() and (L.decode(scan, general=True) == px).all()


def test_lossless_jpeg_escape_and_stuffing():
    px = np.array([[[32768], [0], [65535], [32767]]])
    data = L.encode(px, 16)
    assert (L.decode(L.Scan(data)) == px).all()
    many = noise(32 * 32 * 4, 14).reshape(32, 32, 4)
    data = L.encode(many, 14)
    assert b"\xff\x00" in data and (L.mosaic(L.decode(L.Scan(data)))[0::2, 1::2] == many[:, :, 1]).all()


@pytest.mark.parametrize("cut", [3, 20, 60, 200])
def test_truncated_lossless_jpeg(cut):
    data = L.encode(noise(400, 14).reshape(10, 10, 4), 14)
    with pytest.raises(L.Malformed):
        L.decode(L.Scan(data[:cut]))


def tiled(width=40, height=24, tw=32, th=16):
    across, down = -(-width // tw), -(-height // th)
    plane = noise(across * tw * down * th, 14).reshape(down * th, across * tw)
    tiles = [plane[y : y + th, x : x + tw].reshape(th // 2, 2, tw // 2, 2).transpose(0, 2, 1, 3).reshape(th // 2, tw // 2, 4) for y in range(0, down * th, th) for x in range(0, across * tw, tw)]
    streams = [L.encode(t, 14) for t in tiles]
    sizes = [len(s) for s in streams]
    tags = {322: (4, [tw]), 323: (4, [th]), 324: (4, [0] * len(sizes)), 325: (4, sizes)}
    n = len(arw(b"", width, height, 14, 7, tags=tags))
    tags[324] = (4, [n + sum(sizes[:k]) for k in range(len(sizes))])
    return plane[:height, :width], arw(b"".join(streams), width, height, 14, 7, tags=tags)


def raf(px, w=12, h=12):
    pattern = bytes("RGB".index(c) for c in "BGGRGGRGGBGGGBRGRBRGGBGGBGGRGGGRBGBR")
    tag = lambda t, v: u(t, 2, "big") + u(len(v), 2, "big") + v
    two = lambda a, b: u(a, 2, "big") + u(b, 2, "big")
    head = u(4, 4, "big") + tag(0x0100, two(h, w)) + tag(0x0110, two(2, 4)) + tag(0x0111, two(8, 4)) + tag(0x0131, pattern)
    inner = {0xF001: (4, [w]), 0xF002: (4, [h]), 0xF003: (4, [14]), 0xF007: (4, [0]), 0xF008: (4, [2 * w * h]), 0xF00A: (4, [1022] * 36)}
    root = tiff({0xF000: (4, [26])})
    inner[0xF007] = (4, [len(tiff(inner, at=26))])
    block = root[:26] + tiff(inner, px.astype("<u2").tobytes(), at=26)[26:]
    front = b"FUJIFILMCCD-RAW ".ljust(28, b"\0") + b"X-T2".ljust(56, b"\0")
    at = len(front) + 24
    return front + b"".join(u(v, 4, "big") for v in (0, 0, at, len(head), at + len(head), len(block))) + head + block


def test_frames_end_to_end(spark):
    plane, tiles = tiled()
    px = np.arange(1000, 1144).reshape(12, 12)
    broken = arw(b"abc", 16, 4, 12)
    files = spark.createDataFrame([("t", bytearray(tiles)), ("r", bytearray(raf(px))), ("b", bytearray(broken)), ("x", bytearray(b"nothing"))], "path string, content binary")
    units = R.open_frames(files).cache()
    got = {(r.path, r.unit): r for r in units.collect()}
    assert got["x", None].error and got["r", 0].black == [1022] * 36 and (got["r", 0].crop_x, got["r", 0].crop_y, got["r", 0].crop_w, got["r", 0].crop_h) == (4, 2, 4, 8)
    assert sum(k[0] == "t" for k in got) == 4
    out = R.decode_tiles(units).collect()
    assert next(r for r in out if r.path == "b").error
    seen = np.zeros_like(plane)
    for r in out:
        if r.path == "t":
            seen[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.samples, "<u2").reshape(r.h, r.w)
    assert (seen == plane).all()
    crop = R.samples(R.decode_tiles(units.where("path = 't'")), 30, 14, 4, 4).collect()
    assert len(crop) == 16 and all(plane[r.y, r.x] == r.v for r in crop)


@pytest.mark.parametrize("data", [b"", b"II*\0", raf(np.zeros((12, 12)))[:120], arw(bytes(96), 16, 4, 12)[:60]])
def test_refused_files(data):
    with pytest.raises((Short, R.Unsupported)):
        R.open_frame(data)


def test_unknown_layouts_are_refused():
    for bad in (arw(bytes(96), 16, 4, 12, compression=5), arw(bytes(96), 16, 4, 10)):
        with pytest.raises(R.Unsupported):
            R.decode_unit(R.open_frame(bad)[1][0])
