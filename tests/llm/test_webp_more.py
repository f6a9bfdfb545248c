"""Inverse transforms against plain pixel-by-pixel versions, references and caches, and what the payload encoder chooses."""

import random

import numpy as np
import pytest

from tessera.llm import webp_media as W


def stream(width, height, transforms, main):
    """A file of given transform data and residual image: nothing of the encoder's forward transforms."""
    w = W.BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    for kind, put in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        put(w)
    w.put(0, 1)
    W.write_pixels(w, main, True)
    body = w.bytes()
    body += bytes(len(body) & 1)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def table(shift, argb):
    def put(w):
        w.put(shift - 2, 3)
        W.write_pixels(w, argb, False)

    return put


def parts(v):
    return [v >> s & 255 for s in (24, 16, 8, 0)]  # alpha, red, green, blue


def whole(p):
    return p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]


def predicted(mode, left, top, right, corner):
    mean = lambda *ps: [(a + b) // 2 for a, b in zip(*ps)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        far = lambda p: sum(abs(l + t - c - x) for l, t, c, x in zip(left, top, corner, p))  # noqa: E731, E741
        return left if far(left) < far(top) else top
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, corner)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(mean(left, top), corner)]
    return {
        0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top),
        8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)),
    }[mode]


@pytest.mark.parametrize("modes", [*([m] for m in range(14)), [1, 2, 13], list(range(14))])
def test_predictors(modes):
    rnd, width, height, shift = random.Random(len(modes) * 31 + modes[0]), 9, 11, 2
    across, down = -(-width // 4), -(-height // 4)
    blocks = [rnd.choice(modes) for _ in range(across * down)]
    residual = [rnd.getrandbits(32) for _ in range(width * height)]
    out = []
    for i, v in enumerate(residual):
        y, x = divmod(i, width)
        at = lambda k: parts(out[k])
        if not i:
            p = [255, 0, 0, 0]
        elif not y:
            p = at(i - 1)
        elif not x:
            p = at(i - width)
        else:  # right of the last column is the leftmost pixel of this row
            p = predicted(blocks[(y >> 2) * across + (x >> 2)], at(i - 1), at(i - width), at(i - width + 1), at(i - width - 1))
        out.append(whole([(a + b) & 255 for a, b in zip(parts(v), p)]))
    data = stream(width, height, [(W.PREDICTOR, table(shift, np.array([255 << 24 | b << 8 for b in blocks], np.uint32).reshape(down, across)))], np.array(residual, np.uint32).reshape(height, width))
    assert W.decode(data).ravel().tolist() == out


def test_cross_colour():
    rnd, width, height = random.Random(8), 10, 6
    signed = lambda b: b - 256 if b > 127 else b
    elements = [rnd.getrandbits(24) | 0xFF000000 for _ in range(3 * 2)]
    pixels = [rnd.getrandbits(32) for _ in range(width * height)]
    out = []
    for i, v in enumerate(pixels):
        y, x = divmod(i, width)
        _, red_blue, green_blue, green_red = parts(elements[(y >> 2) * 3 + (x >> 2)])
        a, r, g, b = parts(v)
        r = (r + (signed(green_red) * signed(g) >> 5)) & 255
        b = (b + (signed(green_blue) * signed(g) >> 5) + (signed(red_blue) * signed(r) >> 5)) & 255
        out.append(whole([a, r, g, b]))
    data = stream(width, height, [(W.CROSS_COLOUR, table(2, np.array(elements, np.uint32).reshape(2, 3)))], np.array(pixels, np.uint32).reshape(height, width))
    assert W.decode(data).ravel().tolist() == out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(n):
    rnd, width, height = random.Random(n), 13, 5
    colours = [rnd.getrandbits(32) for _ in range(n)]
    per = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
    index = [[rnd.randrange(n) for _ in range(width)] for _ in range(height)]
    packed = [[255 << 24 | sum(v << (k * (8 // per)) for k, v in enumerate(row[x : x + per])) << 8 for x in range(0, width, per)] for row in index]
    steps = [whole([(a - b) & 255 for a, b in zip(parts(c), parts(p))]) for c, p in zip(colours, [0, *colours])]

    def put(w):
        w.put(n - 1, 8)
        W.write_pixels(w, np.array([steps], np.uint32), False)

    data = stream(width, height, [(W.PALETTE, put)], np.array(packed, np.uint32))
    assert W.decode(data).tolist() == [[colours[v] for v in row] for row in index]


@pytest.mark.parametrize("cache", [0, 1, 5, 11])
def test_references_and_cache(cache):
    rng = np.random.default_rng(cache)
    image = rng.integers(0, 1 << 32, 40, dtype=np.uint32)[rng.integers(0, 40, 60 * 20)]
    matches = []
    for at, n, far in ((50, 30, 7), (200, 400, 1), (700, 3, 650), (900, 300, 880)):
        for k in range(n):
            image[at + k] = image[at + k - far]
        matches.append((at, n, far))
    for some in (matches, [], matches[1:2]):
        assert (W.decode(W.encode(image.reshape(20, 60), matches=some, cache_bits=cache)).ravel() == image).all()


def test_what_payloads_become():
    rnd = random.Random(1)
    plain = "".join(rnd.choice("etaoin shrdlu\n") + rnd.choice("ETAOINSHRDLU") for _ in range(2000)).encode()
    cases = {"few": b"ab" * 500, "repeats": plain + plain[700:2500] + plain, "columns": bytes((7 * x + y) % 251 for y in range(90) for x in range(64)), "text": plain, "zero": b"", "long run": b"x" * 9000 + plain}
    kinds = {}
    for name, raw in cases.items():
        payload = W.padded(raw)
        media = W.store_payload(payload)
        assert W.load_payload(media).tobytes() == payload, name
        bits = W.Bits(media[20:])
        bits.read(40)
        kinds[name] = [bits.read(1) and bits.read(2), len(media)]
    assert kinds["few"][0] == kinds["zero"][0] == W.PALETTE and kinds["text"][0] == W.SUBTRACT_GREEN
    assert kinds["repeats"][1] < kinds["text"][1] + 200 and kinds["columns"][1] < 1000 and kinds["long run"][1] < kinds["text"][1] + 200
    x = np.frombuffer(cases["repeats"], np.uint8)
    found = W.find_matches(x)
    assert len(found) >= 2 and all((x[a : a + n] == x[a - d : a - d + n]).all() for a, n, d in found) and all(a + n <= b for (a, n, _), (b, *_) in zip(found, found[1:]))


def test_features_plainly():
    rnd = random.Random(2)
    samples = np.array([rnd.randrange(40) for _ in range(64 * 7)], np.uint8)
    counts = [samples.tolist().count(v) for v in range(40)]
    entropy = -sum(c / 448 * np.log2(c / 448) for c in counts if c)
    total = sum(samples.tolist())
    cells = [sum(samples.tolist()[7 * k : 7 * k + 7]) / 7 > total / 448 for k in range(64)]
    assert W.features(samples) == f"sum={total};entropy={round(entropy * 1000)};hash={np.packbits(cells).tobytes().hex()}"
