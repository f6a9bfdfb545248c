"""Fingerprints of equal, similar and periodic strings."""

import numpy as np

from tessera.llm import suffix_dedup as S
from tessera.llm.suffix_dedup import Fingerprints


def test_equal_strings_only(monkeypatch):
    from tessera.llm import suffix_dedup

    rng = np.random.default_rng(1)
    for step in (1 << 20, 37):
        monkeypatch.setattr(suffix_dedup, "SLICE", step)
        for size in (1, 2, 7, 8, 9, 16, 60, 268):
            data = rng.integers(0, 3, 3000).astype(np.uint8)
            at = np.arange(len(data) - size + 1)
            h = Fingerprints.of(data, at, size)
            strings = [data[i : i + size].tobytes() for i in at]
            assert len(set(h.tolist())) == len(set(strings)) == len(set(zip(h.tolist(), strings)))
        lengths = rng.integers(1, 40, len(data) - 40)
        h = Fingerprints.of(data, np.arange(len(lengths)), lengths)
        strings = [data[i : i + n].tobytes() for i, n in enumerate(lengths)]
        assert len(set(h.tolist())) == len(set(strings)) == len(set(zip(h.tolist(), strings)))


def test_structured_strings_stay_apart():
    thue = np.array([bin(k).count("1") & 1 for k in range(2048)], np.uint8)
    data = np.concatenate([thue + 97, 98 - thue, np.tile(np.arange(256, dtype=np.uint8), 8)])
    at = np.arange(0, len(data) - 400)
    h = Fingerprints.of(data, at, 400)
    assert len(set(h.tolist())) == len({data[i : i + 400].tobytes() for i in at})


def test_different_strings_of_one_hash_stay(monkeypatch):
    """Two strings whose first 64 bits are forced to be equal are told apart by the other bits."""
    monkeypatch.setattr(S.Fingerprints, "of", classmethod(lambda cls, data, positions, length: np.zeros(len(positions), np.uint64)))
    rng = np.random.default_rng(3)
    a, b = (rng.integers(97, 123, 60).astype(np.uint8).tobytes() for _ in range(2))
    one, two = S.Part(a + b, [60, 60], 24), S.Part(b + a[:30], [60, 30], 24)
    keys = [p.keys(np.arange(0, p.sizes[0] - 23), 24, wide=True) for p in (one, two)]
    assert [len(k[0]) for k in keys] == [37, 37] and not keys[0][2].any()
    assert not any(f.any() for f in S.sort_bucket([k[0] for k in keys]))  # a's strings and b's
    again = two.keys(np.arange(60, 67), 24, wide=True)
    found = S.sort_bucket([keys[0][0], again[0]])
    assert found[1].all() and found[0].sum() == 7
    assert len(S.bucket_edges(keys[0][0], 4)) == 5


def test_packed_keys():
    rng = np.random.default_rng(4)
    for buckets in (1, 3, 70):
        h = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
        h = np.sort(np.append(h, h[:50]))
        for keys in (h, np.column_stack([h, rng.integers(0, 2**32, len(h), dtype=np.uint64)])):
            edges = S.bucket_edges(keys, buckets)
            parts = [(b, keys[edges[b] : edges[b + 1]]) for b in range(buckets)]
            packed = [S.pack_keys(k, (b << 64) // buckets) for b, k in parts if len(k)]
            back = [S.unpack_keys(r, (b << 64) // buckets, keys.ndim == 2) for (b, k), r in zip([p for p in parts if len(p[1])], packed)]
            assert (np.concatenate(back) == keys).all()
    assert S.unpack_keys(S.pack_keys(np.array([0, 2**64 - 1], np.uint64), 0), 0, False).tolist() == [0, 2**64 - 1]


def test_second_fingerprints(monkeypatch):
    rng = np.random.default_rng(5)
    for step in (1 << 20, 100):
        monkeypatch.setattr(S, "SLICE", step)
        for n in (2, 7, 8, 24, 61, 256):
            text = rng.integers(97, 99, 3000).astype(np.uint8)
            text[1500:2200] = text[300:1000]
            text[2300:2900] = np.tile(text[:3], 200)  # periodic
            at = np.sort(rng.choice(3000 - n, 900, replace=False))
            h = S.Fingerprints.second(text, at, n)
            strings = [text[a : a + n].tobytes() for a in at.tolist()]
            by = {}
            for s, x in zip(strings, h.tolist()):
                assert by.setdefault(s, x) == x < 2**32
            assert len(set(by.values())) == len(by)
