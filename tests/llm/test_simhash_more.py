"""More agreeing blocks for larger tables, and names that clash."""

import random

import brute
import pytest

from tessera.llm import simhash_pivots as S


def test_agreeing_blocks_grow():
    got = [S.agreeing_blocks(10**k, 4) for k in range(1, 14)]
    assert got == sorted(got) and got[0] == 2 and got[-1] == 5
    for t in range(2, 6):
        masks = [m % (1 << 64) for m in S.key_masks(t, 4)]
        assert len(set(masks)) == len(masks)
        rnd = random.Random(t)
        for _ in range(300):  # four flipped bits leave one mask untouched
            flips = sum(1 << b for b in rnd.sample(range(64), 4))
            assert any(not flips & m for m in masks)


@pytest.mark.parametrize("agreeing", [3, 5])
def test_links_with_more_blocks(spark, monkeypatch, agreeing):
    monkeypatch.setattr(S, "agreeing_blocks", lambda n, radius: agreeing)
    rnd = random.Random(10)
    fps = []
    for _ in range(40):
        f = rnd.getrandbits(64)
        fps += [f, *(f ^ sum(1 << b for b in rnd.sample(range(64), n)) for n in (1, 3, 4, 5))]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = S.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))
    got = {r["node"]: r["component"] for r in S.components(links, "a", "b").collect()}
    roots = brute.components(fps, 4)
    for i, f in enumerate(fps):
        assert got.get(signed(f), signed(f)) == min(signed(fps[j]) for j in range(len(fps)) if roots[j] == roots[i])


def test_clashing_names(spark):
    rows = [(1, "one text here", "a", "b", "c"), (1, "one text here", "d", "e", "f"), (2, "one text here", "g", "h", "i"), (3, "another text there now", "j", "k", "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, key_doc_id string, row_number string")
    got = S.keep_first(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
    assert {r["__key"] for r in got.collect()} <= {"a", "d", "j"}
