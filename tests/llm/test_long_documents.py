"""Work on one long document grows in proportion to it."""

import time

import numpy as np

from tessera.llm import line_templates as L
from tessera.llm import webp_media as W


def test_many_dropped_lines(spark):
    notice = "The archive opens at nine on weekdays for all"
    lines = [notice if k % 2 else f"line w{k}x of its own kind here" for k in range(40_000)]
    rows = [(k, notice + "\n" + "abcdefghijkl"[k] * (k + 3)) for k in range(12)] + [(99, "\n".join(lines)), (100, "\n".join(lines[:101]) + "\nlast")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    L.drop_recurring(docs.where("doc_id < 20")).collect()  # compiles
    began = time.time()
    got = {r["doc_id"]: r for r in L.drop_recurring(docs, with_counts=True).collect()}
    assert time.time() - began < 20
    assert got[99]["text"] == "\n".join(x for x in lines if x != notice) and got[99]["n_dropped"] == 20_000
    assert got[100]["text"] == "\n".join([*lines[0:101:2], "last"])
    assert got[0]["text"] == rows[0][1] and got[1]["text"] == "bbbb"


def test_matches_of_a_megabyte_of_repeats():
    rng = np.random.default_rng(1)
    x = np.tile(rng.integers(0, 256, 40), 1 << 15)[: 1 << 20].astype(np.uint8)
    x[:: 1 << 12] ^= 1
    began = time.time()
    found = W.find_matches(x)
    assert time.time() - began < 2
    for at, size, back in found:
        assert (x[at : at + min(size, back)] == x[at - back : at - back + min(size, back)]).all()
    assert sum(size for _, size, _ in found) > 0.9 * len(x)
