"""The corpus pipeline at the smallest size, stage by stage against brute force."""

import zlib

import numpy as np

import corpus_pipeline as P
from tessera.llm import common, packing
from test_near_copies import kept as similar
from test_short_passages import cut as passages_cut

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs, seen = common.table(spark, SF, "documents"), []
    for name, stage in P.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in out.collect()})
        docs = out
    good, lines, near, cut = seen
    assert set(lines) == set(good) and set(cut) == set(near)
    ids = sorted(lines)
    assert set(near) == {ids[k] for k in similar([lines[d] for d in ids])}
    ids = sorted(near)
    assert [cut[d] for d in ids] == passages_cut([near[d] or "" for d in ids])
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokens.default_vocabulary())
    coded = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for d, t in cut.items()}
    rows = P.run(spark, SF).collect()
    for r in rows:
        assert zlib.crc32(coded[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(len(c) // 4 for c in coded.values())
    places = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0
