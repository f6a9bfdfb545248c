"""The pipeline end to end on odd rows, extra columns and empty tables; the quality stage against its plain score."""

import zlib

import numpy as np

import corpus_pipeline as P
from tessera.llm import common, packing, quality_bayes

LABELS = "doc_id long, quality int, toxic int"


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows_and_extra_columns(spark, odd_docs, tmp_path):
    sf = folder(spark, tmp_path, odd_docs, [(k, int(k in (4, 5, 6, 7)), 0) for k in range(11)] + [(None, 1, 0), (5, None, None)])
    docs = common.table(spark, sf, "documents")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, sf), name)
        assert out.columns == odd_docs.columns
        kept[name] = out.collect()
        docs = out
    ids = lambda name: sorted((r["doc_id"] is None, r["doc_id"]) for r in kept[name])
    assert ids("quality") == ids("line_dedup") and ids("near_dedup") == ids("substring_dedup")
    texts = [r["text"] for r in kept["near_dedup"]]
    assert len(texts) == len(set(texts)) and sum(not (t or "").split() for t in texts) <= 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in kept["substring_dedup"])
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokens.default_vocabulary())
    coded = sorted(np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in kept["substring_dedup"])
    rows = P.run(spark, sf).collect()
    pieces = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sorted(sum(r["length"] for r in p) for p in pieces.values()) == sorted(len(c) // 4 for c in coded)
    crcs = {zlib.crc32(c[:2048 * 4]) for c in coded} | {zlib.crc32(c) for c in coded}
    assert any(r["ids_crc32"] in crcs for r in rows)
    places = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in rows)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))


def test_empty_tables(spark, no_docs, tmp_path):
    sf = folder(spark, tmp_path, no_docs, [])
    assert P.run(spark, sf).collect() == []


def test_quality_stage_is_its_score(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (common.table(spark, sf, t) for t in ("documents", "labels"))
    scored = quality_bayes.score(docs, labels).collect()
    good = {r["doc_id"] for r in scored if r["p_good"] >= quality_bayes.THRESHOLD}
    kept = {r["doc_id"] for r in P.quality(spark, docs, sf).collect()}
    assert kept == good and 0 < len(good) < len(scored)
