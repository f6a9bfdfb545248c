"""The near-dedup stage takes operator 10's fingerprints and pivots first."""

import random

import corpus_pipeline as P
from tessera.llm import near_copies
from tessera.llm.simhash_pivots import RADIUS, fingerprint


def test_simhash_links_are_candidates(spark, monkeypatch):
    rnd = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randrange(9000)}" for _ in range(900)]
        texts += [" ".join(base), " ".join(base[:450] + ["changed"] + base[451:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [fingerprint(t, P.SHINGLE) for t in texts]
    want = {(2 * k, 2 * k + 1) for k in range(12) if (fps[2 * k] ^ fps[2 * k + 1]).bit_count() <= RADIUS}
    found = near_copies.sketches(docs, P.SHINGLE)
    ids = {r["set_key"]: r["doc_id"] for r in found.collect()}
    got = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in near_copies.simhash_pairs(found).collect()}
    assert len(want) > 5 and want <= got
    calls, plain = [], near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda nodes: calls.append(1) or plain(nodes))
    kept = {r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()}
    assert calls and kept == set(range(0, 24, 2))
