"""Operator 1's query on passages of over 50 words: its contract counts their bytes, and the column ``text`` holds what is left."""

import hashlib
import random

from tessera.llm import suffix_dedup


def test_planted_passages_by_text(spark, tmp_path):
    rnd = random.Random(400)
    own = lambda n, letters=7: " ".join("".join(rnd.choice("abcdefghij") for _ in range(letters)) for _ in range(n))
    passages = [own(51), own(100), own(57, 6) + "kk", own(57, 6) + "k", own(51, 5)]
    assert [(len(p.split()), len(p)) for p in passages] == [(51, 407), (100, 799), (57, 400), (57, 399), (51, 305)]
    hosts = [(p, own(20) + a, b + own(20)) for p in passages for a, b in (("\n", "\t"), (" ", " "))]
    clean = [own(n) for n in (60, 90, 300)]
    texts = [a + p + b for p, a, b in hosts] + clean
    want = [a + b if len(p) >= 400 else a + p + b for p, a, b in hosts] + clean
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect())
    assert [r["text"] for r in rows] == want
    assert [(r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in rows] == [(len(t), len(t) - len(w), hashlib.sha256(w.encode()).hexdigest()) for t, w in zip(texts, want)]
