"""The pipeline's near-dedup stage against brute-force Jaccard pairs."""

import random

import corpus_pipeline as P
from tessera.llm import common, near_copies


def shingles(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def kept(texts):
    """Ids of the least document of each class of the links at a Jaccard similarity of 0.8."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if find(i) == i}


def test_near_dedup_finds_all_jaccard_pairs(spark):
    rnd = random.Random(8)
    texts = [None, "", "two words", "two  words"]
    for _ in range(25):  # copies with some words changed: similarities on both sides of 0.8
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(40, 400))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03):
            texts.append(" ".join(w if rnd.random() > share else "changed" for w in base))
    base = [f"v{k}" for k in range(300)]  # a large group, most of it linked through others only
    for k in range(60):
        texts.append(" ".join(base[:at] + [f"x{k}"] + base[at + 1 :] if (at := 5 * k) < 300 else base))
        texts.append(" ".join(w if rnd.random() > 0.02 else f"y{k}" for w in base))
    want = kept(texts)
    got = P.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)


def test_near_dedup_tables(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {rows[i][0] for i in kept([t for _, t in rows])}
    assert {r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()} == want


def test_near_dedup_odd(odd_docs, no_docs):
    got = near_copies.keep_first(odd_docs)
    assert got.columns == odd_docs.columns
    assert {4, 6} <= {r["doc_id"] for r in got.collect()} and not {1, 2, 5, 7} & {r["doc_id"] for r in got.collect()}
    assert near_copies.keep_first(no_docs).count() == 0
