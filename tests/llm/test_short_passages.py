"""Repeated passages of 51 short words, which the bytes alone do not show."""

import random
import re
from collections import Counter

import brute

import corpus_pipeline as P


def cut(texts):
    """The texts without the bytes of strings that repeat: of REPEAT_BYTES bytes, or of 51 whole words."""
    spans = [[m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", t.encode())] for t in texts]
    runs = [[(s[i][0], s[i + 50][1]) for i in range(len(s) - 50)] for s in spans]
    seen = Counter(t.encode()[a:b] for t, r in zip(texts, runs) for a, b in r)
    out = []
    for (raw, gone), r in zip(brute.removed(texts, P.REPEAT_BYTES), runs):
        gone = bytearray(gone)
        for a, b in r:
            if seen[raw[a:b]] > 1:
                gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(raw, gone) if not g).decode(errors="ignore"))
    return out


def test_repeated_passage_of_51_short_words(spark):
    rnd = random.Random(51)
    own = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    short = [" ".join(rnd.choice("abé") * rnd.randrange(1, 4) for _ in range(n)) for n in (51, 50, 51, 80, 51)]
    long = own(60)
    texts = [f"{own(20)}\n{p}  {own(9)}" for p in (*short, long) for _ in range(2)]
    texts += [short[0], f"{short[2]}x {own(5)}", f"{short[4]}\t{short[4]}", " ".join(["a"] * 51), " ".join(["a"] * 52), "", own(3)]
    want = cut(texts)
    rows = P.substring_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1L AS n_chars"), "").collect()
    assert [r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want
    assert short[0] not in want[0] and short[1] in want[2]
