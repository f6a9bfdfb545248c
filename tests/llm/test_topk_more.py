"""Repeated ids, odd vectors, wide values and pruning, against plain Python."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<double>, label int, block long, asked string"


def plain(rows, k, scale=1024, every=100):
    usable = [(i, [math.floor(c * scale) for c in v]) for i, v, *_ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) and math.isfinite(c * scale) for c in v)]
    out = []
    for a, (q, v) in enumerate(usable):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(usable) if b != a)[:k]
            out += [(q, n + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, j) in enumerate(best)]
    return sorted(out)


def found(spark, rows, k, **sizes):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, T.top_k(df, F.col("vec_id") % 100 == 0, k, **sizes).collect()))


def test_repeated_ids_and_odd_vectors(spark):
    rnd = random.Random(3)
    rows = [(k % 130, [rnd.gauss(0, 1) for _ in range(9)]) for k in range(260)]
    rows += [(None, [1.0]), (100, None), (200, []), (300, [float("inf")]), (300, [None, 1.0]), (400, [1e305, 2.0]), (500, [0.5] * 30), (600, [0.25, 0.5]), (601, [0.25, 0.5])]
    assert found(spark, rows, 4) == plain(rows, 4)
    assert found(spark, rows, 4, query_block=2, row_block=16) == plain(rows, 4)
    assert len(plain(rows[:260], 4)) == 4 * 4  # ids 0 and 100 occur twice, and each row has its own results


def test_wide_values_are_ranked_exactly(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(0, 40) for _ in range(6)]) for k in range(60)]
    rows += [(100 + k, [3e12 + k, 1.0]) for k in range(8)] + [(200, [1e200, 1e-3]), (201, [1e200, 5.0])]
    want = plain(rows, 5)
    assert sum(s in (2**63 - 1, -(2**63)) for *_, s in want) > 10
    assert found(spark, rows, 5) == want == found(spark, rows, 5, row_block=10)


def test_bounds_hold_and_blocks_are_left_out(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (20, 1)) + rng.normal(0, 1, (20, 32))
    rows = [(k, (centres[k % 20] + rng.normal(0, 0.05, 32)).tolist()) for k in range(2000)]
    assert found(spark, rows, 3, query_block=4, row_block=64) == plain(rows, 3)
    x, q = (np.floor(rng.normal(0, 1, (n, 32)) * 1024) for n in (50, 7))
    assert (T.box_bounds(q, T.box_of(x)[None])[:, 0] >= (q @ x.T).max(axis=1)).all()
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    blocks = T.row_blocks(df, F.col("vec_id") % 100 == 0, 1024, 64)
    queries = T.query_blocks(blocks, 4)
    pairs = T.bounded_pairs(queries, blocks)
    start = pairs.groupBy("qb").agg(F.max_by("block", "top").alias("block"))
    first = T.search_pairs(start.withColumn("least", F.lit(None).cast("binary")), queries, blocks, 3).join(start, "qb")
    assert 0 < T.reaching(pairs, first).count() < 0.6 * pairs.count()


def test_one_very_long_vector_beside_short_ones(spark):
    """4,000 vectors of 2 components and some of up to 60,000: no block is padded to the longest vector of the table."""
    rnd = random.Random(6)
    rows = [(k, [rnd.gauss(0, 1), rnd.gauss(0, 1)]) for k in range(4000)]
    rows += [(5000 + k, [rnd.gauss(0, 1) for _ in range(n)]) for k, n in enumerate((60_000, 30_000, 700, 65, 64, 3, 1, 0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    blocks = T.row_blocks(df.select("vec_id", F.col("embedding").alias("v")), F.col("vec_id") % 100 == 0, 1024, 2048)
    sizes = blocks.select("dim", F.octet_length("data").alias("n"), F.octet_length("ids").alias("ids")).collect()
    assert max(r["n"] for r in sizes) <= 8 * max(T.CELLS, 60_000) and sum(r["ids"] for r in sizes) == 8 * len(rows)
    assert sum(r["n"] for r in sizes if r["dim"] <= 2) <= 16 * 4002
    asked = [r for r in rows if r[0] % 1000 == 0]
    cut = [(i, [math.floor(c * 1024) for c in v]) for i, v in rows]
    want = []
    for q, _ in asked:
        own = dict(cut)[q]
        best = sorted((-sum(x * y for x, y in zip(own, w)), j) for j, w in cut if j != q)[:4]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, T.top_k(df, F.col("vec_id") % 1000 == 0, 4).collect())) == sorted(want)
