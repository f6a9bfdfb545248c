"""Incremental k-means against plain Python, and its SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np

from tessera.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string, __v int"


def plain(rows, dim, k, rounds, scale=256, seed=2):
    most = C.most_component(dim)
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and all(abs(x * scale) <= most for x in v):
            kept.append((i, [math.floor(x * scale) for x in v]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(cs)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {}
    for _, c, d in out:
        sums[c] = sums.get(c, 0) + d
    fits = lambda x: x if x < 2**63 else None
    return [(i, c, d, fits(sums[c]), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in out]


def check(spark, rows, dim, k, rounds, parts=3):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)
    got = C.cluster(df, dim, k, rounds)
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.drop("centroid").collect()), key=key) == sorted(plain(rows, dim, k, rounds), key=key)
    return got


def test_odd_rows(spark):
    rnd = random.Random(1)
    rows = [(k % 70, [rnd.gauss(k % 3, 0.3) for _ in range(4)]) for k in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [-float("inf"), 0.0, 0.0, 0.0]), (207, [1e300, 0.0, 0.0, 0.0])]
    rows += [(None, [0.5] * 4), (None, [0.25] * 4), (300, [0.5] * 4), (300, [0.5] * 4), (301, [-0.001, 0.001, -1.0, 1.0])]
    got = check(spark, rows, 4, 7, 5)
    r = got.first()
    assert hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest() == r["centroid_sha256"]


def test_few_equal_and_no_vectors(spark):
    check(spark, [(k, [1.0, 2.0]) for k in range(9)], 2, 4, 3)  # all tie: the smallest number, the others stay empty
    check(spark, [(1, [0.0, 1.0]), (2, [5.0, 1.0])], 2, 40, 5)
    check(spark, [(1, None)], 2, 3, 2)
    check(spark, [], 2, 3, 2)


def test_wide_components_are_exact(spark):
    rnd = random.Random(2)
    most = C.most_component(3) / 256
    rows = [(k, [rnd.choice([-1, 1]) * most * rnd.random() for _ in range(3)]) for k in range(60)]
    rows += [(100, [most, -most, most]), (101, [-most, most, -most]), (102, [most + 1, 0.0, 0.0])]
    check(spark, rows, 3, 5, 4)


def test_products_only_enter_moved_components():
    rng = np.random.default_rng(3)
    v = rng.integers(-1000, 1000, (50, 8))
    change = np.array([0, 5, 0, 0, -7, 0, 0, 1])
    vt = np.ascontiguousarray(v.T.astype(float))
    vt[[0, 2, 3, 5, 6]] = np.nan  # components that do not move are not read
    assert (C.products(vt, change, 1000) == v @ change).all()
    assert (C.products(vt, np.zeros(8, np.int64), 1000) == 0).all()
    big = np.array([2**40, 3]) * np.array([1, 1])
    w = np.array([[2**20 + 1, 7], [-5, 2**20]])
    assert (C.products(w.T.astype(float), big, 2**20 + 1) == w @ big).all()


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = C.op12_centroid_clusters(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({C.ORACLES['op12_centroid_clusters']})").fetchall()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want) == sorted(plain(rows, 64, 40, 5))
