"""The hierarchy in plain Python, sparse sites, twins of other hosts, and which labels the sample takes."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, quality_bayes

SF = "/root/testdata/sf0.001"


def weight(groups, rate):
    some = [(n, s) for n, s in groups if n > 1]
    total, spread = sum(n for n, _ in some), rate * (1 - rate)
    if not total or spread <= 0:
        return 100.0
    between = sum(n * (s / n - rate) ** 2 for n, s in some) / total - spread * len(some) / total
    return min(1e6, max(1.0, spread / max(between, 1e-9) - 1))


def plain(rows):
    """p_host, p_path and p_good of (host, path, p_document) rows."""
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, p, x in rows:
        for g in (paths[h, p], hosts[h]):
            g[0] += 1
            g[1] += x
    rate = (sum(s for _, s in hosts.values()) + 1) / (len(rows) + 2)
    wh, wp = weight(hosts.values(), rate), weight(paths.values(), rate)
    out = []
    for h, p, x in rows:
        a = (hosts[h][1] - x + wh * rate) / (hosts[h][0] - 1 + wh)
        b = (paths[h, p][1] - x + wp * a) / (paths[h, p][0] - 1 + wp)
        odds = math.log(x / (1 - x)) + math.log(b / (1 - b)) - math.log(rate / (1 - rate))
        out.append((a, b, 1 / (1 + math.exp(-odds))))
    return out


def test_hierarchy_with_sparse_sites(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    site = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("only"), F.col("doc_id"))).when(F.col("doc_id") % 50 == 1, None).otherwise(F.col("source"))
    rows = quality_bayes.score(docs, labels, site, F.when(F.col("doc_id") % 7 == 2, None).otherwise(F.col("lang"))).collect()
    assert len(rows) == docs.count() and sum(r["host"] is None for r in rows) > 1
    want = plain([(r["host"], r["path"], r["p_document"]) for r in rows])
    for r, w in zip(rows, want):
        assert (r["p_host"], r["p_path"], r["p_good"]) == pytest.approx(w, rel=1e-6, abs=1e-9)
    rate = (sum(r["p_document"] for r in rows) + 1) / (len(rows) + 2)
    lone = [r for r in rows if (r["host"] or "").startswith("only")]
    assert lone and all(r["p_path"] == pytest.approx(rate, rel=1e-6) and r["p_good"] == pytest.approx(r["p_document"], rel=1e-4, abs=1e-7) for r in lone)


def test_labels_of_unknown_documents_take_no_place(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    more = spark.range(10_000_000, 10_005_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    known = labels.count()
    one, two = ({(r["doc_id"], round(r["p_document"], 9)) for r in quality_bayes.score(docs, x, most=known).collect()} for x in (labels, labels.unionByName(more, allowMissingColumns=True)))
    assert one == two and len({p for _, p in one}) > 10


def test_a_rejected_row_leaves_its_twin_of_another_host(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    twin = docs.withColumn("source", F.lit("elsewhere")).withColumn("key_host", F.lit(1))
    both = docs.withColumn("key_host", F.lit(0)).unionByName(twin)
    scored = quality_bayes.score(both, labels)
    bad = {(r["doc_id"], r["host"]) for r in scored.where("p_good < 0.5").collect()}
    kept = [(r["doc_id"], r["source"]) for r in quality_bayes.keep_good(both, labels).collect()]
    assert len(kept) == both.count() - scored.where("p_good < 0.5").count() and not bad & set(kept)


def test_site_of(spark):
    urls = ["https://User@Example.org:81/a/b/c?x=/y/", "http://h.net", "HTTP://h.net/page", "http://h.net?q=/a/", "no address", None]
    host, path = quality_bayes.site_of(F.col("u"))
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(host.alias("h"), path.alias("p")).collect()
    assert [tuple(r) for r in got] == [("example.org", "/a/"), ("h.net", "/"), ("h.net", "/"), ("h.net", "/"), (None, None), (None, None)]
