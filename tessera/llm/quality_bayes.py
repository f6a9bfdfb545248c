"""Operator 8: quality by a document classifier and hierarchical empirical Bayes.

A small additive model (logistic regression over decile indicators of text statistics)
gives each document's own evidence.  It is fitted on a bounded sample of labelled documents:
the ``MOST_TRAINING`` rows of the smallest hash of their id, the only cut.  Everything else covers all
data: grouped sums of the evidence give each host a posterior shrunk towards the global
rate, and each path of a host one shrunk towards its host; the prior's weight comes from
the spread between groups (method of moments), so sparse sites stay close to their
prior.  A document's own part is taken out of its site's sums.  The path's posterior
shifts the document's log odds; below one half it is rejected.

Defined results: a null text is an empty one; null hosts and paths are groups of their
own; labels for unknown documents are ignored, repeated labels all count; without any
usable label (or with one class only) every document gets the smoothed global rate;
repeated rows are scored alike; an empty table gives no rows; other columns are kept.
Rows are told apart by ``doc_id``, host, path and a 64-bit hash of the text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled sample that reaches the driver.
MOST_TRAINING = 20_000
BINS, RIDGE, THRESHOLD = 12, 1.0, 0.5

FEATURES = ("log_words", "word_length", "distinct_words", "top_word", "repeats", "letters", "upper", "digits", "symbols", "symbol_words", "bars", "stops", "line_words", "short_words")

_CLASS = np.zeros((256, 6), np.int64)
for _c in range(256):
    _CLASS[_c] = (chr(_c).isalpha() or _c >= 128, 65 <= _c <= 90, 48 <= _c <= 57, _c < 128 and not chr(_c).isalnum() and _c not in b" \t\n\r.,;:'-", _c == 124, _c in b".,")


def text_features(text: str) -> list[float]:
    """Statistics of one whole text, in the order of FEATURES."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    letters, upper, digits, symbols, bars, stops = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS).tolist()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    m = max(1, n)
    return [
        math.log1p(n), len(raw) / m, len(counts) / m, max(counts.values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / m,
        letters / size, upper / size, digits / size, symbols / size, sum(w[-1:] in (b"*", b"$", b"%", b"&", b"#", b"|", b"!") for w in words) / m, bars / m,
        stops / m, n / (raw.count(b"\n") + 1), sum(len(w) <= 3 for w in words) / m,
    ]


def with_features(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, a key of the text, host, path and the feature vector."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            f = [text_features(t) for t in batch.column("text").to_pylist()]
            cols = [batch.column(n) for n in ("doc_id", "text_key", "host", "path")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(f, pa.list_(pa.float32()))], names=["doc_id", "text_key", "host", "path", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, host string, path string, features array<float>")


class Additive:
    """Logistic regression over one-hot decile bins of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = math.log(rate / (1 - rate))
        self.weights = np.zeros(1 + sum(len(c) + 1 for c in self.cuts))
        self.weights[0] = self.base
        if len(y) and 0 < y.sum() < len(y):
            z = self.design(x)
            ridge = np.full(z.shape[1], RIDGE)
            ridge[0] = 1e-6
            for _ in range(25):
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                w = np.maximum(p * (1 - p), 1e-6)
                step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * (self.weights - np.eye(1, len(ridge))[0] * self.base))
                self.weights += step
                if np.abs(step).max() < 1e-6:
                    break

    def design(self, x: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(x), len(self.weights))), 1
        out[:, 0] = 1
        for c, cuts in zip(x.T, self.cuts):
            out[np.arange(len(x)), at + np.searchsorted(cuts, c, side="right")] = 1
            at += len(cuts) + 1
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weights, -20, 20)


def fit(features: DataFrame, labels: DataFrame, most: int = MOST_TRAINING) -> Additive:
    """Fit on the bounded sample of labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("place")
    labelled = common.materialize(features.select("doc_id", "features").join(known, "doc_id").select("doc_id", "features", "y", place), "quality-labelled")
    # only places that the smallest ones can have, so that no more than about the sample reaches the driver
    n = labelled.count()
    near = labelled.where(F.col("place") < int((1 << 40) * min(1.0, 1.5 * most / max(n, 1))))
    if near.count() < min(n, most):  # a few ids hold most rows
        near = labelled
    got = common.materialize(near.orderBy("place", "doc_id", "y", "features").limit(most), "quality-sample").toPandas()  # ``most`` rows at most
    got = got.sort_values(["place", "doc_id", "y"], kind="stable")
    x = np.array(got["features"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return Additive(x, got["y"].to_numpy(dtype=float))


def _weight(groups: DataFrame, rate: float) -> float:
    """Prior weight (as a number of documents) from the spread of the groups' means: method of moments."""
    spread = rate * (1 - rate)
    row = groups.where("n > 1").agg(F.sum("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - rate, 2)), F.count("*")).first()
    if not row[0] or spread <= 0:
        return 100.0
    between = row[1] / row[0] - spread * row[2] / row[0]
    return float(min(1e6, max(1.0, spread / max(between, 1e-9) - 1)))


def site_of(url: Column) -> tuple[Column, Column]:
    """Host and first directory of an address, for tables that have one (null where there is none)."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*/)", 1)
    return F.nullif(host, F.lit("")), F.when(F.nullif(host, F.lit("")).isNotNull(), F.when(path == "", "/").otherwise(path))


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, most: int = MOST_TRAINING) -> DataFrame:
    """doc_id, text_key, host, path, p_document, p_host, p_path and p_good of every row."""
    host = host if host is not None else F.col("source")
    path = path if path is not None else F.col("lang")
    features = common.materialize(with_features(docs, host, path), "quality-features")
    model = fit(features, labels, most)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            cols = [batch.column(n) for n in ("doc_id", "text_key", "host", "path")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(model.log_odds(x))], names=["doc_id", "text_key", "host", "path", "own"])

    rows = features.mapInArrow(run, "doc_id long, text_key long, host string, path string, own double")
    rows = common.materialize(rows.withColumn("p_document", 1 / (1 + F.exp(-F.col("own")))), "quality-evidence")
    paths = common.materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_document").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    rate = min(1 - 1e-6, max(1e-6, (s + 1) / (n + 2))) if n else 0.5
    w_host, w_path = _weight(hosts, rate), _weight(paths, rate)
    sites = paths.withColumnsRenamed({"n": "n_path", "s": "s_path"}).alias("p").join(hosts.withColumnsRenamed({"host": "h", "n": "n_host", "s": "s_host"}), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    sites = sites.withColumnsRenamed({"host": "h", "path": "p"})
    # the sites' table is joined as adaptive execution finds fit: broadcast where small, else split where skewed
    out = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    out = out.withColumn("p_host", (F.col("s_host") - F.col("p_document") + w_host * rate) / (F.col("n_host") - 1 + w_host))
    out = out.withColumn("p_path", (F.col("s_path") - F.col("p_document") + w_path * F.col("p_host")) / (F.col("n_path") - 1 + w_path))
    odds = F.col("own") + F.log(F.col("p_path") / (1 - F.col("p_path"))) - F.lit(math.log(rate / (1 - rate)))
    out = out.withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "text_key", "host", "path", "p_document", "p_host", "p_path", "p_good")


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rejected rows, columns as they were."""
    host, path = host if host is not None else F.col("source"), path if path is not None else F.col("lang")
    bad = score(docs, labels, host, path).where(F.col("p_good") < threshold).select("doc_id", "text_key", "host", "path").distinct()
    return common.match_rows(docs, bad, "left_anti", host=host.cast("string"), path=path.cast("string"))


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "host", "path", "p_document", "p_host", "p_path", "p_good", (F.col("p_good") >= THRESHOLD).alias("keep"))


QUERIES = {"op8_quality_bayes": op8_quality_bayes}
ORACLES: dict[str, str] = {}
