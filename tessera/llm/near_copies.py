"""Near copies for the pipeline: SimHash with pivots and MinHash bands for candidates, exact Jaccard for links.

Two texts link if their sets of five-word shingles have a Jaccard similarity of
``SIMILAR`` or more.  The first candidates are those of operator 10: fingerprints of the same shingles that
link at its radius, found by block keys and pivot distances.  Pairs at 0.8 are 4 to 14 bits apart, beyond what any
number of pivots selects, so bands go beside it: ``BANDS`` bands of ``ROWS`` least hashes make candidates: a pair
at 0.8 shares no band with a chance of (1 - 0.8 ** 5) ** 24 = 7e-5, a pair at 0.9 with
one of 6e-10.  Sets are compared whole, as sets of 64-bit shingle hashes.

Equal sets are one node.  Under a band, members are first held against one of them only,
in ``STARS`` rounds, so a large group of near copies costs as many comparisons as it has
members.  What is left are bands whose members are not yet one component: each member
outside its band's main component is compared with the members of other components,
first by one bit of each least hash (a pair at 0.8 differs in more than ``FAR`` of 128
bits with a chance below 1e-5), then by the sets.

Defined results: texts without words are equal to each other, shorter texts than a shingle
are one shingle; repeated rows stay once; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash_pivots import fingerprint, fingerprint_links

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, ROWS, HASHES, FAR, STARS = 24, 5, 128, 30, 2


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order."""
    from xxhash import xxh64_intdigest as h64

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    n = max(1, len(found) - words + 1)
    return np.unique(np.fromiter((h64(b" ".join(found[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    rnd = np.random.default_rng(SEED)
    factor, plus = rnd.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1), rnd.integers(0, 1 << 64, HASHES, dtype=np.uint64)
    least = np.full(HASHES, ~np.uint64(0), np.uint64)
    for k in range(0, len(shingles), 4096):  # bounded memory for very long texts
        least = np.minimum(least, (shingles[k : k + 4096, None] * factor + plus).min(axis=0))
    return least


def sketches(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, a key of the text, a key of the shingle set, its bands and 128 bits, and the text's SimHash."""
    common.ship(docs.sparkSession)

    def run(batches):
        from xxhash import xxh64_intdigest as h64

        for batch in batches:
            keys, bands, bits, fps = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, words)
                m = least_hashes(s)
                keys.append(h64(s.tobytes(), SEED))
                bands.append([h64(m[ROWS * b : ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)] if len(s) else [])
                fps.append(fingerprint(text, words))
                bits.append(np.packbits((m >> np.uint64(40)) & np.uint64(1) == 1).view(np.int64))
            sizes = np.cumsum([0, *map(len, bands)])
            flat = np.array([h for b in bands for h in b], np.uint64).view(np.int64)
            bits = np.array(bits, np.int64).reshape(-1, 2)
            cols = [batch.column(0), batch.column(1), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "set_key", "bands", "s0", "s1", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, set_key long, bands array<long>, s0 long, s1 long, fp long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(set_key, shingles) of the ``wanted`` rows (doc_id, text_key, set_key)."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["set_key", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_text"), F.col("text").cast("string").alias("text"))
    rows = rows.join(wanted, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_text") == F.col("text_key")))
    return rows.select("set_key", "text").mapInArrow(run, "set_key long, shingles array<long>").dropDuplicates(["set_key"])


def similar_pairs(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    a, b = (sets.select(F.col("set_key").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return pairs.join(a, "a").join(b, "b").where(both >= F.lit(similar) * either).select("a", "b")


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or link, one pair a set and link at most."""
    hubs = nodes.groupBy("fp").agg(F.min("set_key").alias("hub"))
    a, b = (hubs.select(F.col("fp").alias(x), F.col("hub").alias(f"hub_{x}")) for x in "ab")
    near = fingerprint_links(hubs.select("fp")).join(a, "a").join(b, "b").select("hub_a", "hub_b")
    pairs = nodes.join(hubs, "fp").select("hub", "set_key").unionAll(near).toDF("x", "y").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(node, component) of the sets (set_key, doc_id, text_key, bands, s0, s1, fp) that link to another."""
    keys = nodes.select("set_key", "s0", "s1", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = common.materialize(keys.join(shared, "band"), "near-members")
    first = common.materialize(simhash_pairs(nodes), "near-simhash")
    asked = members.select("set_key").unionAll(first.select("a")).unionAll(first.select("b"))
    wanted = asked.distinct().join(nodes.select("set_key", "doc_id", "text_key"), "set_key")
    sets = common.materialize(shingle_sets(docs, wanted, words), "near-sets")
    found = common.materialize(similar_pairs(first, sets), "near-links")
    for turn in range(STARS):
        hub = members.groupBy("band").agg(F.min(F.struct(F.xxhash64("set_key", F.lit(turn)).alias("order"), "set_key")).alias("hub"))
        pairs = members.join(hub, "band").select(F.least("set_key", "hub.set_key").alias("a"), F.greatest("set_key", "hub.set_key").alias("b")).where("a <> b").distinct()
        new = common.materialize(similar_pairs(pairs, sets), "near-links")
        found = found.unionAll(new)
        # the component of each member, and the bands that hold more than one
        label = components(found, "a", "b").withColumnRenamed("node", "set_key")
        now = common.materialize(members.join(label, "set_key", "left").withColumn("component", F.coalesce("component", "set_key")), "near-members")
        open_bands = now.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("main")).where("parts > 1")
        members = common.materialize(now.join(open_bands.select("band", F.col("main.component").alias("main")), "band").select("set_key", "s0", "s1", "band", "component", "main"), "near-open")
        now = members
        members = members.drop("component", "main")
    x, y = (now.select("band", *(F.col(c).alias(f"{c}_{k}") for c in ("set_key", "s0", "s1", "component")), *([F.col("main")] if k == "x" else [])) for k in "xy")
    apart = F.bit_count(F.col("s0_x").bitwiseXOR(F.col("s0_y"))) + F.bit_count(F.col("s1_x").bitwiseXOR(F.col("s1_y")))
    pairs = x.where("component_x <> main").join(y, "band").where((F.col("component_x") != F.col("component_y")) & (apart <= FAR))
    pairs = pairs.select(F.least("set_key_x", "set_key_y").alias("a"), F.greatest("set_key_x", "set_key_y").alias("b")).distinct()
    return components(found.unionAll(common.materialize(similar_pairs(pairs, sets), "near-links")), "a", "b")


def keep_first(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest doc_id; columns as they were."""
    found = common.materialize(sketches(docs, words), "near-sketches")
    nodes = found.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"), *(F.first(c).alias(c) for c in ("bands", "s0", "s1")), F.min("fp").alias("fp"))
    nodes = common.materialize(nodes.select("*", "first.doc_id", "first.text_key"), "near-nodes")
    classes = links(docs, nodes, words)
    best = nodes.join(classes, nodes.set_key == classes.node, "left").groupBy(F.coalesce("component", "set_key").alias("component")).agg(F.min("first").alias("best"))
    return common.once(common.match_rows(docs, best.select("best.doc_id", "best.text_key"), "left_semi"))
