"""Operator 10: SimHash near-duplicates with pivot distance tables.

Fingerprints (64 bits over word shingles) link at ``radius`` or fewer differing bits.
Distinct fingerprints only are compared.  The bits are cut into ``radius + t`` blocks;
a linked pair agrees on t of them at least, so it meets under one of the keys made of t
blocks, and no link is lost; t grows with the table, so that a key keeps few fingerprints.
Under a key, each fingerprint carries its row of the pivot table, its Hamming distances
to reference fingerprints: by the triangle inequality a pair whose rows differ by more
than ``radius`` in any coordinate cannot link, so only those within ``radius`` of each
other in the first coordinate are looked at and those that differ more in another are
discarded; survivors are verified by counting differing bits.  A key with many
fingerprints is cut into blocks and its pairs of blocks are dealt to different tasks.

Pivot distances alone do not select enough: two random fingerprints are within 4 of each
other's distance to a pivot with a chance of 0.52, so 2**-21, what the smallest keys
leave, takes 22 pivots, and a grid over 22 coordinates would copy each row 2**22 times.
A task emits a spanning forest of the links of its group, not all pairs; components
then join the forests.

Defined results: a null, empty or blank text has fingerprint zero and links like any
other; rows with a null ``doc_id`` get the component of their fingerprint; repeated rows
are kept; an empty table gives no rows; other columns are not read.  Rows are told apart by
``doc_id`` and a 64-bit hash of the text.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Reference fingerprints of the pivot table.
PIVOTS = 24
#: Fingerprints of one key that a task compares; more are cut into blocks of this size.
GROUP = 2048
#: Random fingerprints that a key may hold on average before one more block has to agree.
USUAL = 64


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest as h64

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    hashes = [h64(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())]
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, a key of the text, and fingerprint ``fp`` (the 64 bits as a signed long)."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints (fixed, from a seed)."""
    refs = np.random.default_rng(SEED).integers(0, 1 << 64, pivots, dtype=np.uint64)
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def group_forest(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places of a spanning forest of the links within one group."""
    order = np.argsort(table[:, 0], kind="stable")
    left = order  # not reached yet, in order of the first pivot distance
    out = []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            first = table[left, 0]
            a, b = np.searchsorted(first, [table[i, 0] - radius, table[i, 0] + radius + 1])
            some = left[a:b]
            near = some[np.abs(table[some] - table[i]).max(axis=1) <= radius] if len(some) else some
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
            if len(near):
                out += [(int(i), int(j)) for j in near]
                stack += near.tolist()
                left = np.concatenate([left[:a], some[~np.isin(some, near)], left[b:]])
    return out


def _link_groups(radius: int, pivots: int):
    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(keys, fps):
            """Links of whole groups that lie together in key order."""
            table = pivot_table(fps, pivots)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, sizes = np.concatenate([[0], cuts]), np.diff(np.concatenate([[0], cuts, [len(keys)]]))
            a, b = [], []
            small = np.repeat(sizes <= 24, sizes)
            for d in range(1, 24):
                i = np.flatnonzero((keys[:-d] == keys[d:]) & small[:-d]) if len(keys) > d else np.zeros(0, int)
                if not len(i):
                    break
                i = i[np.abs(table[i] - table[i + d]).max(axis=1) <= radius]
                i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
                a.append(i)
                b.append(i + d)
            for s, n in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist()):
                pairs = np.array(group_forest(fps[s : s + n], table[s : s + n], radius), dtype=int).reshape(-1, 2) + s
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
            a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last group may go on
            if whole:
                yield links(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield links(keys, fps)

    return run


def key_masks(agreeing: int, radius: int) -> list[int]:
    """The bits of each key, as signed longs: every choice of so many of ``radius + agreeing`` blocks."""
    blocks = radius + agreeing
    edges = [64 * k // blocks for k in range(blocks + 1)]
    of = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(some) for some in combinations(of, agreeing))]


def agreeing_blocks(n: int, radius: int) -> int:
    """How many blocks make a key, so that n random fingerprints leave ``USUAL`` or fewer under it."""
    for agreeing in range(2, 6):
        if n <= USUAL << 64 * agreeing // (radius + agreeing):
            break
    return agreeing


def fingerprint_links(distinct_fps: DataFrame, radius: int = RADIUS, pivots: int = PIVOTS, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every component at ``radius``."""
    keys = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(m)) for t, m in enumerate(key_masks(agreeing_blocks(distinct_fps.count(), radius), radius))))
    rows = distinct_fps.select("fp", F.explode(keys).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(counts, "key").withColumn("cuts", F.ceil(F.col("n") / group).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts"))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    # a group is a pair of blocks of one key; its id is a hash, and groups that share one are merely compared together
    gid = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select(gid.alias("gid"), "fp").repartition(common.scale_partitions(distinct_fps.sparkSession), "gid").sortWithinPartitions("gid")
    return dealt.mapInArrow(_link_groups(radius, pivots), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, fp, component and component_id, the smallest doc_id that links reach, for every row."""
    found = common.materialize(fingerprints(docs, words), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    classes = components(fingerprint_links(distinct.select("fp"), radius), "a", "b")
    classes = distinct.join(classes, distinct.fp == classes.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return found.join(classes.join(least, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest doc_id; columns as they were."""
    found = near_duplicates(docs, words, radius)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best")).select("best.doc_id", "best.text_key")
    return common.once(common.match_rows(docs, best, "left_semi"))


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash_pivots": op10_simhash_pivots}
ORACLES: dict[str, str] = {}
