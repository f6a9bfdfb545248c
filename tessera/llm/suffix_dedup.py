"""Operator 1: exact substring dedup from difference-cover suffix samples.

A byte is removed if a string of ``min_len`` bytes that covers it also starts anywhere
else in the corpus.  Suffixes enter at the positions of a difference cover modulo ``v``
first: of any two equal strings there is a shift below ``v`` at which both have a sample,
so the first ``min_len - v + 1`` bytes from there are equal too.  The samples are sorted
one suffix bucket at a time (a bucket holds the prefixes of one range of keys and is
bounded, however large the corpus), which ranks them as repeated or not.  Only suffixes
that start less than ``v`` bytes before a repeated sample can be ties over ``min_len``
bytes; these are sorted the same way, in a second pass over buckets, and equal neighbours
are the repeated strings.

A suffix is compared by a fingerprint of the bytes that count instead of the bytes
themselves, so buckets are ranges of fingerprints and not of the alphabet.  Samples have 64
bits: two that are equal by chance only bring candidates.  The strings behind repeated samples,
which decide, have 96 bits, so equality (all that dedup needs of the order) has a chance of
2**-96 a pair to be wrong.  Prefixes would have to travel: there are 0.09 samples a byte
of text, so 32 bytes of each are 2.9 times the text, where the fingerprints are 0.7 times.

Texts are laid out once in parts (a table bucketed by part in the warehouse), and later
passes bring only packed fingerprints (ordered ones, by their differences) to the buckets and bits
back, so no text is shuffled.  A part sends each fingerprint once, so a passage that a third of all documents
share is as cheap as any other.

Defined results: a null text is an empty one; matches never cross documents; repeated
rows are documents of their own (a text of ``min_len`` bytes or more that occurs twice is
removed whole, from both); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

MIN_LEN = 400
#: Bytes of text in a part (a longer text is a part of its own) and positions handled at once.
PART_BYTES, SLICE = 8 << 20, 1 << 20
#: Text bytes for each suffix bucket: a bucket then holds some MB of fingerprints.
BUCKET_BYTES = 12 << 20

# Perfect difference sets, modulus to members; every residue is a difference of two.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 6, 15, 22, 26, 45, 55),
    133: (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121),
}
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: ASCII white space between words.
SPACES = np.frombuffer(b" \t\n\x0b\f\r", np.uint8)


def cover_for(min_len: int) -> tuple[int, tuple[int, ...]]:
    """Modulus and cover: the largest that leaves two thirds of the length to compare."""
    fit = [v for v in COVERS if v <= min_len // 3]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


class Fingerprints:
    """64-bit fingerprints of the strings of some length at given positions of one byte array.

    Eight bytes at a time are mixed in by a product and a shift, so unlike those of a
    polynomial modulo 2**64 the results of similar or periodic strings are no closer to
    each other than those of any two strings.
    """

    @staticmethod
    def mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
        h = (h ^ w) * np.uint64(BASE)
        return h ^ (h >> np.uint64(32))

    @classmethod
    def of(cls, data: np.ndarray, positions: np.ndarray, length) -> np.ndarray:
        """``positions`` ascend; slices bound the memory.  ``length`` is one number, or an array with that of each."""
        out = np.empty(len(positions), np.uint64)
        length = np.broadcast_to(np.asarray(length, np.int64), positions.shape)
        k = 0
        while k < len(positions):
            first = int(positions[k])
            e = int(np.searchsorted(positions, first + SLICE))
            n, at = length[k:e], positions[k:e] - first
            part = np.concatenate([data[first : first + int((at + n).max())], np.zeros(8, np.uint8)])
            words = np.ndarray(len(part) - 7, "<u8", part, strides=(1,)).copy()
            h = n.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            whole, least = n >> 3, int(n.min()) >> 3
            for j in range(int(whole.max())):
                w = words[np.minimum(at + 8 * j, len(words) - 1)] if j >= least else words[at + 8 * j]
                h = np.where(j < whole, cls.mix(h, w), h) if j >= least else cls.mix(h, w)
            rest = (n & 7).astype(np.uint64) << np.uint64(3)
            h = cls.mix(h, words[at + 8 * whole] & ((np.uint64(1) << rest) - np.uint64(1)))
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[k:e] = h ^ (h >> np.uint64(32))
            k = e
        return out


    @classmethod
    def second(cls, data: np.ndarray, positions: np.ndarray, length: int) -> np.ndarray:
        """32 bits of another kind, for strings of one length: sums of mixed words with powers of a base.

        The word at every position is mixed once, and running sums over positions eight apart
        give the sum of any string as a difference, whatever its length.
        """
        out = np.empty(len(positions), np.uint64)
        whole, rest, k = length >> 3, np.uint64(8 * (length & 7)), 0
        while k < len(positions):
            first = int(positions[k])
            e = int(np.searchsorted(positions, first + SLICE))
            at = positions[k:e] - first
            part = np.concatenate([data[first : first + int(at[-1]) + length], np.zeros(16, np.uint8)])
            words = np.ndarray(len(part) - 7, "<u8", part, strides=(1,)).copy()
            g = cls.mix(cls.mix(words, np.uint64(SECOND)), words)
            rows = -(-len(g) // 8)
            g = np.append(g, np.zeros(8 * rows - len(g), np.uint64)).reshape(rows, 8)
            power, back = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(rows - 1, b, np.uint64)])) for b in (SECOND, pow(SECOND, -1, 1 << 64)))
            sums = np.zeros((rows + 1, 8), np.uint64)
            np.cumsum(g * power[:, None], axis=0, out=sums[1:])
            j, r = at >> 3, at & 7
            h = cls.mix((sums[j + whole, r] - sums[j, r]) * back[j], words[at + 8 * whole] & ((np.uint64(1) << rest) - np.uint64(1)))
            out[k:e] = (h * np.uint64(BASE)) >> np.uint64(32)
            k = e
        return out


def together(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """An order by the first and then the second column; the second is sorted only if one of the first has several."""
    order = np.argsort(first)
    a, b = first[order], second[order]
    return np.lexsort((second, first)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


class Part:
    """The texts of one part: their bytes, where each begins, and its positions of interest."""

    def __init__(self, blob: bytes, sizes, min_len: int):
        self.data, self.sizes, self.min_len = np.frombuffer(blob, np.uint8), np.asarray(sizes, np.int64), min_len
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.v, self.cover = cover_for(min_len)
        self.sample_len = min_len - self.v + 1

    def samples(self) -> np.ndarray:
        """Cover positions, counted within each text, with enough bytes behind them."""
        out = []
        cover = np.array(self.cover)
        for s, n in zip(self.starts.tolist(), self.sizes.tolist()):
            if n >= self.min_len:
                last = n - self.sample_len
                p = (np.arange(0, last + 1, self.v)[:, None] + cover).ravel()
                out.append(s + p[p <= last])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def before(self, samples: np.ndarray) -> np.ndarray:
        """Starts of whole strings that have one of the samples less than ``v`` bytes on."""
        doc = np.searchsorted(self.ends, samples, side="right")
        low, high = np.maximum(samples - self.v + 1, self.starts[doc]), np.minimum(samples, self.ends[doc] - self.min_len)
        keep = low <= high
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, low[keep], 1)
        np.add.at(edge, high[keep] + 1, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]))

    def windows(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the runs of so many words that are shorter than ``min_len`` bytes."""
        space = np.isin(self.data, SPACES)
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.starts], edge[self.ends] = True, True
        before, after = np.concatenate([[True], space]) | edge, np.concatenate([space, [True]]) | edge
        first, end = np.flatnonzero(before[:-1] & ~space), np.flatnonzero(after[1:] & ~space) + 1
        if len(first) < words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, length = first[: len(first) - words + 1], end[words - 1 :] - first[: len(first) - words + 1]
        same = np.searchsorted(self.ends, first, side="right") == np.searchsorted(self.ends, first + length - 1, side="right")
        keep = same & (length < self.min_len)
        return first[keep], length[keep]

    def keys(self, positions: np.ndarray, length, wide: bool = False):
        """The distinct fingerprints in order (``wide``: rows of one of 64 and one of 32 bits), which of them each position has, and which occur twice here."""
        h = Fingerprints.of(self.data, positions, length)
        if not wide:
            distinct, which, n = np.unique(h, return_inverse=True, return_counts=True)
            return distinct, which, n > 1
        h = np.column_stack([h, Fingerprints.second(self.data, positions, length)])
        order = together(h[:, 0], h[:, 1])
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]).any(axis=1)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        return h[new], which, np.bincount(which, minlength=int(new.sum())) > 1


def bucket_edges(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in the ordered fingerprints (and the end)."""
    cuts = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(distinct if distinct.ndim == 1 else distinct[:, 0], cuts), [len(distinct)]])


def sort_bucket(part_keys: list[np.ndarray]) -> list[np.ndarray]:
    """For the distinct fingerprints of each part: whether another part has them too."""
    every = np.concatenate(part_keys)
    wide = every.ndim == 2
    order = together(every[:, 0], every[:, 1]) if wide else np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    same = same.all(axis=1) if wide else same
    twice = np.zeros(len(every), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return np.split(twice, np.cumsum([len(k) for k in part_keys])[:-1])


def pack_keys(distinct: np.ndarray, base: int) -> bytes:
    """Ordered fingerprints from ``base`` on: a byte with the width of the differences, these, and 32 bits each of a second column."""
    first = distinct if distinct.ndim == 1 else distinct[:, 0]
    step = np.diff(first, prepend=np.uint64(base))
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    raw = bytes([width]) + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return raw if distinct.ndim == 1 else raw + distinct[:, 1].astype("<u4").tobytes()


def unpack_keys(raw: bytes, base: int, wide: bool) -> np.ndarray:
    width = raw[0]
    n = (len(raw) - 1) // (width + 4 * wide)
    step = np.zeros((n, 8), np.uint8)
    step[:, :width] = np.frombuffer(raw, np.uint8, n * width, 1).reshape(n, width)
    first = np.cumsum(step.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)
    return np.column_stack([first, np.frombuffer(raw, "<u4", n, 1 + n * width).astype(np.uint64)]) if wide else first


def _emit_keys(part_id, distinct, buckets) -> pa.Table:
    edges = bucket_edges(distinct, buckets)
    some = np.flatnonzero(np.diff(edges))
    packed = [pack_keys(distinct[edges[b] : edges[b + 1]], (b << 64) // buckets) for b in some.tolist()]
    return pa.table({"bucket": pa.array(some, pa.int32()), "part": pa.array([part_id] * len(some), pa.int64()), "keys": pa.array(packed, pa.binary())})


def _flags_of(flags: pa.Table, which_pass: int, distinct: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that came back for one part, in the order of its fingerprints."""
    edges, out = bucket_edges(distinct, buckets), np.zeros(len(distinct), bool)
    for p, b, bits in zip(flags["pass"].to_pylist(), flags["bucket"].to_pylist(), flags["flags"].to_pylist()):
        if p == which_pass:
            n = edges[b + 1] - edges[b]
            out[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


def _rank(keys: DataFrame, which_pass: int, buckets: int) -> DataFrame:
    """Sort each suffix bucket; (part, pass, bucket, flags) of the repeated fingerprints."""

    def run(key, rows):
        base = (rows["bucket"][0].as_py() << 64) // buckets
        found = sort_bucket([unpack_keys(k, base, which_pass == 2) for k in rows["keys"].to_pylist()])
        n = len(found)
        return pa.table({"part": rows["part"].cast(pa.int64()), "pass": pa.array([which_pass] * n, pa.int32()), "bucket": rows["bucket"].cast(pa.int32()), "flags": pa.array([np.packbits(f).tobytes() for f in found], pa.binary())})

    return keys.groupBy("bucket").applyInArrow(run, "part long, pass int, bucket int, flags binary")


def lay_out(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Write the texts in parts, bucketed by part, so that later passes need not move them.

    Each ``carry`` column goes along as an array, named ``c0``, ``c1``, ...
    """
    spark = docs.sparkSession
    kinds = [docs.schema[c].dataType for c in carry]
    lists = [pa.list_(to_arrow_type(k)) for k in kinds]
    names = ["part", "sizes", "n_bytes", "blob", *(f"c{i}" for i in range(len(carry)))]

    def parts(batches):
        from pyspark import TaskContext

        first, k, held, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def row():
            cols = [pa.array([first + k]), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([b"".join(texts)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols + [pa.array([list(v)], t) for v, t in zip(zip(*held), lists)], names=names)

        for batch in batches:
            rest = zip(*(c.to_pylist() for c in batch.columns[1:]))
            for text, others in zip(batch.column(0).cast(pa.binary()).to_pylist(), rest):
                if texts and size + len(text) > PART_BYTES:
                    yield row()
                    k, held, texts, size = k + 1, [], [], 0
                held.append(others)
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("__text"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    buckets = min(100_000, max(common.scale_partitions(spark), 2 * rows.rdd.getNumPartitions()))
    name = f"suffix_parts_{uuid.uuid4().hex}"
    # a task's parts fall into few of the buckets, so it writes few files, and no text is shuffled
    schema = "part long, sizes array<bigint>, n_bytes long, blob binary" + "".join(f", c{i} array<{k.simpleString()}>" for i, k in enumerate(kinds))
    rows.mapInArrow(parts, schema).write.option("compression", "zstd").bucketBy(buckets, "part").saveAsTable(name)
    common.remember_table(spark, name)
    return spark.table(name)


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, carry: tuple[str, ...] = ("doc_id",), with_kept: str | None = None, words: int | None = None) -> DataFrame:
    """The ``carry`` columns, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the remaining bytes as ``binary``, or as a ``string`` without torn characters).

    With ``words``, repeated runs of so many whole words go too where they have fewer than ``min_len`` bytes.
    """
    common.ship(docs.sparkSession)
    carry = list(carry)
    laid = lay_out(docs, carry)
    carried = [f"c{i}" for i in range(len(carry))]
    kinds = [docs.schema[c].dataType for c in carry]
    arrow = [to_arrow_type(k) for k in kinds]
    total = laid.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def sample_keys(batches):
        for batch in batches:
            for part, sizes, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                p = Part(blob, sizes, min_len)
                yield from _emit_keys(part, p.keys(p.samples(), p.sample_len)[0], buckets).to_batches()

    def candidates(row: dict, flags: pa.Table):
        p = Part(row["blob"], row["sizes"], min_len)
        samples = p.samples()
        distinct, which, twice = p.keys(samples, p.sample_len)
        repeated = (twice | _flags_of(flags, 1, distinct, buckets))[which]
        return p, p.before(samples[repeated])

    def string_keys(key, left, flags):
        out = [_emit_keys(row["part"], (pc := candidates(row, flags))[0].keys(pc[1], min_len, wide=True)[0], buckets) for row in left.to_pylist()]
        return pa.concat_tables(out) if out else pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int64()), "keys": pa.array([], pa.binary())})

    def window_keys(batches):
        for batch in batches:
            for part, sizes, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                p = Part(blob, sizes, min_len)
                yield from _emit_keys(part, p.keys(*p.windows(words))[0], buckets).to_batches()

    def cut(key, left, flags):
        names = [*carried, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        cols = {n: [] for n in names}
        for row in left.to_pylist():
            p, starts = candidates(row, flags)
            distinct, which, twice = p.keys(starts, min_len, wide=True)
            starts = starts[(twice | _flags_of(flags, 2, distinct, buckets))[which]]
            edge = np.zeros(len(p.data) + min_len + 1, np.int32)
            edge[starts] = 1
            seen = np.cumsum(edge)
            covered = seen[: len(p.data)] > np.concatenate([np.zeros(min(min_len, len(p.data)), np.int32), seen[: max(0, len(p.data) - min_len)]])
            if words:
                first, length = p.windows(words)
                distinct, which, twice = p.keys(first, length)
                again = (twice | _flags_of(flags, 3, distinct, buckets))[which]
                edge = np.zeros(len(p.data) + 1, np.int32)
                np.add.at(edge, first[again], 1)
                np.add.at(edge, (first + length)[again], -1)
                covered |= np.cumsum(edge[:-1]) > 0
            for others, s, e in zip(zip(*(row[c] for c in carried)), p.starts.tolist(), p.ends.tolist()):
                gone = covered[s:e]
                n = int(np.count_nonzero(gone))
                kept = p.data[s:e][~gone].tobytes() if n else row["blob"][s:e]
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if n else 0
                for name, value in zip(names, (*others, e - s, n, spans, hashlib.sha256(kept).hexdigest(), (kept.decode(errors="ignore") if with_kept == "string" else kept) if with_kept else None)):
                    cols[name].append(value)
        types = arrow + [pa.int64()] * 3 + [pa.string(), pa.string() if with_kept == "string" else pa.binary()]
        return pa.table({n: pa.array(cols[n], t) for n, t in zip(names, types)})

    sampled = laid.select("part", "sizes", "blob").mapInArrow(sample_keys, "bucket int, part long, keys binary")
    flags = common.materialize(_rank(sampled, 1, buckets), "suffix-samples")
    texts = laid.select("part", "sizes", "blob").groupBy("part")
    strings = texts.cogroup(flags.groupBy("part")).applyInArrow(string_keys, "bucket int, part long, keys binary")
    flags = flags.unionAll(common.materialize(_rank(strings, 2, buckets), "suffix-strings"))
    if words:
        runs = laid.select("part", "sizes", "blob").mapInArrow(window_keys, "bucket int, part long, keys binary")
        flags = flags.unionAll(common.materialize(_rank(runs, 3, buckets), "suffix-windows"))
    schema = "".join(f"{c} {k.simpleString()}, " for c, k in zip(carried, kinds)) + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + (with_kept or "binary")
    out = laid.select("part", "sizes", "blob", *carried).groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(cut, schema)
    measures = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])]
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), *measures)


def without_repeats(docs: DataFrame, min_len: int = MIN_LEN, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text``; columns as they were, null texts empty.

    A cut may fall inside a character; the bytes of such a torn character go too.
    """
    rest = [c for c in docs.columns if c != "text"]
    kept = remove_repeats(docs, min_len, tuple(rest), with_kept="string", words=words)
    return kept.withColumn("text", F.col("kept")).select(*docs.columns)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and what is left of each text (torn characters go)."""
    return remove_repeats(common.table(spark, sf_dir, "documents"), with_kept="string").withColumnRenamed("kept", "text")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
