"""Operator 9: token-id files whose document boundaries are Elias-Fano coded.

A file (one shard) is a run of blocks.  A block holds the ids of consecutive documents
as one array of 2 or 4 byte little-endian integers, and where each document ends as an
Elias-Fano sequence: the low bits packed, the high bits in unary, and a sampled select
structure, about ``2 + log2(ids / documents)`` bits a document instead of 64.  The
``doc_id`` values ascend, so their distances to the block's first are a second such
sequence.  Readers get offsets and ids through select, of all documents of a block or,
by binary search, of wanted ones (``fetch_documents``).  Shards
are range partitions of ``doc_id``, so shard, block and position order is id order.
Blocks are written through Spark's own committer (a Parquet row with binary columns a
block), so any file system Spark knows will do and a lost executor leaves no half file.

Defined results: a null text is an empty one (it still gets the end id); repeated
``doc_id`` rows are kept, ordered by text; a null ``doc_id`` sorts first; an empty table
gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: A block is closed once it holds so many ids (the document that brings it there is its last, however long).
BLOCK_IDS = 1 << 20
#: A block's largest ``doc_id`` is less than this above its smallest.
ID_SPAN = 1 << 62
#: Every so many-th one bit has its place recorded.
SELECT_STEP = 64

FILE_SCHEMA = "shard int, block int, first_id long, n_ids long, width int, no_id int, first_doc long, last_doc long, docs binary, bounds binary, ids binary"


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> "EliasFano":
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = (v & ((1 << low_bits) - 1)).astype(np.uint64)
        bits = ((lows[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SELECT_STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype="<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "EliasFano":
        n, low_bits, nl, nh = np.frombuffer(raw, "<u4", 4).tolist()
        part = lambda at, k, t="u1": np.frombuffer(raw, t, k, at)
        return cls(n, low_bits, part(16, nl), part(16 + nl, nh), part(16 + nl + nh, -(-n // SELECT_STEP), "<u4"))

    def select(self, k: int) -> int:
        """The k-th value: from the nearest recorded one bit, count ones byte by byte."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // SELECT_STEP])
        left, byte = k % SELECT_STEP, at >> 3
        word = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        low, bit = 0, k * self.low_bits
        for j in range(self.low_bits):
            low |= (int(self.low[(bit + j) >> 3]) >> ((bit + j) & 7) & 1) << j
        return (place - k) << self.low_bits | low

    def select_all(self) -> np.ndarray:
        """Select for every k at once: all start at their recorded one bits and step on byte by byte."""
        k = np.arange(self.n)
        at = self.samples[k // SELECT_STEP].astype(np.int64)
        left, byte = k % SELECT_STEP, at >> 3
        high = np.append(self.high, np.uint8(0))
        word = high[byte] & (0xFF << (at & 7)).astype(np.uint8) if self.n else high[:0]
        ones = np.bitwise_count(word).astype(np.int64)
        on = np.flatnonzero(ones <= left)
        while len(on):
            left[on] -= ones[on]
            byte[on] += 1
            word[on] = high[byte[on]]
            ones[on] = np.bitwise_count(word[on])
            on = on[ones[on] <= left[on]]
        bits = np.unpackbits(word[:, None], axis=1, bitorder="little")
        place = byte * 8 + (np.cumsum(bits, axis=1) == (left + 1)[:, None]).argmax(axis=1)
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return ((place - k) << self.low_bits) | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)

    def places_of(self, value: int) -> range:
        """Which k have this value: two binary searches by select."""
        return range(bisect_left(range(self.n), value, key=self.select), bisect_right(range(self.n), value, key=self.select))


def _block_docs(row: dict) -> list:
    """The ``doc_id`` of each document of a block, null ones first."""
    return [None] * row["no_id"] + ([] if row["first_doc"] is None else (EliasFano.from_bytes(row["docs"]).select_all() + row["first_doc"]).tolist())


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, shards: int | None = None) -> None:
    """Encode ``docs(doc_id, text)`` and write the token files to ``path``."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    spark = docs.sparkSession
    common.ship(spark)

    def blocks(batches):
        from pyspark import TaskContext

        shard, width = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        block, first, ids, doc_ids, ends, size, low = 0, 0, [], [], [], 0, None

        def close():
            flat = np.frombuffer(b"".join(ids), "<u4")
            known = doc_ids[doc_ids.count(None) :]
            low, high = (known[0], known[-1]) if known else (None, None)
            docs = EliasFano.of([d - low for d in known]).to_bytes()
            values = (shard, block, first, size, width, len(doc_ids) - len(known), low, high, docs, EliasFano.of(ends).to_bytes(), (flat.astype("<u2") if width == 2 else flat).tobytes())
            small, wide, raw = pa.int32(), pa.int64(), pa.binary()
            kinds = (small, small, wide, wide, small, small, wide, wide, raw, raw, raw)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["shard", "block", "first_id", "n_ids", "width", "no_id", "first_doc", "last_doc", "docs", "bounds", "ids"])

        for batch in batches:
            enc = tokens.encoder(vocabulary)
            width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in tokens.chunks(texts):
                for key, got in zip(keys[part], enc.encode(texts[part])):
                    if key is not None and low is not None and key - low >= ID_SPAN:
                        yield close()
                        block, first, ids, doc_ids, ends, size, low = block + 1, first + size, [], [], [], 0, None
                    low = key if low is None else low
                    ids += [got, end]
                    size += len(got) // 4 + 1
                    doc_ids.append(key)
                    ends.append(size)
                    if size >= BLOCK_IDS:
                        yield close()
                        block, first, ids, doc_ids, ends, size, low = block + 1, first + size, [], [], [], 0, None
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # the beginning of the text splits the rows of a repeated id; range bounds stay short
    dealt = rows.repartitionByRange(shards or common.scale_partitions(spark), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(blocks, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    offsets = common.prefix_offsets(totals, "shard", "n_ids", "shard_first")

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw, width = row["ids"], row["width"]
                ends = EliasFano.from_bytes(row["bounds"]).select_all()
                starts = np.concatenate([[0], ends[:-1]])
                out, crc = [], []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    ids = np.frombuffer(raw, f"<u{width}", b - a, a * width).astype("<u4").tobytes()
                    crc.append(zlib.crc32(ids))
                    out.append(ids if with_ids else None)
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array(_block_docs(row), pa.int64()), pa.array(starts + row["first_id"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64()), pa.array(out, pa.binary())],
                    names=["shard", "doc_id", "local", "n_tokens", "ids_crc32", "ids"])

    found = files.mapInArrow(documents, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary")
    # a row per shard: bounded by the number of files
    found = found.join(F.broadcast(offsets), "shard")
    more = ["ids"] if with_ids else []
    return found.select("doc_id", (F.col("shard_first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *more)


def fetch_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of the wanted documents: only blocks that may hold one are read, and offsets come by select."""
    wanted = sorted(set(doc_ids))
    some = F.lit(False)
    for d in wanted:
        some = some | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))

    def pick(batches):
        for batch in batches:
            for row in batch.to_pylist():
                docs, bounds = EliasFano.from_bytes(row["docs"]), EliasFano.from_bytes(row["bounds"])
                got = [(d, row["no_id"] + k) for d in wanted if row["first_doc"] <= d <= row["last_doc"] for k in docs.places_of(d - row["first_doc"])]
                spans = [(bounds.select(k - 1) if k else 0, bounds.select(k)) for _, k in got]
                ids = [np.frombuffer(row["ids"], f"<u{row['width']}", b - a, a * row["width"]).astype("<u4").tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in got], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).where(some).mapInArrow(pick, "doc_id long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-files")
    write_token_files(common.table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


QUERIES = {"op9_token_files": op9_token_files}
ORACLES: dict[str, str] = {}
