"""Operator 4: concatenate-and-cut packing by two-pass prefix sums.

Pass one encodes every document where it lies (no shuffle) and writes its ids with the
number of ids before it in its partition.  The partitions' totals, one row each, become
global offsets by a prefix sum.  Pass two adds the offset and cuts each document at the
multiples of the sequence length; each piece is a boundary record.  Only the last
sequence is short, so padding is less than one sequence for the whole corpus.

Defined results: a null text is an empty one (one piece, the end id); repeated rows are
packed as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

SEQUENCE = 2048


def encode_partitions(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, ids (2 or 4 bytes each), n_tokens, and their place: partition and ids before them in it."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    common.ship(docs.sparkSession)

    def encode(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            enc = tokens.encoder(vocabulary)
            width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for some in tokens.chunks(texts):
                ids = [np.frombuffer(x + end, "<u4").astype(f"<u{width}") for x in enc.encode(texts[some])]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), pa.array(starts), keys.slice(some.start, k), pa.array(n), pa.array([width] * k, pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["part", "part_start", "doc_id", "n_tokens", "width", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "part int, part_start long, doc_id long, n_tokens long, width int, ids binary")


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    # the written table fixes each document's place, which a second encoding by other tasks might not repeat
    coded = common.materialize(encode_partitions(docs, vocabulary, end_id), "pack-ids")
    totals = coded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = common.prefix_offsets(totals, "part", "n", "part_first")
    # a row per written partition: bounded by the number of tasks
    placed = coded.join(F.broadcast(offsets), "part").select("doc_id", "n_tokens", (F.col("part_first") + F.col("part_start")).alias("first"), "width", "ids")

    def cut(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            cols = {x: [] for x in names}
            for doc, n, first, width, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                at = 0
                while at < n:
                    seq, off = divmod(first + at, sequence)
                    length = min(sequence - off, n - at)
                    piece = ids[4 * at : 4 * (at + length)]
                    for name, v in zip(names, (doc, at, length, zlib.crc32(piece), n, seq, off, piece if with_ids else None)):
                        cols[name].append(v)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(cols[x], pa.binary() if x == "ids" else pa.int64()) for x in names], names=names)

    pieces = placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces if with_ids else pieces.drop("ids")


def op4_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_concat_cut": op4_concat_cut}
ORACLES: dict[str, str] = {}
